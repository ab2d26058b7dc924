"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
from siftline import catalogue  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(repr([None if v is None or v != v else v for v in r]) for r in frame[cols].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(db.execute(catalogue.ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [["siftline/llm"], ["siftline/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_the_rest_stands_alone(tmp_path, gone):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    shutil.copytree(top / "siftline", tmp_path / "siftline", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (top / name).exists():
            shutil.copy(top / name, tmp_path)
    for name in gone:
        shutil.rmtree(tmp_path / name, ignore_errors=True) if "." not in name else (tmp_path / name).unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr
    names = set(said.stdout.split())
    assert set(catalogue.QUERIES) <= names and "pipeline" not in names
