"""Queries on the smallest tables, and the pipeline against plain versions of its stages."""

import os

import pandas as pd
import public_tokenizers
import pytest
from helpers import plain, roots, shingles
from tokenizers import Tokenizer

import corpus_pipeline
from siftline.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    return sorted(repr([None if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else v for v in r]) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, db, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(db.execute(queries.ORACLE_SQL[name]).df())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "packing"]


def test_stages(spark, db):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    item_words = [plain(t) for (t,) in db.execute("select text from benchmark").fetchall()]
    wins = {tuple(w[i : i + min(10, len(w))]) for w in item_words if w for i in range(max(1, len(w) - 9))}
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == documents.columns
        before, after = ({r.doc_id: r.text for r in x.collect()} for x in (docs, out))
        seen[name] = (before, after)
        docs = spark.createDataFrame(out.collect(), out.schema)
    before, after = seen["quality"]
    assert set(after) <= set(before)
    labels = {d: (q, t) for d, q, t in db.execute("select doc_id, quality, toxic from labels").fetchall()}
    clean = [d for d, x in labels.items() if x == (1, 0)]
    assert sum(d in after for d in clean) >= 0.9 * len(clean)
    before, after = seen["near_dedup"]
    sets = {d: shingles(t, 5) for d, t in before.items()}
    root = roots(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert set(after) == {d for d in sets if root[d] == d}
    before, after = seen["decontamination"]
    sizes = {len(w) for w in wins}
    hit = {d for d, t in before.items() if any(tuple(w[i : i + n]) in wins for w in [plain(t)] for n in sizes for i in range(len(w) - n + 1))}
    assert set(after) == set(before) - hit and hit
    before, after = seen["pii"]
    assert set(before) == set(after) and any("[EMAIL]" in t for t in after.values())
    packed = corpus_pipeline.best_fit_packing(spark, docs, SF).collect()
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(model.encode(t, add_special_tokens=False).ids) + 1 for t in after.values())
    assert sum(r.length for r in packed) == tokens
    assert len({r.sequence_id for r in packed}) <= 1.02 * tokens / 2048 + 1


def test_rows_of_null_id_are_decided_like_others(spark, db):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    passage = max((t for (t,) in db.execute("select text from benchmark where text is not null").fetchall()), key=lambda t: len(plain(t)))
    texts = {"named": "one two three four five six seven", "copy": "eight nine ten eleven twelve thirteen", "leak": f"so {passage} it", "last": "alone among all of these rows here"}
    some = [(1, "named"), (None, "named"), (None, "named"), (None, "copy"), (None, "copy"), (None, "last"), (2**63 - 1, "last"), (None, "leak"), (3, "leak")]
    for high in (False, True):
        rows = [(d, texts[t], "en", "x", len(texts[t])) for d, t in some if high or d is None or d < 2**62]
        docs = spark.createDataFrame(rows, documents.select("doc_id", "text", "lang", "source", "n_chars").schema)
        once = corpus_pipeline.near_dedup(spark, docs, SF)
        assert once.columns == docs.columns and sorted(r.text for r in once.collect()) == sorted(texts.values())
        if not high:  # a row with an id comes before its copies without
            assert {(r.doc_id, r.text) for r in once.collect()} >= {(1, texts["named"]), (3, texts["leak"]), (None, texts["copy"])}
        clean = corpus_pipeline.decontamination(spark, docs, SF)
        assert clean.columns == docs.columns and sorted(r.text for r in clean.collect()) == sorted(r[1] for r in rows if r[1] != texts["leak"])
