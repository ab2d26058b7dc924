"""Files in, files out: discovery, scan, job, resume, command line, streaming."""

import json
import time
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siftline.__main__ import main
from siftline.config import JobConfig
from siftline.plans.job import DedupJob, normalized_records, run_dedup
from siftline.plans.manifest import MANIFEST, Manifest, validate_batches
from siftline.plans.workspace import Workspace
from siftline.sources.lines import discover_csv, read_lines
from siftline.streaming import stream_dedup


def files(folder, **named):
    folder.mkdir(parents=True, exist_ok=True)
    out = []
    for name, text in named.items():
        p = folder / f"{name}.csv"
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
        out.append(str(p))
    return out


def config(tmp_path, **more):
    return JobConfig(temp_directory=str(tmp_path / "temp"), **more)


def test_discovery(spark, tmp_path):
    for name in ("b.csv", "a.CSV", "c.Csv", ".hidden.csv", "readme.txt", "with space.csv", ".csv"):
        (tmp_path / name).write_text("x")
    (tmp_path / "sub.csv").mkdir()
    got = [Path(p).name for p in discover_csv(spark, str(tmp_path))]
    assert got == sorted([".hidden.csv", "a.CSV", "b.csv", "c.Csv", "with space.csv"], key=str.encode)


def test_discovery_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        discover_csv(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        discover_csv(spark, str(tmp_path / "none"))


def test_lines_keep_their_order_and_bad_ones_go_alone(spark, tmp_path):
    paths = files(tmp_path, b=b"one\n\xff\xfe\nthree\rstill three\nfour", a="x\ny\n")
    hidden = tmp_path / ".h[1].csv"
    hidden.write_text("z\n")
    rows = read_lines(spark, [*paths, str(hidden)]).orderBy("file_index", "block_start", "line_id").collect()
    assert [r.value for r in rows] == ["one", "three\rstill three", "four", "x", "y", "z"]
    assert [r.file_index for r in rows] == [0, 0, 0, 1, 1, 2]


def test_one_file(spark, tmp_path):
    paths = files(tmp_path / "in", a="user1,p\nuser2,p\nuser1,p\nuser3,p\n")
    stats = run_dedup(spark, paths, f"file://{tmp_path}/out/r.csv", config(tmp_path))
    assert (stats.total_records, stats.unique_records, stats.duplicates_removed) == (4, 3, 1)
    assert (tmp_path / "out/r.csv").read_text() == "user1,p\nuser2,p\nuser3,p\n"


def test_duplicates_across_files_go(spark, tmp_path):
    paths = files(tmp_path / "in", a="key1,value1\nkey2,value2\n", b="key1,value1\nkey3,value3\n")
    stats = run_dedup(spark, paths, f"file://{tmp_path}/r.csv", config(tmp_path))
    assert (stats.unique_records, stats.duplicates_removed) == (3, 1)
    assert (tmp_path / "r.csv").read_text().splitlines() == ["key1,value1", "key2,value2", "key3,value3"]


def test_first_file_wins_and_case_option(spark, tmp_path):
    paths = files(tmp_path / "in", a="Alice,p,first\n", b="alice,p,second\n")
    run_dedup(spark, paths, f"file://{tmp_path}/r.csv", config(tmp_path))
    assert (tmp_path / "r.csv").read_text() == "Alice,p,first\n"
    stats = run_dedup(spark, paths, f"file://{tmp_path}/r.csv", config(tmp_path, case_sensitive=True))
    assert stats.unique_records == 2


def test_url_key_and_email_option(spark, tmp_path):
    paths = files(tmp_path / "in", a="u@x.org,p1,https://s.com/\nu@x.org,p2,s.com\nplain,p,s.com\n")
    assert run_dedup(spark, paths, f"file://{tmp_path}/r.csv", config(tmp_path), key="username_url").unique_records == 2
    assert run_dedup(spark, paths, f"file://{tmp_path}/r.csv", config(tmp_path, normalize_urls=False), key="username_url").unique_records == 3
    assert run_dedup(spark, paths, f"file://{tmp_path}/r.csv", config(tmp_path, email_only_usernames=True)).total_records == 2


def test_nothing_to_write(spark, tmp_path):
    paths = files(tmp_path / "in", a="\ninvalid_line_no_commas\n")
    stats = run_dedup(spark, paths, f"file://{tmp_path}/r.csv", config(tmp_path))
    assert stats.unique_records == 0 and not (tmp_path / "r.csv").exists()


def test_quoted_output_reads_back(spark, tmp_path):
    text = 'a,"x,y",,"e ""f"\nb,"p:q",u\n'
    paths = files(tmp_path / "in", a=text)
    run_dedup(spark, paths, f"file://{tmp_path}/again/r.csv", config(tmp_path), line_form="quoted")
    job = DedupJob(spark, config(tmp_path))
    rows = lambda p: sorted((r.username, r.password, r.url, tuple(r.extra_fields)) for r in job.records(read_lines(spark, p)).collect())
    assert rows([str(tmp_path / "again/r.csv")]) == rows(paths)


def test_idempotent(spark, tmp_path):
    paths = files(tmp_path / "in", a="".join(f"u{i % 50},p{i % 3},site{i % 50}.com\n" for i in range(400)))
    first = run_dedup(spark, paths, f"file://{tmp_path}/one/r.csv", config(tmp_path))
    second = run_dedup(spark, [str(tmp_path / "one/r.csv")], f"file://{tmp_path}/two/r.csv", config(tmp_path))
    assert first.unique_records == second.unique_records == second.total_records
    assert (tmp_path / "one/r.csv").read_text() == (tmp_path / "two/r.csv").read_text()


def test_missing_file(spark, tmp_path):
    paths = files(tmp_path / "in", a="a,b\n")
    with pytest.raises(FileNotFoundError):
        run_dedup(spark, [*paths, str(tmp_path / "none.csv")], f"file://{tmp_path}/r.csv", config(tmp_path))
    assert run_dedup(spark, [*paths, str(tmp_path / "none.csv")], f"file://{tmp_path}/r.csv", config(tmp_path), ignore_failed_files=True).unique_records == 1


def test_resume_parses_only_what_is_left(spark, tmp_path, monkeypatch):
    paths = files(tmp_path / "in", a="a,1\nb,2\n", b="b,2\nc,3\n")
    staged = []
    stage = DedupJob._stage

    def failing(self, folder, all_paths, some, signed):
        if some == [1] and not staged.count("stop"):
            staged.append("stop")
            raise RuntimeError("lost")
        staged.append(tuple(some))
        return stage(self, folder, all_paths, some, signed)

    monkeypatch.setattr(DedupJob, "_stage", failing)
    job = DedupJob(spark, config(tmp_path), files_per_batch=1)
    with pytest.raises(RuntimeError):
        job.run(paths, f"file://{tmp_path}/r.csv")
    assert job.progress(2) == 40.0
    stats = DedupJob(spark, config(tmp_path), files_per_batch=1).run(paths, f"file://{tmp_path}/r.csv", resume=True)
    assert staged == [(0,), "stop", (1,)]
    assert (stats.total_records, stats.unique_records) == (4, 3)
    assert json.loads((tmp_path / "temp" / MANIFEST).read_text())["phase"] == "Completed"
    with pytest.raises(ValueError):
        DedupJob(spark, config(tmp_path, case_sensitive=True)).run(paths, f"file://{tmp_path}/r.csv", resume=True)
    job.cleanup()
    assert not (tmp_path / "temp").exists()


def test_incomplete_staging_is_an_error(spark, tmp_path):
    from siftline.plans.manifest import Batch

    workspace = Workspace(spark)
    with pytest.raises(FileNotFoundError, match="does not exist"):
        validate_batches([Batch([], f"file://{tmp_path}/none", 0, 0)], workspace)
    (tmp_path / "half").mkdir()
    with pytest.raises(ValueError, match="not complete"):
        validate_batches([Batch([], f"file://{tmp_path}/half", 0, 0)], workspace)
    assert not Manifest.exists(workspace, f"file://{tmp_path}")


def test_foreign_files_survive(spark, tmp_path, monkeypatch):
    paths = files(tmp_path / "in", a="a,1\n")
    foreign = tmp_path / "temp" / "staged" / "mine.txt"
    foreign.parent.mkdir(parents=True)
    foreign.write_text("mine")
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    config(tmp_path).to_file(tmp_path / "c.json")
    run_dedup(spark, paths, f"file://{tmp_path}/r.csv", config(tmp_path))  # leaves a saved job behind
    assert main(["-i", str(tmp_path / "in"), "-o", f"file://{tmp_path}/r.csv", "-c", str(tmp_path / "c.json")]) == 0
    assert foreign.read_text() == "mine" and [p.name for p in (tmp_path / "temp").iterdir()] == ["staged"]


def test_staging_is_shared(spark, tmp_path):
    shared = spark.conf.get("spark.checkpoint.dir")
    job = DedupJob(spark)
    job.run(files(tmp_path / "in", a="a,1\n"), f"file://{tmp_path}/r.csv")
    assert Path(shared.removeprefix("file://"), "external_sort_temp", MANIFEST).exists()
    assert all(b.folder.startswith(shared) for b in job.manifest.batches)
    job.cleanup()
    assert not Path(shared.removeprefix("file://"), "external_sort_temp").exists()


def test_the_shared_folder(spark, tmp_path, monkeypatch):
    from siftline.plans.workspace import shared_root

    given = {}
    monkeypatch.setattr(type(spark.conf), "get", lambda self, name, default=None: given.get(name, default))
    own = shared_root(spark)
    assert own.startswith("file://") and shared_root(spark) == own  # unset: one for the application
    given["spark.checkpoint.dir"] = str(tmp_path)
    assert shared_root(spark) == f"file://{tmp_path}"
    given["spark.checkpoint.dir"] = "store://a/b/"
    assert shared_root(spark) == "store://a/b"


def test_staged_rows_are_counted(spark, tmp_path):
    from siftline.plans.manifest import Batch

    workspace = Workspace(spark)
    workspace.save(spark.range(5), "five")
    validate_batches([Batch([], workspace.path("five"), 9, 5)], workspace)
    with pytest.raises(ValueError, match="5 rows, not 6"):
        validate_batches([Batch([], workspace.path("five"), 9, 6)], workspace)


def test_a_file_is_replaced_in_one_step(spark, tmp_path):
    workspace, path = Workspace(spark), tmp_path / "state.json"
    for text in ("old", "newer"):
        workspace.write_text(f"file://{path}", text)
        assert path.read_text() == workspace.read_text(f"file://{path}") == text
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["state.json"]


def test_merging_progress_follows_tasks(spark, tmp_path, monkeypatch):
    seen, told = [], []
    merge = DedupJob._merge

    def watched(self, batches, output):
        monkeypatch.setattr(DedupJob, "_tasks", lambda self: (3, 4))
        seen.append(self.progress(1))
        monkeypatch.setattr(DedupJob, "_tasks", lambda self: (0, 0))
        seen.append(self.progress(1))
        over = self.report(1, told.append)
        time.sleep(1.5)
        over()
        return merge(self, batches, output)

    monkeypatch.setattr(DedupJob, "_merge", watched)
    job = DedupJob(spark, config(tmp_path, merge_progress_interval_seconds=1))
    assert job._tasks() == (0, 0)
    job.run(files(tmp_path / "in", a="a,1\n"), f"file://{tmp_path}/r.csv")
    assert seen == [80 + 15 * 3 / 4, 85.0] and told == ["Merging: 85 %"] and job.progress(1) == 100.0


def test_options_reach_spark():
    own = JobConfig(io_buffer_size_kb=128, merge_buffer_size_kb=512, processing_threads=3, chunk_size_mb=64)
    got = own.spark_options()
    assert got["spark.shuffle.file.buffer"] == "128k" and got["spark.shuffle.unsafe.file.output.buffer"] == "512k"
    assert got["spark.master"] == "local[3]" and got["spark.sql.files.maxPartitionBytes"] == str(64 << 20)
    assert "spark.master" not in own.spark_options(cluster=True) and own.memory_limit_bytes(1000) == 600


def test_config(tmp_path):
    assert JobConfig().validate().chunk_size_bytes == 512 << 20
    for bad in ({"memory_usage_percent": 5}, {"memory_usage_percent": 95}, {"chunk_size_mb": 10}, {"chunk_size_mb": 5000}, {"processing_threads": 0}, {"processing_threads": 64}, {"cuda_batch_size": 1}):
        with pytest.raises(ValueError):
            replace(JobConfig(), **bad).validate()
    path = tmp_path / "c.json"
    JobConfig(case_sensitive=True).to_file(path)
    assert JobConfig.from_file(path) == JobConfig(case_sensitive=True)
    path.write_text("{}")
    with pytest.raises(ValueError, match="missing options"):
        JobConfig.from_file(path)


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    files(tmp_path / "in", a="b,2\na,1\nb,2\n")
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    config(tmp_path).to_file(tmp_path / "c.json")
    assert main(["-i", str(tmp_path / "in"), "-o", f"file://{tmp_path}/r.csv", "-c", str(tmp_path / "c.json")]) == 0
    assert (tmp_path / "r.csv").read_text() == "a,1\nb,2\n"
    assert "2 unique, 1 duplicates" in capsys.readouterr().out
    assert main(["-i", str(tmp_path / "none"), "-o", "r", "-c", str(tmp_path / "c.json")]) == 1


def test_batch_normalisation(spark):
    df = spark.createDataFrame([("User", "p", "https://www.A.com/x", ["e"]), ("É", "", "", [])], "username string, password string, url string, extra_fields array<string>")
    a, b = normalized_records(df).collect()
    assert (a.normalized_user, a.normalized_url, a.field_count, a.all_fields) == ("user", "a.com", 4, ["User", "p", "https://www.A.com/x", "e"])
    assert (b.normalized_user, b.normalized_url, b.field_count, b.all_fields) == ("É", "", 2, ["É", ""])
    assert normalized_records(df, case_sensitive=True).first().normalized_user == "User"


def test_stream_keeps_its_state(spark, tmp_path):
    arrived = tmp_path / "arrived"
    files(arrived, a="k1,v\nk2,v\n", b="k1,v\nk3,v\n")
    run = lambda: stream_dedup(spark, f"file://{arrived}", f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    run()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 3
    files(arrived, c="k3,v\nk4,v\n")
    run()
    out = spark.read.parquet(f"file://{tmp_path}/out")
    assert out.count() == 4 and out.select(F.countDistinct("key")).first()[0] == 4


def test_stopped_from_the_keyboard(spark, tmp_path, monkeypatch, capsys):
    files(tmp_path / "in", a="b,2\n")
    monkeypatch.setattr(type(spark), "stop", lambda self: None)

    def interrupted(self, *args):
        raise KeyboardInterrupt

    monkeypatch.setattr(DedupJob, "_stage", interrupted)
    config(tmp_path).to_file(tmp_path / "c.json")
    assert main(["-i", str(tmp_path / "in"), "-o", f"file://{tmp_path}/r.csv", "-c", str(tmp_path / "c.json")]) == 130
    assert "--resume" in capsys.readouterr().err and (tmp_path / "temp" / MANIFEST).exists()


def test_scan_is_not_shuffled(spark, tmp_path):
    plan = read_lines(spark, files(tmp_path, a="x\n"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
