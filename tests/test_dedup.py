"""Deduplication, order, chunks."""

from pyspark.sql import functions as F

from siftline.operators import chunks, dedup
from siftline.plans.workspace import Workspace


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, ord int, v string")


ROWS = [("b", 3, "x"), ("a", 2, "y"), ("b", 1, "z"), ("a", 5, "w"), ("c", 4, "q")]


def test_first_survives(spark):
    got = dedup.dedup_first(frame(spark, ROWS), ["key"], ["ord"]).collect()
    assert {(r.key, r.v) for r in got} == {("a", "y"), ("b", "z"), ("c", "q")}


def test_shapes_agree_at_any_partitioning(spark):
    df = spark.range(5000).select(F.concat(F.lit("k"), F.col("id") % 300).alias("key"), (F.lit(5000) - F.col("id")).cast("int").alias("ord"), F.col("id").cast("string").alias("v"))
    want = {(r.key, r.ord, r.v) for r in dedup.dedup_first(df, ["key"], ["ord"]).collect()}
    for n in (1, 7):
        for hot in (False, True):
            assert {(r.key, r.ord, r.v) for r in dedup.sort_dedup(df.repartition(n), "key", ["ord"], hot_keys=hot).collect()} == want
    assert {(r.key, r.ord, r.v) for r in dedup.keep_smallest(df, ["key"], "ord", ["ord", "v"]).collect()} == want


def test_sorted_and_one_exchange(spark):
    out = dedup.sort_dedup(frame(spark, ROWS), "key", ["ord"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    keys = [r.key for r in out.collect()]
    assert keys == sorted(set(keys))
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan


def test_partial_limit_before_the_exchange(spark):
    plan = dedup.dedup_first(frame(spark, ROWS), ["key"], ["ord"])._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "Final" in plan


def test_positions(spark):
    df = spark.range(2000).select(F.format_string("%05d", F.col("id") % 700).alias("key"), F.col("id").cast("int").alias("ord"))
    rows = dedup.with_position(dedup.sort_dedup(df, "key", ["ord"]), Workspace(spark)).orderBy("key").collect()
    assert [r.pos for r in rows] == list(range(1, 701))


def test_empty(spark):
    none = frame(spark, [])
    assert dedup.sort_dedup(none, "key", ["ord"]).count() == 0
    assert dedup.merge_dedup([none, none], ["key"], ["ord"]).count() == 0


def test_merge_counts(spark):
    a, b, c = (frame(spark, [(k, i, k) for i, k in enumerate(x)]) for x in (["alice", "charlie"], ["bob", "david"], ["alice"]))
    assert dedup.merge_dedup([a, b, c], ["key"], ["ord"]).count() == 4
    a, b = (frame(spark, [(k, i, k) for i, k in enumerate(x)]) for x in (["key1", "key2"], ["key1", "key3"]))
    assert dedup.merge_dedup([a, b], ["key"], ["ord"]).count() == 3


def test_chunks_are_filled_greedily(spark):
    df = spark.createDataFrame([("f", i, s) for i, s in enumerate([40, 40, 40, 200, 10, 90, 1])], "file string, ord int, size int")
    got = [r.chunk_no for r in chunks.assign_chunks(df, "file", "ord", "size", 100).orderBy("ord").collect()]
    assert got == [0, 0, 1, 2, 3, 3, 4]


def test_small_chunks_split_ten_rows(spark):
    df = spark.createDataFrame([("f", i, 60, f"k{i % 4}", f"line{i}") for i in range(10)], "file string, ord int, size int, key string, line string")
    got = chunks.chunk_report(df, "file", "ord", "size", "key", "line", 100).collect()
    assert len(got) == 10 and sum(r.records_read for r in got) == 10
