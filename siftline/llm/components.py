"""Connected components over a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, small_side


def components(edges: DataFrame, scratch: Scratch, name: str, a: str = "a", b: str = "b", hub: int = 100_000) -> DataFrame:
    """(id, label): the smallest id reachable over edges, for every id that has an edge.

    Each round takes the least label of the neighbours and then follows labels twice (pointer
    jumping), so the number of rounds grows with the logarithm of the longest path. Only the count
    of changed rows comes to the driver. Minima are combined before the shuffle; the edges of a node
    with more than `hub` of them are dealt over as many groups as keep each to about so many, each
    with a copy of the node's label. Null ends, self-loops and repeated edges have no effect; no
    edges give no rows.
    """
    pair = edges.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = scratch.save(pair.unionByName(pair.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("label")), f"{name}-0")
    groups = F.ceil(F.col("n") / F.lit(hub)).cast("long")
    hubs = scratch.save(both.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > hub).select("v", groups.alias("groups")), f"{name}-hubs")
    dealt, keys = both, ["v"]
    if hubs.limit(1).count():
        part = F.pmod(F.xxhash64("u"), F.coalesce("groups", F.lit(1))).alias("part")
        dealt, keys = scratch.save(both.join(small_side(hubs), "v", "left").select("u", "v", part), f"{name}-dealt"), ["v", "part"]

    def told(labels: DataFrame) -> DataFrame:
        known = labels.withColumnRenamed("id", "v")
        if dealt is both:
            return known
        return known.join(small_side(hubs), "v", "left").select("v", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("groups", F.lit(1)) - 1)).alias("part"))

    turn = 0
    while True:
        turn += 1
        least = dealt.join(told(labels), keys).groupBy(F.col("u").alias("id")).agg(F.min("label").alias("m"))
        near = labels.join(least, "id").select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = near.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = scratch.save(near.join(jump, "label").select("id", "old", F.least("label", "far").alias("label")), f"{name}-{turn}")
        changed = new.where("old <> label").limit(1).count()
        scratch.drop(f"{name}-{turn - 1}")
        labels = new.select("id", "label")
        if not changed:
            scratch.drop(f"{name}-edges", f"{name}-dealt", f"{name}-hubs")
            return labels
