"""Exact deduplication: the first row of each key survives, by a given order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.workspace import Workspace
from .names import fresh


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row for each key: the first by order.

    A hash exchange; Spark limits each task's groups to one row before it, so that a hot key sends
    one row from each task. Null keys are one key; ties in order leave any one of the tied rows.
    """
    rank = fresh(df, "_rn")
    ranked = Window.partitionBy(*keys).orderBy(*_columns(order))
    return df.withColumn(rank, F.row_number().over(ranked)).where(F.col(rank) == 1).drop(rank)


def dedup_in_runs(df: DataFrame, run: str, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key within each run."""
    return dedup_first(df, [run, *keys], order)


def merge_dedup(runs: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """All runs together, the first row of each key over all of them."""
    whole = runs[0]
    for run in runs[1:]:
        whole = whole.unionByName(run)
    return dedup_first(whole, keys, order)


def sort_dedup(df: DataFrame, key: str, order: Sequence[str | Column], hot_keys: bool = False) -> DataFrame:
    """One row for each key, ordered by key over all partitions.

    One range exchange serves the deduplication and the sort. With hot_keys, rows are first cut to
    one for each key and task by a hash exchange of their own, so that no range holds a key's copies.
    """
    if hot_keys:
        df = dedup_first(df, [key], order)
    return dedup_first(df.repartitionByRange(F.col(key)), [key], order).orderBy(key)


def with_position(ordered: DataFrame, workspace: Workspace, name: str = "ordered") -> DataFrame:
    """An ordered DataFrame with pos, the row's place from 1, without bringing rows to one task or a second shuffle.

    A row's part and its place in the part are taken in the stage that sorts, and written with it. A column pos of
    ordered is replaced.
    """
    spot, base = fresh(ordered, "_spot"), fresh(ordered, "_base")
    kept = workspace.save(ordered.drop("pos").withColumn(spot, F.monotonically_increasing_id()), name)
    part = F.shiftright(F.col(spot), 33)  # the upper bits are the partition's number, the lower ones count its rows
    sizes = kept.groupBy(part.alias(spot)).agg(F.count("*").alias("n"))
    # as many rows as parts
    before = sizes.select(F.col(spot).alias(base + "_part"), F.coalesce(F.sum("n").over(Window.orderBy(spot).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(base))
    placed = kept.join(F.broadcast(before), part == F.col(base + "_part"))
    return placed.withColumn("pos", F.col(base) + F.col(spot).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(spot, base, base + "_part")


def keep_smallest(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """dedup_first by an aggregate (min_by); for comparison and for wide rows of which few columns are needed."""
    held = fresh(df, "_s")
    return df.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias(held)).select(*keys, f"{held}.*")
