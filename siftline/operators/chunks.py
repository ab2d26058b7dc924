"""Size-bounded chunks of ordered records, their report and estimates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.shipping import ship
from .names import fresh

#: The merge's cost for a record, in milliseconds, and its least estimate.
MERGE_MS_PER_RECORD = 0.001
LEAST_MERGE_MS = 1000


def estimate_chunk_count(total_bytes: Column, chunk_bytes: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total_bytes / chunk_bytes)).cast("long")


def estimate_merge_ms(records: Column) -> Column:
    return F.greatest(F.lit(LEAST_MERGE_MS), F.floor(records * MERGE_MS_PER_RECORD)).cast("long")


def assign_chunks(df: DataFrame, file: str, order: str, size: str, limit: int) -> DataFrame:
    """df (columns file, order, size) with chunk_no: a chunk is full when the next record would pass limit.

    The fold runs over each file's rows in order. It streams: a task holds a batch and one running
    size, not a file.
    """
    ship(df.sparkSession)
    names = df.columns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, chunk, filled = None, 0, 0
        for batch in batches:
            names, sizes = batch[file].to_numpy(), batch[size].to_numpy()
            numbers = np.empty(len(batch), dtype=np.int64)
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(batch)] if len(batch) else []
            for begin, end in zip(edges, edges[1:]):
                if names[begin] != here:
                    here, chunk, filled = names[begin], 0, 0
                upto, at = np.cumsum(sizes[begin:end]), 0
                while at < end - begin:  # a step for each chunk
                    done = int(upto[at - 1]) if at else 0
                    last = int(np.searchsorted(upto, done + limit - filled, "right"))
                    if last == at and not filled:
                        last = at + 1  # one record is over the limit by itself
                    numbers[begin + at : begin + last] = chunk
                    if last < end - begin:
                        chunk, filled = chunk + 1, 0
                    elif last > at:
                        filled += int(upto[last - 1]) - done
                    at = last
            yield batch.assign(chunk_no=numbers)

    lined = df.repartition(F.col(file)).sortWithinPartitions(file, order)
    fields = ", ".join(f"`{n}` {t}" for n, t in df.select(*names).dtypes)
    return lined.mapInPandas(fold, f"{fields}, chunk_no long")


def chunk_report(df: DataFrame, file: str, order: str, size: str, key: str, line: str, limit: int) -> DataFrame:
    """A row for each chunk: file, chunk_no, records read and written (first of each key), bytes written with line ends."""
    placed = assign_chunks(df.select(file, order, size, key, line), file, order, size, limit)
    rank = fresh(placed, "_rn")
    ranked = placed.withColumn(rank, F.row_number().over(Window.partitionBy(file, "chunk_no", key).orderBy(order)))
    kept = F.when(F.col(rank) == 1, F.octet_length(line) + 1)
    return ranked.groupBy(file, "chunk_no").agg(F.count("*").alias("records_read"), F.count(kept).alias("record_count"), F.sum(kept).cast("long").alias("file_size_bytes"))
