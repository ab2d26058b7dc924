"""Best-two-fit packing of token sequences.

Packing only looks at lengths, and there are at most `max_len` of them. So the driver gets the
number of pieces of each length (at most max_len rows, whatever the corpus' size) and packs that
histogram; equal bins are made together, as one pattern and a count. Each pattern gives each of its
lengths a range of ranks, and pieces take places by their rank among the pieces of their length.
Ranks come from counts by (length, salt) and a row number within them; the number of salts follows
the number of pieces, so that a length that a third of all pieces share is spread over many groups.

Filling. A bin takes the longest piece left, then again and again the longest that fits. While a gap
stays, the bin's smallest piece is taken out if two unpacked pieces together fill the widened gap
better than it did, and the closest such two go in.

Null texts are empty: one piece that holds the end token only. Rows of null id are packed like
others. Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit, wordwise
from .storage import Scratch, ship

def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = 2048, end_id: int = 0, by_word: bool = False, with_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids]) for every piece of every document.

    by_word: the tokenizer is of the kind that wordwise.py tells of, so that distinct words are encoded once.
    """
    ship(docs.sparkSession)
    schema = f"{id_col} long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = wordwise.Words(tokenizer)
        for block, data, offsets in textkit.row_blocks(batches, limit=wordwise.STEP):
            if by_word:
                ids, bounds = wordwise.encode_rows(data, offsets, words)
            else:
                coded = [np.array(e.ids, dtype="<u4") for e in words.whole.encode_batch_fast([x or "" for x in block.column("text").to_pylist()], add_special_tokens=False)]
                ids, bounds = np.concatenate(coded), np.concatenate([[0], np.cumsum([len(x) for x in coded])])
            ids = np.insert(ids, bounds[1:], np.uint32(end_id)).astype("<u4", copy=False)
            sizes = np.diff(bounds) + 1
            many = -(-sizes // max_len)
            doc = np.repeat(np.arange(len(sizes)), many)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            start = number * max_len
            length = np.minimum(max_len, sizes[doc] - start)
            begin = (bounds[:-1] + np.arange(len(sizes)))[doc] + start
            raw = memoryview(ids).cast("B")
            parts = [raw[4 * a : 4 * (a + n)] for a, n in zip(begin.tolist(), length.tolist())]
            out = [block.column("id").take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(list(map(bytes, parts)), pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def best_two_fit(counts: dict[int, int], max_len: int) -> list[tuple[int, list[int]]]:
    """[(number of equal bins, lengths in the bin)] for the numbers of pieces by length."""
    left = np.zeros(max_len + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    below = np.zeros(max_len + 1, dtype=np.int64)  # the longest length left up to x, 0 if none

    def refresh(upto: int = max_len) -> None:
        below[:] = np.maximum.accumulate(np.where(left > 0, np.arange(max_len + 1), 0))

    def take(length: int) -> None:
        left[length] -= 1
        if not left[length]:
            refresh()

    def give(length: int) -> None:
        left[length] += 1
        if left[length] == 1:
            refresh()

    def two(gap: int) -> tuple[int, int]:
        """The two unpacked pieces with the largest sum up to gap."""
        a = np.flatnonzero(left[: gap + 1])
        if not len(a):
            return 0, 0
        b = below[gap - a]
        lone = (a == b) & (left[a] < 2)
        b[lone] = below[np.maximum(a[lone] - 1, 0)]
        sums = np.where(b > 0, a + b, 0)
        best = int(sums.argmax())
        return (int(a[best]), int(b[best])) if sums[best] else (0, 0)

    refresh()
    out: list[tuple[int, list[int]]] = []
    while below[max_len]:
        held, gap = [], max_len
        while gap and (longest := int(below[gap])):
            held.append(longest)
            take(longest)
            gap -= longest
        while gap and held:
            smallest = min(held)
            a, b = two(gap + smallest)
            if a + b <= smallest:
                break
            held.remove(smallest)
            take(a)
            take(b)
            held += [a, b]
            gap += smallest - a - b
            give(smallest)
        lengths, uses = np.unique(held, return_counts=True)
        more = int((left[lengths] // uses).min())
        if more:
            left[lengths] -= more * uses
            refresh()
        out.append((1 + more, sorted(held, reverse=True)))
    return out


def pack(pieces: DataFrame, max_len: int = 2048, rows_per_group: int = 200_000) -> DataFrame:
    """pieces (a column length of 1 to max_len, and others of any names) with sequence_id and offset.

    The pieces of one length are ranked in as many groups as keep each to about rows_per_group rows, whatever share
    of all pieces has that length. Columns of pieces that are named sequence_id or offset are replaced.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    row, salt, base, rank = (f"{n}_{uuid.uuid4().hex}" for n in ("row", "salt", "base", "rank"))  # pieces may have any column names
    stored = scratch.save(pieces.drop("sequence_id", "offset").withColumn(row, F.monotonically_increasing_id()), "pieces")
    salts = -(-stored.count() // rows_per_group) or 1
    stored = stored.withColumn(salt, F.pmod(F.xxhash64(row), F.lit(salts)))
    cells = scratch.save(stored.groupBy("length", salt).agg(F.count("*").alias("n")), "cells")
    # at most max_len rows
    counts = {int(r.length): int(r.n) for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_two_fit(counts, max_len)
    table, sequence, used = {}, 0, dict.fromkeys(counts, 0)
    for bins, held in plan:
        lengths, uses = np.unique(held, return_counts=True)
        offset = 0
        for length, per in zip(lengths.tolist(), uses.tolist()):
            table.setdefault(length, []).append((used[length], sequence, per, offset))
            used[length] += bins * per
            offset += per * length
        sequence += bins
    places = spark.sparkContext.broadcast({k: np.array(v, dtype=np.int64) for k, v in table.items()})
    before = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select("length", salt, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    ranked = stored.withColumn(rank, F.row_number().over(Window.partitionBy("length", salt).orderBy(row)).cast("long") - 1)
    ranked = ranked.join(bases, ["length", salt]).withColumn(rank, F.col(rank) + F.col(base)).drop(base, salt, row)
    names = ranked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank_of = np.array(batch.column("length")), np.array(batch.column(rank))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length).tolist():
                at = np.flatnonzero(length == one)
                rows = places.value[one]
                hit = rows[np.searchsorted(rows[:, 0], rank_of[at], "right") - 1]
                inner = rank_of[at] - hit[:, 0]
                sequence[at] = hit[:, 1] + inner // hit[:, 2]
                offset[at] = hit[:, 3] + inner % hit[:, 2] * one
            kept = [batch.column(c) for c in names if c != rank]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[c for c in names if c != rank] + ["sequence_id", "offset"])

    fields = ", ".join(f"`{n}` {t}" for n, t in ranked.dtypes if n != rank)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")
