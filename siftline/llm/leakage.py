"""Benchmark decontamination over a distributed positional inverted index.

Index. Each row of the index is one shard: a run of documents with, for every term that occurs in
them, the sorted list of its positions. Shards are cut from the scan as it runs, so postings are
stored without a shuffle, and a shard's size is bounded by `shard_bytes` of text (or one document).
Positions count through the shard with one unused place between documents, so that no phrase can
run from one document into the next. Terms are 64-bit hashes of words.

Search. A benchmark item gives a window for each run of `window` words, or one window if it is
shorter. The index gives each test term's number of occurrences in the corpus; every window's terms
are put in order from the rarest, and in each shard the rarest term's list, moved by its offset in
the window, is intersected with the next lists in turn. What is left are the places of exact
phrases. With slop > 0 the same walk also finds proximity matches: every word at most slop places
from where the phrase would have it.

Benchmark words are sent to the executors in blocks of about `block_words`, whatever the
benchmark's size; hits of several blocks are joined per document. Items longer than an eighth of a
block are cut to pieces that share window - 1 words, which have the same windows, so no item makes a
block large. Null or wordless texts have no
words, are never hit and give no window; items of null id are left out, as they can't be named.
Repeated item ids count once, and a document id that occurs twice gives two rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .storage import Scratch, small_side

INDEX_SCHEMA = "shard string, doc_ids array<long>, first_word array<long>, terms binary, ends binary, positions binary"


def index_shard(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted terms, the end of each term's list, and all lists one after another."""
    gap = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    lead = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    ends = np.append(lead[1:], len(ordered)) if len(lead) else lead
    return ordered[lead], ends.astype(np.int32), (order + gap[order]).astype(np.int32)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separators: np.ndarray = textkit.PLAIN, shard_bytes: int = 2 << 20) -> DataFrame:
    """The positional index of docs, a row for each shard (INDEX_SCHEMA)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # the same in every attempt: the task's partition and the shard's place in it
        task = TaskContext.get().partitionId()
        for number, (block, data, offsets) in enumerate(textkit.row_blocks(batches, limit=shard_bytes)):
            hashes, first = textkit.words(data, offsets, separators)
            terms, ends, positions = index_shard(hashes, first)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{task}-{number}"]), pa.array([block.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([first.tolist()], pa.list_(pa.int64()))] + [pa.array([x.tobytes()], pa.binary()) for x in (terms, ends, positions)],
                names=["shard", "doc_ids", "first_word", "terms", "ends", "positions"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, INDEX_SCHEMA)


def _item_words(benchmark: DataFrame, id_col: str, text_col: str, separators: np.ndarray, window: int, piece: int) -> DataFrame:
    """(id, piece, words): a row for each item, or for each run of `piece` windows of a longer one."""

    def run(batches):
        for block, data, offsets in textkit.row_blocks(batches):
            hashes, first = textkit.words(data, offsets, separators)
            windows = np.maximum(np.diff(first) - window + 1, np.minimum(np.diff(first), 1))
            many = -(-windows // piece)
            some = np.flatnonzero(many == 1)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([block.column("id").take(pa.array(some)), pa.array(np.zeros(len(some), np.int64)), lists.take(pa.array(some))], names=["id", "piece", "words"])
            for i in np.flatnonzero(many > 1).tolist():
                for number in range(many[i]):  # a batch for each, so that a long item's pieces are not held together
                    own = hashes[first[i] + number * piece : first[i + 1]][: piece + window - 1]
                    yield pa.RecordBatch.from_arrays([block.column("id").slice(i, 1), pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own.view(np.int64)))], names=["id", "piece", "words"])

    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return items.mapInArrow(run, "id string, piece long, words array<long>")


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[str, np.ndarray]]]:
    """The items in blocks of about block_words, one in the driver at a time."""
    total = items.agg(F.sum(F.size("words")).alias("n")).first().n or 0
    count = -(-total // block_words)
    for number in range(count):
        rows = items.where(F.pmod(F.xxhash64("id", "piece"), F.lit(count)) == number).collect()
        if rows:
            yield sorted(((r.id, np.array(r.words, dtype=np.int64).view(np.uint64)) for r in rows), key=lambda x: (x[0], x[1].tolist()))


def _windows(block: list[tuple[str, np.ndarray]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary, windows x words (vocabulary index, -1 where a window is shorter), length and item of each window."""
    vocabulary = np.unique(np.concatenate([w for _, w in block]))
    rows, sizes, owner = [], [], []
    for i, (_, words) in enumerate(block):
        at, n = np.searchsorted(vocabulary, words).astype(np.int32), min(window, len(words))
        grid = np.full((len(words) - n + 1, window), -1, dtype=np.int32)
        grid[:, :n] = np.lib.stride_tricks.sliding_window_view(at, n)
        rows.append(grid)
        sizes.append(np.full(len(grid), n))
        owner.append(np.full(len(grid), i))
    return vocabulary, np.concatenate(rows), np.concatenate(sizes), np.concatenate(owner)


def _frequencies(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences of each vocabulary term in the whole index."""
    known = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        for batch in batches:
            total = np.zeros(len(known.value), dtype=np.int64)
            for terms, ends in zip(batch.column("terms"), batch.column("ends")):
                terms, ends = np.frombuffer(terms.as_buffer(), np.uint64), np.frombuffer(ends.as_buffer(), np.int32)
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, known.value), len(terms) - 1)
                    counts = np.diff(ends, prepend=0)
                    total += np.where(terms[at] == known.value, counts[at], 0)
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["at", "n"])

    out = np.zeros(len(vocabulary), dtype=np.int64)
    # at most a row for each test term of the block
    for row in index.select("terms", "ends").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[row.at] = row.n
    return out


def search_shard(terms, ends, positions, doc_start, doc_end, vocabulary, grid, place, sizes, slop: int = 0):
    """(window, start) of each match. grid and place: vocabulary index and offset in the window, rarest first."""
    none = np.zeros(0, np.int64)
    if not len(terms) or not len(grid):
        return none, none
    at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
    here = terms[at] == vocabulary
    alive = np.flatnonzero((here[grid] | (grid < 0)).all(axis=1))
    if not len(alive):
        return none, none
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    keyed = (np.repeat(np.arange(len(terms)), np.diff(ends, prepend=0)) << 32) | positions
    lead = at[grid[alive, 0]]
    many = ends[lead] - begins[lead]
    who = np.repeat(alive, many)
    inner = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
    start = positions[np.repeat(begins[lead], many) + inner].astype(np.int64) - place[who, 0]
    anchor = start + place[who, 0]
    row = np.searchsorted(doc_start, anchor, "right") - 1
    for j in range(1, grid.shape[1]):
        term, due = grid[who, j], start + place[who, j]
        low = np.maximum(due - slop, doc_start[row])
        high = np.minimum(due + slop, doc_end[row] - 1)
        slot = at[np.maximum(term, 0)].astype(np.int64) << 32
        hit = np.searchsorted(keyed, slot | np.maximum(low, 0))
        ok = (term < 0) | ((high >= low) & (hit < len(keyed)) & (keyed[np.minimum(hit, len(keyed) - 1)] <= (slot | np.maximum(high, 0))))
        who, start, row = who[ok], start[ok], row[ok]
    return who, start


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, slop: int = 0, separators: np.ndarray = textkit.PLAIN, block_words: int = 500_000, index: DataFrame | None = None) -> DataFrame:
    """A row for each document: id_col, n_words, hits (hit word numbers from 0, sorted), items (ids with an exact window), near_items.

    near_items holds the items with a window matched within slop (the exact ones among them); it is
    empty with slop 0. An index that was stored before can be given instead of building one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leakage")
    built = index is None
    if built:
        index = scratch.save(build_index(docs, id_col, text_col, separators), "index")
    items = scratch.save(_item_words(benchmark, item_col, item_text_col, separators, window, max(window, block_words // 8)), "items")
    if not built and (items.agg(F.sum(F.size("words")).alias("n")).first().n or 0) > block_words:
        index = scratch.save(index, "kept-index")  # hits of several blocks are joined by shard: each must read the same shards
    schema = f"shard string, ord int, {id_col} long, n_words long, hits array<int>, items array<string>, near_items array<string>"
    parts = None
    for block in _blocks(items, block_words):
        part = _search(index, block, window, slop, schema, id_col)
        parts = part if parts is None else parts.unionByName(part)
        single = parts is part
    if parts is None:
        return _search(index, [], window, slop, schema, id_col).drop("shard", "ord")
    if single:
        return parts.drop("shard", "ord")
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return parts.groupBy("shard", "ord").agg(F.first(id_col).alias(id_col), F.first("n_words").alias("n_words"), *map(merged, ("hits", "items", "near_items"))).drop("shard", "ord")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs, all columns, without those that hold a window of a benchmark item; rows of null id can't be named and stay."""
    scratch = Scratch(docs.sparkSession, "leakage-drop")
    found = decontaminate(docs, benchmark, id_col, text_col, **how)
    hit = scratch.save(found.where(F.size("hits") > 0).select(F.col(id_col).alias("_id")).distinct(), "hit")
    return docs.join(small_side(hit), docs[id_col].cast("long") == hit["_id"], "left_anti")


def _search(index: DataFrame, block: list[tuple[str, np.ndarray]], window: int, slop: int, schema: str, id_col: str) -> DataFrame:
    names = [name for name, _ in block]
    if block:
        vocabulary, grid, sizes, owner = _windows(block, window)
        rarity = np.append(_frequencies(index, vocabulary), np.iinfo(np.int64).max)  # the last is for -1
        order = np.argsort(rarity[grid], axis=1, kind="stable")
        grid = np.take_along_axis(grid, order, axis=1)
        alive = rarity[grid[:, 0]] > 0
        sent = (names, vocabulary, grid[alive], order[alive].astype(np.int32), sizes[alive], owner[alive])
    else:
        none = np.zeros(0, np.int64)
        sent = (names, none.astype(np.uint64), np.zeros((0, window), np.int64), np.zeros((0, window), np.int64), none, none)
    shared = index.sparkSession.sparkContext.broadcast(sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vocabulary, grid, place, sizes, owner = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("doc_ids")[i].values
                n = len(ids)
                first = np.array(batch.column("first_word")[i].values, dtype=np.int64)
                terms, ends, positions = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("terms", np.uint64), ("ends", np.int32), ("positions", np.int32)))
                doc_start = first[:-1] + np.arange(n)
                doc_end = first[1:] + np.arange(n)
                who, start = search_shard(terms, ends, positions, doc_start, doc_end, vocabulary, grid, place, sizes)
                hits, found, near = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
                if len(who):
                    marks = np.zeros(int(doc_end[-1]) + 2, dtype=np.int32)
                    np.add.at(marks, start, 1)
                    np.add.at(marks, start + sizes[who], -1)
                    spots = np.flatnonzero(np.cumsum(marks) > 0)
                    row = np.searchsorted(doc_start, spots, "right") - 1
                    for r in np.unique(row).tolist():
                        hits[r] = spots[row == r] - doc_start[r]
                    for r, o in sorted(set(zip((np.searchsorted(doc_start, start, "right") - 1).tolist(), owner[who].tolist()))):
                        found[r].append(names[o])
                if slop:
                    who, start = search_shard(terms, ends, positions, doc_start, doc_end, vocabulary, grid, place, sizes, slop)
                    if len(who):
                        anchor = start + place[who, 0]
                        for r, o in sorted(set(zip((np.searchsorted(doc_start, anchor, "right") - 1).tolist(), owner[who].tolist()))):
                            near[r].append(names[o])
                listed = lambda x, t: pa.array([sorted(set(y)) if t != pa.int32() else y for y in x], pa.list_(t))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("shard")[i].as_py()] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), ids.cast(pa.int64()), pa.array(np.diff(first)), listed(hits, pa.int32()), listed(found, pa.string()), listed(near, pa.string())],
                    names=["shard", "ord", id_col, "n_words", "hits", "items", "near_items"],
                )

    return index.mapInArrow(run, schema)
