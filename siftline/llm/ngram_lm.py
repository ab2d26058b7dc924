"""Stupid-backoff scores of all documents by the counts of all others.

The corpus is cut to blocks of documents, which are stored as word numbers with the block's own
vocabulary. Each block's distinct n-grams (of 1 to `order` words) are exploded to rows by hash
partition, packed as sorted hashes with their counts (the partition's number and 44 more bits: at
least 48, and more the larger the corpus; stored as steps from one hash to the next). Grouped by partition these make the n-gram count table;
joined back to it, every block gets the corpus count of each of its n-grams. A last join brings a
block's counts to its words, where they are summed per document. An n-gram that is in a third of all
documents is one entry for each block, so no partition gets more than the number of blocks times the
n-grams of its hash range; the number of partitions follows the corpus.

A document's own occurrences are taken off all counts (else nothing would ever back off). The word
after a context of k - 1 words scores f(k-gram) / f(context) if the k-gram is seen elsewhere, else
the discount times the score after the context less its first word; a single word scores
(f(word) + 1) / (N + 1). Scores are natural logarithms: their sum and mean, the number of words, and
of words scored as single words because no longer n-gram was seen.

Null or wordless texts have no words and null scores. Repeated rows are documents of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .storage import Scratch

BLOCK_SCHEMA = "block long, doc_ids array<long>, first array<long>, vocabulary binary, tokens binary"


def _folded(numbers: np.ndarray) -> bytes:
    """Numbers as byte planes, the lowest first, compressed; high planes of small numbers are left out."""
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = 8 if not len(numbers) else max(1, (int(numbers.max()).bit_length() + 7) // 8)
    return bytes([used]) + zlib.compress(np.ascontiguousarray(planes[:used]).tobytes(), 1)


def _unfolded(data) -> np.ndarray:
    raw = memoryview(data)
    planes = np.frombuffer(zlib.decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : raw[0]] = planes.T
    return out.reshape(-1).view("<u8")


#: Low bytes of steps between sorted hashes are noise; they are stored as they are.
NOISE = 4


def _short(grams: np.ndarray, bits: int) -> bytes:
    """Sorted hashes that agree in the first `bits`: the 44 bits after these, as steps from one to the next."""
    steps = np.diff((grams << np.uint64(bits)) >> np.uint64(20), prepend=np.uint64(0))
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return len(grams).to_bytes(4, "little") + np.ascontiguousarray(planes[:NOISE]).tobytes() + zlib.compress(np.ascontiguousarray(planes[NOISE:6]).tobytes(), 1)


def _long(data) -> np.ndarray:
    raw = memoryview(data)
    n = int.from_bytes(raw[:4], "little")
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :NOISE] = np.frombuffer(raw[4 : 4 + NOISE * n], np.uint8).reshape(NOISE, n).T
    out[:, NOISE:6] = np.frombuffer(zlib.decompress(raw[4 + NOISE * n :]), np.uint8).reshape(6 - NOISE, n).T
    return np.cumsum(out.reshape(-1).view("<u8"), dtype=np.uint64)


def _gram_hashes(words: np.ndarray, first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For k = 1 to order: the places where a k-gram of one document begins, and its hash; lengths don't share hashes."""
    end = np.repeat(first[1:], np.diff(first))
    out = []
    for k in range(1, order + 1):
        at = np.flatnonzero(np.arange(len(words)) + k <= end)
        every = textkit.shingles(words, k)
        out.append((at, textkit.mix(every[at] + np.uint64(k)) if len(at) else np.zeros(0, np.uint64)))
    return out


def _blocks(docs: DataFrame, id_col: str, text_col: str, separators: np.ndarray, block_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first_number = TaskContext.get().partitionId() << 32
        for number, (block, data, offsets) in enumerate(textkit.row_blocks(batches, limit=block_bytes), first_number):
            hashes, first = textkit.words(data, offsets, separators)
            vocabulary, tokens, uses = np.unique(hashes, return_inverse=True, return_counts=True)
            # the commonest words have the small numbers; both parts are sorted, so that steps between hashes are small
            common = np.argpartition(-uses, 255)[:256] if len(uses) > 256 else np.arange(len(uses))
            rare = np.ones(len(uses), dtype=bool)
            rare[common] = False
            order = np.concatenate([np.sort(common), np.flatnonzero(rare)])
            renamed = np.empty(len(order), dtype=np.int64)
            renamed[order] = np.arange(len(order))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([block.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([first.tolist()], pa.list_(pa.int64())), pa.array([_folded(np.diff(vocabulary[order], prepend=np.uint64(0)))], pa.binary()), pa.array([_folded(renamed[tokens])], pa.binary())],
                names=["block", "doc_ids", "first", "vocabulary", "tokens"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, BLOCK_SCHEMA)


def _opened(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    vocabulary = np.cumsum(_unfolded(batch.column("vocabulary")[i].as_buffer()), dtype=np.uint64)
    tokens = _unfolded(batch.column("tokens")[i].as_buffer())
    return vocabulary[tokens] if len(tokens) else vocabulary[:0], np.array(batch.column("first")[i].values, dtype=np.int64)


def _exploder(order: int, bits: int):
    """Rows (part, block, grams, counts): a block's distinct n-grams by the top bits of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, first = _opened(batch, i)
                grams, counts = np.unique(np.concatenate([h for _, h in _gram_hashes(words, first, order)]), return_counts=True)
                part = (grams >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
                ends = np.append(cuts[1:], len(part))
                cells = pa.array([_short(grams[a:b], bits) for a, b in zip(cuts, ends)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[cuts]), pa.array([batch.column("block")[i].as_py()] * len(cuts), pa.int64()), cells, pa.array([_folded(counts[a:b]) for a, b in zip(cuts, ends)], pa.binary())],
                    names=["part", "block", "grams", "counts"],
                )

    return run


def _counted(table: pa.Table) -> pa.Table:
    """One hash partition of the count table, joined to the blocks' n-grams."""
    grams = [_long(x.as_buffer()) for x in table.column("grams")]
    counts = np.concatenate([_unfolded(x.as_buffer()) for x in table.column("counts")])
    known, place = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(place, counts, len(known)).astype(np.int64)[place]
    ends = np.cumsum([len(g) for g in grams])
    cells = [_folded(total[e - len(g) : e]) for g, e in zip(grams, ends)]
    return pa.table({"block": table.column("block"), "part": table.column("part"), "totals": pa.array(cells, pa.binary())})


def score_block(words: np.ndarray, first: np.ndarray, totals: np.ndarray, all_words: int, order: int, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """(log score, scored as a single word) of each word; totals: corpus counts of the block's sorted distinct n-grams."""
    found = _gram_hashes(words, first, order)
    hashes, at = np.concatenate([h for _, h in found]), np.concatenate([a for a, _ in found])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    size = np.diff(first)[doc]
    # a stable sort leaves the places of an n-gram in order, so those of one document stand together
    by_gram = np.argsort(hashes, kind="stable")
    ranked, owner = hashes[by_gram], doc[at[by_gram]]
    lead = np.ones(len(ranked), dtype=bool)
    lead[1:] = ranked[1:] != ranked[:-1]
    run = lead.copy()
    run[1:] |= owner[1:] != owner[:-1]
    starts = np.flatnonzero(run)
    own = np.diff(np.append(starts, len(ranked)))
    others = np.empty(len(ranked), dtype=np.int64)
    others[by_gram] = totals[np.cumsum(lead) - 1] - np.repeat(own, own)
    rest, begin = [], 0  # for each k, at each word: the k-gram that begins there, without the document's own
    for places, _ in found:
        out = np.zeros(len(words), dtype=np.int64)
        out[places] = others[begin : begin + len(places)]
        begin += len(places)
        rest.append(out)
    where = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    score = np.log((rest[0] + 1) / (all_words - size + 1))
    alone = np.ones(len(words), dtype=bool)
    for k in range(2, order + 1):
        can = np.flatnonzero(where >= k - 1)
        gram, context = rest[k - 1][can - k + 1], rest[k - 2][can - k + 1]
        seen = gram > 0
        score[can] = np.where(seen, np.log(np.maximum(gram, 1) / np.maximum(context, 1)), score[can] + np.log(discount))
        alone[can[seen]] = False
    return score, alone


def stupid_backoff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, discount: float = 0.4, separators: np.ndarray = textkit.SPACED, block_bytes: int = 3 << 20, part_grams: int = 1_000_000) -> DataFrame:
    """(id_col, n_words, n_alone, log_score, mean_log_score) for every row of docs.

    part_grams: about how many n-grams of the corpus one partition of the count table gets.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-lm")
    blocks = scratch.save(_blocks(docs, id_col, text_col, separators, block_bytes), "blocks")
    all_words = int(blocks.agg(F.sum(F.element_at("first", -1))).first()[0] or 0)
    bits = max(4, int(np.ceil(np.log2(max(1, all_words * order / part_grams)))))
    exploded = blocks.mapInArrow(_exploder(order, bits), "part long, block long, grams binary, counts binary")
    joined = scratch.save(exploded.groupBy("part").applyInArrow(_counted, "block long, part long, totals binary"), "totals")
    by_block = joined.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "totals"))).alias("parts"))
    ready = blocks.join(by_block, "block", "left").select("doc_ids", "first", "vocabulary", "tokens", F.col("parts.totals").alias("totals"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, first = _opened(batch, i)
                n = np.diff(first)
                total, alone = np.zeros(len(n)), np.zeros(len(n), np.int64)
                if len(words):
                    counts = np.concatenate([_unfolded(x.as_buffer()) for x in batch.column("totals")[i].values]).astype(np.int64)
                    score, single = score_block(words, first, counts, all_words, order, discount)
                    doc = np.repeat(np.arange(len(n)), n)
                    total, alone = np.bincount(doc, score, len(n)), np.bincount(doc, single, len(n)).astype(np.int64)
                empty = n == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[i].values.cast(pa.int64()), pa.array(n), pa.array(alone), pa.array(total, mask=empty), pa.array(total / np.maximum(n, 1), mask=empty)],
                    names=[id_col, "n_words", "n_alone", "log_score", "mean_log_score"],
                )

    return ready.mapInArrow(run, f"{id_col} long, n_words long, n_alone long, log_score double, mean_log_score double")
