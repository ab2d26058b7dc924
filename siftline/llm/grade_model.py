"""Ordinal cumulative-link regression on graded ratings over hashed text.

Features. Runs of letters and digits, their first bytes, and runs of other signs are hashed into `buckets`; a text's
value in a bucket is 1 + log of the bucket's count. Two shares, each cut to tenths, are features as
well: of word pairs that repeat an earlier pair of the text, and of sign runs to words. Whole texts
are read. All buckets take part in the fit. A bucket has a weight other than zero if its presence in
texts of the top grade and in the others differs by more than the universal threshold, sqrt(2 ln
buckets) standard errors, which is about the largest difference that as many buckets of pure noise
show; there is no bound on how many do.

Model. One weight vector w is shared by all grades, and thresholds t_1 < t_2 < ... give
P(grade >= j) = sigmoid(w x - t_j). Gaps between thresholds are kept positive by fitting their
logarithms. The fit sees at most `max_labelled` labelled rows, those of the least id hashes; of
these a fifth is held out, to choose the probability from which a text is selected. Scoring is
one pass over all rows without a shuffle.

Labels that are null or not in docs are left out; without any two grades among them the model
gives every text the same probability and keeps it. Null texts are empty. Repeated label rows
count as often as they occur; of a document id with several texts the least text is rated, and each
row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .storage import Scratch, ship

#: ASCII signs other than letters, digits, white space and control characters
SIGNS = np.zeros(256, dtype=bool)
SIGNS[33:127] = True
SIGNS &= ~textkit.PLAIN


#: bytes of a word's beginning that are a feature of their own
HEAD = 5


def bucket_counts(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of all non-zero features, sorted by row and bucket."""
    rows, slots, n = [], [], len(offsets) - 1
    place = lambda hashes, salt: (textkit.mix(hashes.astype(np.uint64) + np.uint64(salt)) % np.uint64(buckets)).astype(np.int64)
    sizes = []
    for salt, table in ((0, textkit.PLAIN), (1, SIGNS)):
        hashes, first = textkit.words(data, offsets, table)
        rows.append(np.repeat(np.arange(n), np.diff(first)))
        slots.append(place(hashes, salt))
        sizes.append(np.diff(first))
        if salt == 0:
            inside = rows[0][1:] == rows[0][:-1] if len(hashes) else np.zeros(0, bool)
            at, pair = rows[0][1:][inside], textkit.shingles(hashes, 2)[inside]
            order = np.lexsort((pair, at))
            at, pair = at[order], pair[order]
            again = np.bincount(at[1:][(at[1:] == at[:-1]) & (pair[1:] == pair[:-1])], minlength=n)
            rows.append(rows[0])
            slots.append(place(textkit.words(data, offsets, table, HEAD)[0], 1 << 48))
    full = np.flatnonzero(sizes[0] > 0)
    for salt, share in ((2, again / np.maximum(sizes[0] - 1, 1)), (3, sizes[1] / np.maximum(sizes[0], 1))):
        rows.append(full)
        slots.append(place(np.minimum(share[full] * 10, 10).astype(np.int64), salt << 40))
    key, count = np.unique(np.concatenate(rows) * buckets + np.concatenate(slots), return_counts=True)
    return key // buckets, key % buckets, 1 + np.log(count)


def _bucket_totals(rated: DataFrame, buckets: int, top: int) -> DataFrame:
    """(bucket, in_top, in_low): of the rated texts that have a feature, those of the top grade and the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in textkit.row_blocks(batches):
            row, slot, _ = bucket_counts(data, offsets, buckets)
            best = np.array(block.column("grade")) == top
            seen, place = np.unique(slot, return_inverse=True)
            high = np.bincount(place[best[row]], minlength=len(seen))
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(high), pa.array(np.bincount(place, minlength=len(seen)) - high)], names=["bucket", "in_top", "in_low"])

    return rated.select("grade", "text").mapInArrow(run, "bucket long, in_top long, in_low long").groupBy("bucket").agg(F.sum("in_top").alias("in_top"), F.sum("in_low").alias("in_low"))


def parting_buckets(rated: DataFrame, buckets: int, top: int) -> np.ndarray:
    """The buckets whose presence differs between the top grade and the others by more than the universal threshold, sorted."""
    sizes = rated.agg(F.count(F.when(F.col("grade") == top, 1)).alias("t"), F.count(F.when(F.col("grade") != top, 1)).alias("l")).first()
    n_top, n_low = max(sizes.t, 1), max(sizes.l, 1)
    both = (F.col("in_top") + F.col("in_low")) / float(sizes.t + sizes.l or 1)
    spread = F.sqrt(both * (1 - both) * (1 / n_top + 1 / n_low) + F.lit(1e-9))
    apart = F.abs(F.col("in_top") / n_top - F.col("in_low") / n_low) / spread
    far = _bucket_totals(rated, buckets, top).where(apart > float(np.sqrt(2 * np.log(buckets)))).select("bucket")
    return np.array(sorted(r.bucket for r in far.collect()), dtype=np.int64)  # buckets numbers at most, whatever the input


def _packed(rated: DataFrame, buckets: int, chosen: np.ndarray) -> DataFrame:
    """grade, held and the chosen features of each row as packed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in textkit.row_blocks(batches):
            row, slot, value = bucket_counts(data, offsets, buckets)
            row, slot, value = _only(chosen, row, slot, value)
            ends = np.searchsorted(row, np.arange(block.num_rows + 1))
            cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([block.column("id"), block.column("grade"), block.column("held"), cut(slot.astype("<u4")), cut(value.astype("<f4"))], names=["id", "grade", "held", "slots", "values"])

    return rated.select("id", "grade", "held", "text").mapInArrow(run, "id long, grade int, held boolean, slots binary, values binary")


def _only(chosen: np.ndarray, row: np.ndarray, slot: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features in chosen buckets, by their place in chosen."""
    if not len(chosen):
        return row[:0], slot[:0], value[:0]
    at = np.minimum(np.searchsorted(chosen, slot), len(chosen) - 1)
    mine = chosen[at] == slot
    return row[mine], at[mine], value[mine]


def ordered(theta: np.ndarray) -> np.ndarray:
    """The thresholds: the first, and the others by the logarithms of the gaps between them."""
    return np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:]))])


class OrdinalModel:
    """Shared weights and ordered thresholds, fitted by Adam on the cumulative log-likelihood."""

    def __init__(self, chosen: np.ndarray, buckets: int = 1 << 18, grades: int = 3, ridge: float = 1e-5, steps: int = 600, rate: float = 0.1):
        self.chosen, self.buckets, self.grades, self.ridge, self.steps, self.rate = chosen, buckets, grades, ridge, steps, rate
        self.weights, self.thresholds, self.least = np.zeros(max(1, len(chosen))), np.linspace(-2, -1, grades - 1), 0.0

    def fit(self, row: np.ndarray, slot: np.ndarray, value: np.ndarray, grade: np.ndarray) -> OrdinalModel:
        n, k = len(grade), self.grades - 1
        if n == 0 or grade.min() == grade.max():
            return self
        share = [np.clip((grade > j).mean(), 0.01, 0.99) for j in range(k)]
        start = np.array([np.log((1 - s) / s) for s in share])
        low, gaps = start[0], np.log(np.maximum(np.diff(start), 0.1))
        size = len(self.weights)
        w, theta = np.zeros(size), np.concatenate([[low], gaps])
        moments = [np.zeros(size), np.zeros(size), np.zeros(k), np.zeros(k)]
        sure = np.clip([np.mean(grade == j) for j in range(self.grades)], 1e-6, 1)
        weight = (1 / np.sqrt(sure))[grade]
        weight /= weight.mean()
        for step in range(1, self.steps + 1):
            _, gw, gt = self.loss(w, theta, row, slot, value, grade, weight)
            for g, x, m, v in ((gw, w, moments[0], moments[1]), (gt, theta, moments[2], moments[3])):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        self.weights, self.thresholds = w, ordered(theta)
        return self

    def loss(self, w: np.ndarray, theta: np.ndarray, row: np.ndarray, slot: np.ndarray, value: np.ndarray, grade: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The weighted mean of -log P(grade) with the ridge, and its gradients by w and theta (the first threshold, the logarithms of the gaps)."""
        n, k = len(grade), len(theta)
        z = np.bincount(row, value * w[slot], n)
        p = 1 / (1 + np.exp(np.clip(ordered(theta)[None, :] - z[:, None], -30, 30)))  # P(grade > j)
        above = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        likely = np.maximum(above[np.arange(n), grade] - above[np.arange(n), grade + 1], 1e-9)
        slope = above * (1 - above)
        dz = -(slope[np.arange(n), grade] - slope[np.arange(n), grade + 1]) / likely * weight / n
        dt = np.zeros(k)
        for j in range(k):
            dt[j] = (weight / n * (slope[:, j + 1] * (grade == j + 1) - slope[:, j + 1] * (grade == j)) / likely).sum()
        gw = np.bincount(slot, value * dz[row], len(w)) + self.ridge * w
        gt = np.concatenate([[dt.sum()], [dt[j:].sum() * np.exp(theta[j]) for j in range(1, k)]])
        return float(-(weight * np.log(likely)).mean() + self.ridge / 2 * (w * w).sum()), gw, gt

    def tails(self, row: np.ndarray, slot: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """P(grade >= 1), ..., P(grade >= top) for each of n rows; slots are places in chosen."""
        z = np.bincount(row, value * self.weights[slot], n) if len(row) else np.zeros(n)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -30, 30)))

    def text_tails(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.tails(*_only(self.chosen, *bucket_counts(data, offsets, self.buckets)), len(offsets) - 1)

    def choose_least(self, tail: np.ndarray, good: np.ndarray, keep_share: float) -> None:
        """The probability that parts good from other held-out rows best, but keeps at least keep_share of the good."""
        if not good.any() or good.all():
            return
        order = np.argsort(tail, kind="stable")
        lost = np.cumsum(good[order]) / good.sum()
        caught = np.cumsum(~good[order]) / (~good).sum()
        worth = np.where(lost <= 1 - keep_share, caught - lost, -1)
        best = int(worth.argmax())
        if worth[best] > 0:
            self.least = float((tail[order[best]] + tail[order[min(best + 1, len(order) - 1)]]) / 2)


def fit_grades(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_grades: int = 3, buckets: int = 1 << 18, max_labelled: int = 12_000, keep_share: float = 0.98) -> OrdinalModel:
    """Fit on the rows of grades (id, grade from 0) whose id is in docs."""
    scratch = Scratch(docs.sparkSession, "grades")
    sample = grades.where("id is not null and grade is not null").orderBy(F.xxhash64("id"), "id", "grade").limit(max_labelled)
    sample = sample.withColumn("held", F.pmod(F.xxhash64("id", F.lit("held")), F.lit(5)) == 0)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sample = scratch.save(sample, "sample")  # max_labelled rows at most
    once = texts.join(F.broadcast(sample.select("id").distinct()), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    rated = scratch.save(once.join(F.broadcast(sample), "id"), "rated")
    chosen = parting_buckets(rated.where("not held"), buckets, n_grades - 1)
    model = OrdinalModel(chosen, buckets, n_grades)
    rows = sorted(_packed(rated, buckets, chosen).collect(), key=lambda r: (r.id, r.grade, bytes(r.slots)))  # of max_labelled rows at most, the buckets that part grades
    scratch.drop("rated", "sample")
    if not rows:
        return model
    slots = [np.frombuffer(r.slots, "<u4").astype(np.int64) for r in rows]
    values = [np.frombuffer(r["values"], "<f4").astype(np.float64) for r in rows]
    grade, held = np.array([r.grade for r in rows]), np.array([r.held for r in rows])

    def part(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return np.repeat(np.arange(len(at)), [len(slots[i]) for i in at]), np.concatenate([slots[i] for i in at]), np.concatenate([values[i] for i in at])

    seen, out = np.flatnonzero(~held), np.flatnonzero(held)
    model.fit(*part(seen), grade[seen])
    if len(out):
        model.choose_least(model.tails(*part(out), len(out))[:, -1], grade[out] == n_grades - 1, keep_share)
    return model


def score_grades(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, expected_grade, tail_probability, keep) for every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for block, data, offsets in textkit.row_blocks(batches):
            tails = model.text_tails(data, offsets)
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= model.least)], names=[id_col, "expected_grade", "tail_probability", "keep"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} long, expected_grade double, tail_probability double, keep boolean")


def select_graded(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose probability of the top grade is high enough."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in textkit.row_blocks(batches, text_col):
            tails = shared.value.text_tails(data, offsets)
            yield block.filter(pa.array(tails[:, -1] >= shared.value.least))

    return docs.mapInArrow(run, docs.schema)


def graded(labels: DataFrame, quality: Column, toxic: Column, id_col: str = "doc_id") -> DataFrame:
    """Ratings 0 to 2 from the two labels: 2 good and not toxic, 1 one of the two, 0 neither."""
    return labels.select(F.col(id_col).cast("long").alias("id"), (quality.cast("int") + F.lit(1) - toxic.cast("int")).alias("grade"))
