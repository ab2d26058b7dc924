"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates.

Sketch. All distinct shingles of a text are hashed once; the hash's top bits choose one of `bins`
bins and the least hash of each bin is kept (one permutation). Empty bins are filled by optimal
densification: bin j asks the bins that a fixed random sequence of j names until one holds a value,
so equal sets ask equally. Bands of `rows` bins make the buckets: with 128 bins in bands of 4, two
sets of Jaccard similarity 0.8 share no bucket with probability (1 - 0.8^4)^32, about 5e-8.

Candidates. Texts of equal shingle sets first become one class, whose smallest id stands for it.
In each bucket two members are centres (the first and last in one of a few fixed random orders, so
that bands of the same order agree on centres and others add new ones), and only edges from a
centre to a member are candidates: at most two per member and bucket, never all pairs. Edges are
confirmed on full sets and joined to components. Buckets are counted with partial aggregates and
written before they are joined to their members again, so that adaptive execution splits the rows of
a bucket that very many share, and neither side of a join is an aggregate that must stay whole.

The rest. A bucket whose members are then in one component is done. In the few others, pairs of
different components have not all met. Their members are compared in blocks of about `block` shingles
a side, so that no task gets an unbounded bucket, and only by the first bucket that a pair shares.
Sets of any size are at hand as 32-bit hashes: they are counted, which never counts too few, and the
closest pair of each two components that reaches the limit is confirmed on full sets. Where one
fails (two shingles had the same 32 bits), the buckets are compared once more and all pairs that
reach the limit are confirmed. So each pair that shares a bucket is joined already, or confirmed, or
too far; what is lost are pairs that share no bucket. Members that all lie apart in one large bucket
cost as many comparisons as they have pairs, spread over tasks.

Nodes are classes of equal sets, known by the number of one of their rows. Rows that share an id
count as one document, linked with whatever any of its texts is linked with. Rows of null id are
returned with null component and are kept. Null, empty or wordless texts have no shingles and are
linked with nothing. Equal hashes of 64 bits are taken for equal shingles.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit
from .components import components
from .storage import Scratch, small_side


def densify(sig: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row (rows x bins; at least one bin of each row is filled)."""
    bins = sig.shape[1]
    row, col = np.nonzero(~filled)
    turn = 0
    while len(row):
        turn += 1
        donor = (textkit.mix(col.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn * 0x632BE59BD9B4E019 % 2**64)) % np.uint64(bins)).astype(np.int64)
        ok = filled[row, donor]
        sig[row[ok], col[ok]] = sig[row[ok], donor[ok]]
        row, col = row[~ok], col[~ok]
    return sig


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """rows x bins least hashes of sorted sets, none of them empty; bins is a power of two."""
    sizes = np.array([len(s) for s in sets])
    every, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    slot = row * bins + (every >> np.uint64(64 - int(np.log2(bins)))).astype(np.int64)
    lead = np.empty(len(slot), dtype=bool)
    lead[0], lead[1:] = True, slot[1:] != slot[:-1]  # sets are sorted, so the first of a bin is its least
    sig, filled = np.zeros(len(sets) * bins, dtype=np.uint64), np.zeros(len(sets) * bins, dtype=bool)
    sig[slot[lead]], filled[slot[lead]] = every[lead], True
    return densify(sig.reshape(-1, bins), filled.reshape(-1, bins))


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """rows x bands keys; the band's number is part of its key."""
    parts = sig.reshape(len(sig), -1, rows)
    out = np.zeros(parts.shape[:2], dtype=np.uint64) + np.arange(parts.shape[1], dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    for j in range(rows):
        out = textkit.mix(out + parts[:, :, j])
    return out


def _sketcher(k: int, bins: int, rows: int, separators: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for block, data, offsets in textkit.row_blocks(batches):
            hashes, first = textkit.words(data, offsets, separators)
            sets = textkit.shingle_sets(hashes, first, k)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            keys, payload = np.zeros((len(sets), bins // rows), dtype=np.uint64), [b""] * len(sets)
            full = np.flatnonzero(sizes)
            if len(full):
                own = [sets[i] for i in full]
                keys[full] = band_keys(signatures(own, bins), rows)
                for i, x in zip(full.tolist(), own):
                    payload[i] = textkit.mix(x).astype("<u4").tobytes()
            one = np.array([textkit.mix(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], dtype=np.uint64)
            two = np.array([np.bitwise_xor.reduce(textkit.mix(s * np.uint64(0xE7037ED1A0B428DB))) if len(s) else 0 for s in sets], dtype=np.uint64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1).view(np.int64)))
            row = np.arange(number, number + len(sets))
            number += len(sets)
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), block.column("print"), pa.array(row), pa.array(sizes), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), bands, pa.array(payload, pa.binary())],
                names=["id", "print", "row", "n_shingles", "fp1", "fp2", "bands", "small"],
            )

    return run


def _verifier(k: int, percent: int, separators: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, kept = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            left = batch.column("text_a")
            yes, i = [], 0
            for block, data, offsets in textkit.row_blocks(iter([batch]), "text_b"):
                hashes, first = textkit.words(data, offsets, separators)
                for s in textkit.shingle_sets(hashes, first, k):
                    if centre != a[i] or kept is None:
                        one, ptr = textkit.words(*textkit.column_bytes(left.slice(i, 1)), separators)
                        centre, kept = a[i], textkit.shingle_sets(one, ptr, k)[0]
                    shared = len(np.intersect1d(kept, s, assume_unique=True))
                    if 100 * shared >= percent * (len(kept) + len(s) - shared) and shared:
                        yes.append(i)
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in yes], pa.int64()), pa.array([b[i] for i in yes], pa.int64())], names=["a", "b"])

    return run


def _closer(limit: float, closest: bool):
    """Pairs of different components in one block pair of a bucket that reach the limit; with closest, one of each two components."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, labels, own = (np.array(table.column(c)) for c in ("node", "label", "own"))
        bands = np.array(table.column("bands").combine_chunks().flatten()).reshape(len(ids), -1)
        earlier = bands[:, : table.column("band")[0].as_py()]
        same, left = key[1].as_py() == key[2].as_py(), own == key[1].as_py()
        right = left if same else ~left
        lengths = np.array(pc.binary_length(table.column("small")), dtype=np.int64) // 4
        begins = np.cumsum(lengths) - lengths
        _, flat = np.unique(np.frombuffer(b"".join(x.as_buffer() for x in table.column("small")), "<u4"), return_inverse=True)
        flat = flat.astype(np.int32)
        flag = np.zeros(int(flat.max(initial=0)) + 1, dtype=bool)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        pairs: list[tuple[int, int]] = []
        for i in np.flatnonzero(left).tolist():
            at = np.flatnonzero(right & (labels != labels[i]) & ((ids > ids[i]) if same else (ids != ids[i])))
            at = at[np.minimum(lengths[at], lengths[i]) >= limit * np.maximum(lengths[at], lengths[i]) * (1 - 1e-9)]
            at = at[~(earlier[at] == earlier[i]).any(axis=1)]  # the first bucket that a pair shares has it
            if not len(at):
                continue
            own_set = flat[begins[i] : begins[i] + lengths[i]]
            flag[own_set] = True
            run_of = np.repeat(begins[at] - (np.cumsum(lengths[at]) - lengths[at]), lengths[at]) + np.arange(lengths[at].sum())
            shared = np.add.reduceat(flag[flat[run_of]].astype(np.int64), np.cumsum(lengths[at]) - lengths[at])
            flag[own_set] = False
            ratio = shared / np.maximum(lengths[at] + lengths[i] - shared, 1)
            for j, r in zip(at[ratio >= limit - 1e-9].tolist(), ratio[ratio >= limit - 1e-9].tolist()):
                if not closest:
                    pairs.append((ids[i], ids[j]))
                    continue
                both = (min(labels[i], labels[j]), max(labels[i], labels[j]))
                if r > best.get(both, (0.0,))[0]:
                    best[both] = (r, i, j)
        pairs += [(ids[i], ids[j]) for _, i, j in best.values()]
        return pa.table({"a": pa.array([min(p) for p in pairs], pa.int64()), "b": pa.array([max(p) for p in pairs], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bins: int = 128, rows: int = 4, orders: int = 4, block: int = 1_000_000, separators: np.ndarray = textkit.SPACED) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of docs; see the module's text."""
    scratch = Scratch(docs.sparkSession, "near-dup")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("print"))
    sketch = scratch.save(base.mapInArrow(_sketcher(k, bins, rows, separators), "id long, print long, row long, n_shingles long, fp1 long, fp2 long, bands array<long>, small binary"), "sketch")
    with_set = sketch.where("n_shingles > 0 and id is not null")
    least = with_set.groupBy("fp1", "fp2").agg(F.min(F.struct("id", "row", "print")).alias("rep"))
    classes = scratch.save(least.select("fp1", "fp2", F.col("rep.row").alias("node"), F.col("rep.id").alias("id"), F.col("rep.print").alias("print")), "classes")
    reps = sketch.withColumnRenamed("row", "node").join(classes.select("node"), "node", "left_semi")

    spread = reps.select("node", "n_shingles", F.posexplode("bands").alias("band", "key")).select("node", "key", "band", "n_shingles", F.xxhash64("node", F.col("band") % orders).alias("rank"))
    buckets = spread.groupBy("key").agg(F.min_by("node", "rank").alias("lo"), F.max_by("node", "rank").alias("hi"), F.count("*").alias("n"), F.sum("n_shingles").alias("size")).where("lo <> hi")
    buckets = scratch.save(buckets, "buckets")  # adaptive execution splits a bucket's members only where both sides are plain scans
    members = scratch.save(spread.select("node", "key", "band").join(buckets, "key"), "members")
    stars = members.where("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b")).unionByName(members.where("node <> hi and node <> lo and n > 2").select(F.col("hi").alias("a"), F.col("node").alias("b")))
    pairs = scratch.save(stars.distinct(), "pairs")
    # only texts that share a bucket with another are needed from here on
    needed = scratch.save(classes.select("node", "id", "print").join(members.select("node").distinct(), "node"), "needed")
    texts = scratch.save(base.join(small_side(needed), ["id", "print"]).select("node", "text"), "texts")
    if texts.count() > needed.count():  # rows that are equal in id and text
        texts = scratch.save(texts.dropDuplicates(["node"]), "texts-once")
    links = scratch.save(_confirmed(texts, pairs, k, percent, separators), "links-0")
    # buckets of three are done: both centres have met everyone
    crowded = members.where("n > 3").select("key", "band", "node", "size")
    for turn, closest in ((1, True), (2, False)):
        labels = components(links, scratch, f"turn-{turn}")
        named = crowded.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = scratch.save(named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key"), f"mixed-{turn}")
        apart = scratch.save(named.join(mixed, "key", "left_semi"), f"apart-{turn}")
        marks = reps.select("node", "bands", "small").join(apart.select("node").distinct(), "node", "left_semi")
        side = F.ceil(F.col("size") / F.lit(block)).cast("long")
        placed = apart.join(marks, "node").withColumn("own", F.pmod(F.xxhash64("node"), side)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), side - 1)))
        placed = placed.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        near = placed.select("key", "band", "i", "j", "node", "label", "own", "bands", "small").groupBy("key", "i", "j").applyInArrow(_closer(percent / 100, closest), "a long, b long")
        more = scratch.save(near.distinct(), f"more-{turn}")
        asked = more.count()
        if not asked:
            break
        confirmed = scratch.save(_confirmed(texts, more, k, percent, separators), f"confirmed-{turn}")
        links = scratch.save(links.unionByName(confirmed), f"links-{turn}")
        if confirmed.count() == asked:
            break

    own = [F.when(F.col("id").isNotNull(), F.col(c)).alias(c) for c in ("node", "least")]
    rows_of = scratch.save(sketch.select("id", "n_shingles", "fp1", "fp2").join(classes.select("fp1", "fp2", "node", F.col("id").alias("least")), ["fp1", "fp2"], "left").select("id", "n_shingles", *own), "rows")
    twice = rows_of.where("node is not null").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    links = links.unionByName(rows_of.join(twice, "id").select("a", F.col("node").alias("b")))
    labels = components(links, scratch, "last").withColumnRenamed("id", "node")
    roots = labels.join(classes.select("node", "id"), "node").groupBy("label").agg(F.min("id").alias("root"))
    by_node = scratch.save(labels.join(roots, "label").select("node", "root"), "roots")
    scratch.drop("buckets", "members", "pairs", "needed", "texts", "texts-once", *(f"{n}-{t}" for n in ("mixed", "apart", "more", "links", "confirmed") for t in (0, 1, 2)))

    root = F.when(F.col("id").isNotNull(), F.coalesce("root", "least", "id"))
    return rows_of.join(by_node, "node", "left").select(F.col("id").alias(id_col), "n_shingles", root.alias("component_id"), F.coalesce(root == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs, all columns, with the document of least id of each group; of rows that share an id one stays.

    Only the ids to drop are joined to the texts, and they are written first: up to BROADCAST_ROWS
    are broadcast, more are shuffled. Rows of null id all stay.
    """
    scratch = Scratch(docs.sparkSession, "near-dup-drop")
    found = scratch.save(near_duplicates(docs, id_col, text_col, **how).select(F.col(id_col).alias("_id"), "kept"), "found")
    lost = scratch.save(found.where("not kept").select("_id").distinct(), "lost")
    repeated = scratch.save(found.where("kept and _id is not null").groupBy("_id").count().where("count > 1").select("_id"), "repeated")
    rest = docs.join(small_side(lost), docs[id_col].cast("long") == lost["_id"], "left_anti")
    if repeated.limit(1).count():
        twice = rest.join(repeated, rest[id_col].cast("long") == repeated["_id"], "left_semi")
        one = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col), F.monotonically_increasing_id())
        mark = f"rank_{uuid.uuid4().hex}"  # docs may have any column names
        rest = rest.join(repeated, rest[id_col].cast("long") == repeated["_id"], "left_anti").unionByName(twice.withColumn(mark, F.row_number().over(one)).where(F.col(mark) == 1).drop(mark))
    return rest


def _confirmed(texts: DataFrame, pairs: DataFrame, k: int, percent: int, separators: np.ndarray) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verifier(k, percent, separators), "a long, b long").distinct()
