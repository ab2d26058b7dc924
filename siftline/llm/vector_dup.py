"""Near-duplicate vectors over a robust-pruned flat graph.

Equal vectors of a label become one class, so copies cost nothing. Each label's classes are cut to
cluster shards: a shard over `shard_size` is split by centroids (fitted on a sample of `sample` rows of
it), again and again until it is small or splitting no longer helps. Shards overlap: a vector goes to
its nearest centroid's shard, its home, and to every other whose dividing plane is within the
distance that the cosine limit allows, so that all its partners are in its home shard.

In each shard a graph is built: of each node's nearest, robust pruning keeps the closest and drops
what one already kept is closer to (by the factor alpha); a few random nodes are kept besides, as
clusters that lie far apart have no other links. Lists of all shards, with their reverse links, are
joined per node. The search runs each home vector from the shard's medoids and, as it is in the graph
itself, from its own node: a greedy beam, and then a range expansion that follows every node near the
limit until nothing new is in range. Searches of `audits` vectors that have partners are audited against
all vectors of the shard, each with its own recall: vectors are drawn until so many with partners are
found, or none is left. Below a mean of `least_recall` the beam is doubled and the shard searched
again, up to the whole shard; if that falls short too, the shard is searched by brute force in blocks,
so that no result is of less than `least_recall` on its audit; audit_recall says what was reached. So is a
shard at once if audited vectors are linked with a tenth of it on average. Links
are what has a cosine of at least the limit in double precision. A shard writes counts and one edge
for each linked vector, not its pairs; components are joined over those edges.

A shard that no longer gets smaller and is over `shard_size` is a dense group, in which nearly all
vectors may be linked with all. It gets no graph: it is compared exactly, in pairs of blocks of about
`block` vectors, each in a task of its own.

Nodes are classes, known by a number of their own. Rows that share an id are vectors of their own in
one component. Null labels, and vectors that are null, empty, zero or hold null or non-finite values,
link with nothing; vectors of different length don't link. Rows of null id are returned without
component and link with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import Scratch, small_side


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(column) -> np.ndarray:
    parts = [np.frombuffer(x, np.float64) for x in column.to_pylist()]
    return np.stack(parts)


def nearest(x: np.ndarray, k: int, step: int = 512) -> np.ndarray:
    """n x k: the rows of largest inner product with each row, itself left out."""
    out = np.empty((len(x), k), dtype=np.int64)
    for at in range(0, len(x), step):
        sims = x[at : at + step] @ x.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -np.inf
        out[at : at + step] = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < len(x) else np.argsort(-sims, axis=1)[:, :k]
    return out


def robust_prune(x: np.ndarray, candidates: np.ndarray, degree: int, alpha: float, step: int = 256) -> np.ndarray:
    """n x degree of kept candidates, -1 where there are fewer."""
    out = np.full((len(x), degree), -1, dtype=np.int64)
    for at in range(0, len(x), step):
        own, cand = x[at : at + step], candidates[at : at + step]
        near = x[cand]
        to_own = 2 - 2 * np.einsum("nd,ncd->nc", own, near)
        order = np.argsort(to_own, axis=1, kind="stable")
        cand, to_own = np.take_along_axis(cand, order, 1), np.take_along_axis(to_own, order, 1)
        near = x[cand]
        between = 2 - 2 * np.einsum("nad,nbd->nab", near, near)
        open_ = np.ones(cand.shape, dtype=bool)
        open_[:, 1:] &= cand[:, 1:] != cand[:, :-1]
        row = np.arange(len(own))
        for j in range(degree):
            best = open_.argmax(axis=1)
            some = open_[row, best]
            out[at + row[some], j] = cand[row[some], best[some]]
            open_[row, best] = False
            covered = alpha**2 * between[row, best] <= to_own
            open_ &= ~(covered & some[:, None])
            if not open_.any():
                break
    return out


def build_lists(x: np.ndarray, degree: int = 24, width: int = 48, alpha: float = 1.2, far: int = 4, seed: int = 11) -> np.ndarray:
    """n x (degree + far) rows that each row is linked with, -1 where there are fewer."""
    n = len(x)
    if n <= 1:
        return np.full((n, 1), -1, dtype=np.int64)
    kept = robust_prune(x, nearest(x, min(width, n - 1)), degree, alpha)
    drawn = np.random.default_rng(seed).integers(0, n, (n, far))
    return np.concatenate([kept, np.where(drawn == np.arange(n)[:, None], (drawn + 1) % n, drawn)], axis=1)


def medoids(x: np.ndarray, count: int = 4) -> np.ndarray:
    """The row nearest to the mean, and rows far from those already taken."""
    out = [int((x @ x.mean(axis=0)).argmax())]
    close = x @ x[out[0]]
    while len(out) < min(count, len(x)):
        out.append(int(close.argmin()))
        close = np.maximum(close, x @ x[out[-1]])
    return np.unique(out)


def all_in_range(x: np.ndarray, queries: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """What range_search looks for, by brute force: for as many queries as fit in memory with all rows."""
    a, r = np.nonzero(x[queries] @ x.T >= limit - 1e-9)
    a, r = a[r != queries[a]], r[r != queries[a]]
    here = np.concatenate([np.einsum("nd,nd->n", x[queries[a[i : i + 100_000]]], x[r[i : i + 100_000]]) >= limit for i in range(0, len(a), 100_000)] or [np.zeros(0, dtype=bool)])
    return a[here], r[here]


def audited(x: np.ndarray, asks: np.ndarray, limit: float, audits: int, step: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Up to `audits` of asks that have partners, drawn at random, and the partners of each; fewer only if no more have any."""
    asks = np.random.default_rng(5).permutation(asks)
    queries, partners = [], []
    for at in range(0, len(asks), step):
        some = asks[at : at + step]
        a, r = all_in_range(x, some, limit)
        for i in np.unique(a)[: audits - len(queries)]:
            queries.append(some[i])
            partners.append(r[a == i])
        if len(queries) >= audits:
            break
    return np.array(queries, dtype=np.int64), partners


def mean_recall(n: int, partners: list[np.ndarray], a: np.ndarray, r: np.ndarray) -> float:
    """Of the audited queries, each counted alike however many partners it has; of n rows."""
    kept = np.isin(a * n + r, np.concatenate([i * n + p for i, p in enumerate(partners)]))
    got = np.bincount(a[kept], minlength=len(partners))
    return float(np.mean(got / np.array([len(p) for p in partners])))


def range_search(x: np.ndarray, lists: np.ndarray, starts: np.ndarray, queries: np.ndarray, limit: float, beam: int, slack: float = 0.03) -> tuple[np.ndarray, np.ndarray]:
    """(place in queries, row) of all rows found with an inner product of at least limit, the query itself left out."""
    n, q = len(x), len(queries)
    beam = min(beam, n)
    seen, expanded = np.zeros((q, n), dtype=bool), np.zeros((q, n), dtype=bool)
    ids = np.full((q, beam), -1, dtype=np.int64)
    sims = np.full((q, beam), -np.inf)
    done = np.ones((q, beam), dtype=bool)
    m = min(len(starts), beam)
    ids[:, :m], sims[:, :m], done[:, :m] = starts[:m], x[queries] @ x[starts[:m]].T, False
    seen[:, starts[:m]] = True
    found_q, found_r = [], []

    def note(a, r, s):
        hit = s >= limit
        found_q.append(a[hit])
        found_r.append(r[hit])

    note(np.repeat(np.arange(q), m), np.tile(starts[:m], q), sims[:, :m].reshape(-1))
    near = sims[:, :m] >= limit - slack
    frontier: list[tuple[np.ndarray, np.ndarray]] = [(np.nonzero(near)[0], starts[:m][np.nonzero(near)[1]]), (np.arange(q), queries)]
    seen[np.arange(q), queries] = True
    while True:
        ahead = np.where(done, -np.inf, sims)
        pick = ahead.argmax(axis=1)
        active = np.flatnonzero(ahead[np.arange(q), pick] > -np.inf)
        if not len(active):
            break
        done[active, pick[active]] = True
        node = ids[active, pick[active]]
        expanded[active, node] = True
        beside = lists[node]
        a, j = np.nonzero((beside >= 0) & ~seen[active[:, None], np.maximum(beside, 0)])
        row, new = active[a], beside[a, j]
        s = np.einsum("nd,nd->n", x[queries[row]], x[new])
        seen[row, new] = True
        note(row, new, s)
        near = s >= limit - slack
        frontier.append((row[near], new[near]))
        more_ids, more_sims = np.full(beside.shape, -1, dtype=np.int64), np.full(beside.shape, -np.inf)
        more_ids[a, j], more_sims[a, j] = new, s
        all_ids = np.concatenate([ids[active], more_ids], axis=1)
        all_sims = np.concatenate([sims[active], more_sims], axis=1)
        all_done = np.concatenate([done[active], more_sims == -np.inf], axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[active], sims[active], done[active] = (np.take_along_axis(v, top, 1) for v in (all_ids, all_sims, all_done))
    front_q = np.concatenate([f[0] for f in frontier]) if frontier else np.zeros(0, np.int64)
    front_r = np.concatenate([f[1] for f in frontier]) if frontier else np.zeros(0, np.int64)
    while len(front_q):
        fresh = ~expanded[front_q, front_r]
        front_q, front_r = front_q[fresh], front_r[fresh]
        expanded[front_q, front_r] = True
        next_q, next_r = [], []
        for at in range(0, len(front_q), 20_000):
            a, beside = front_q[at : at + 20_000], lists[front_r[at : at + 20_000]]
            i, j = np.nonzero((beside >= 0) & ~seen[a[:, None], np.maximum(beside, 0)])
            pair = np.unique(a[i] * n + beside[i, j])
            row, new = pair // n, pair % n
            s = np.einsum("nd,nd->n", x[queries[row]], x[new])
            seen[row, new] = True
            note(row, new, s)
            near = s >= limit - slack
            next_q.append(row[near])
            next_r.append(new[near])
        front_q, front_r = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (next_q, next_r))
    a, r = np.concatenate(found_q), np.concatenate(found_r)
    other = r != queries[a]
    return a[other], r[other]


_ROW = "node long, weight long, vec binary, shard string, home boolean"


def _moved(rows: DataFrame, reach: float) -> DataFrame:
    """Rows with their shard's centroids (mids, null where it isn't split) moved to child shards; was: the shard's size before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, mids = batch.column("shard").to_pylist(), batch.column("mids")
            home, n = np.array(batch.column("home")), batch.column("n")
            take, names, homes = [], [], []
            by_shard: dict[str, list[int]] = {}
            for i, shard in enumerate(shards):
                by_shard.setdefault(shard, []).append(i)
            for shard, places in by_shard.items():
                at = np.array(places)
                if not mids[places[0]].is_valid:
                    take += places
                    names += [shard] * len(at)
                    homes += home[at].tolist()
                    continue
                x = _unit(_vectors(batch.column("vec").take(pa.array(at))))
                mid = np.frombuffer(mids[places[0]].as_buffer(), np.float64).reshape(-1, x.shape[1])
                # squared distances but for the vector's own length, which is the same for all centroids
                far = (mid * mid).sum(axis=1) - 2 * (x @ mid.T)
                own = far.argmin(axis=1)
                gap = np.sqrt(((mid[:, None, :] - mid[None, :, :]) ** 2).sum(axis=2))[own]
                inside = far - far[np.arange(len(at)), own][:, None] <= 2 * gap * reach + 1e-12  # rounding may only add
                inside[np.arange(len(at)), own] = True
                r, c = np.nonzero(inside)
                take += at[r].tolist()
                names += [f"{shard}.{k}" for k in c.tolist()]
                homes += (home[at[r]] & (own[r] == c)).tolist()
            kept = pa.array(take, pa.int64())
            moved = batch.take(kept)
            yield pa.RecordBatch.from_arrays([moved.column("node"), moved.column("weight"), moved.column("vec"), pa.array(names, pa.string()), pa.array(homes, pa.bool_()), n.take(kept)], names=["node", "weight", "vec", "shard", "home", "was"])

    return rows.select("node", "weight", "vec", "shard", "home", "mids", "n").mapInArrow(run, f"{_ROW}, was long")


def _centroids(x: np.ndarray, k: int, turns: int = 8) -> np.ndarray:
    x = _unit(x)
    mid = x[medoids(x, k)]
    for _ in range(turns):
        own = (x @ mid.T - 0.5 * (mid * mid).sum(axis=1)).argmax(axis=1)
        mid = np.stack([x[own == i].mean(axis=0) if (own == i).any() else mid[i] for i in range(len(mid))])
    return mid


def cluster_shards(classes: DataFrame, scratch: Scratch, limit: float, shard_size: int, sample: int, split: int = 8, levels: int = 8) -> DataFrame:
    """(node, weight, vec, shard, home) from classes with a first shard for each label.

    Centroids are fitted by shard, from about sample rows of it, in a task of its own, and joined to
    the shard's rows. A shard is done when it is small, or nearly as large as the one that it was cut
    from. Only whether any shard is left comes to the driver.
    """
    reach = float(np.sqrt(2 - 2 * limit)) * (1 + 1e-9)

    def fit(table: pa.Table) -> pa.Table:
        want = min(split, max(2, -(-2 * table.column("n")[0].as_py() // shard_size)))
        x = _vectors(table.column("vec"))
        mids = _centroids(x, want).tobytes() if len(x) > split else None
        return pa.table({"shard": table.column("shard").slice(0, 1), "mids": pa.array([mids], pa.binary())})

    placed = scratch.save(classes.select("node", "weight", "vec", "shard", "home", F.lit(False).alias("done")), "placed-0")
    for level in range(1, levels + 1):
        sizes = scratch.save(placed.where("not done").groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > shard_size), f"sizes-{level}")
        if not sizes.limit(1).count():
            break
        drawn = placed.where("not done").join(small_side(sizes), "shard")
        drawn = drawn.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) * F.col("n") < F.lit(sample << 20))
        centroids = scratch.save(drawn.select("shard", "n", "vec").groupBy("shard").applyInArrow(fit, "shard string, mids binary").where("mids is not null"), f"centroids-{level}")
        split_up = centroids.join(sizes, "shard")
        moved = scratch.save(_moved(placed.where("not done").join(split_up, "shard", "left"), reach), f"moved-{level}")
        now = moved.groupBy("shard").agg(F.count("*").alias("now"))
        # not split, small enough, or a child nearly as large as its parent
        over = F.col("was").isNull() | (F.col("now") <= shard_size) | (F.col("now") > 0.7 * F.col("was"))
        done = moved.join(now, "shard").select("node", "weight", "vec", "shard", "home", over.alias("done"))
        new = scratch.save(placed.where("done").unionByName(done), f"placed-{level}")
        scratch.drop(f"placed-{level - 1}", f"moved-{level}")
        placed = new
    return placed.drop("done")


def encoded(lists: pa.ListArray, wanted: np.ndarray) -> pa.Array:
    """Each list of doubles as bytes; null where it is not wanted, empty, all zero, or holds null or non-finite values."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = pc.fill_null(lists.values, float("nan")).to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    size = np.abs(values)
    filled = np.flatnonzero(np.diff(offsets))
    largest = np.zeros(len(lists))
    if len(filled):
        largest[filled] = np.maximum.reduceat(size, offsets[filled])  # nan if there is one
    sound = wanted & np.isfinite(largest) & (largest > 0) & np.array(lists.is_valid())
    odd = sound & ((largest > 1e100) | (largest < 1e-100))
    if odd.any():  # squares must stay finite
        values = values / np.repeat(np.where(odd, largest, 1.0), np.diff(offsets))
    cells = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets * 8), pa.py_buffer(np.ascontiguousarray(values, dtype="<f8"))])
    return pc.if_else(pa.array(sound), cells, pa.scalar(None, pa.large_binary())).cast(pa.binary())


def compared(x: np.ndarray, asks: np.ndarray, others: np.ndarray, limit: float, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of asks, row of others) of all pairs in range, for some of asks at a time; a row is no partner of itself."""
    for at in range(0, len(asks), step):
        some = asks[at : at + step]
        a, r = np.nonzero(x[some] @ x[others].T >= limit - 1e-9)
        a, r = some[a], others[r]
        a, r = a[a != r], r[a != r]
        here = np.concatenate([np.einsum("nd,nd->n", x[a[i : i + 100_000]], x[r[i : i + 100_000]]) >= limit for i in range(0, len(a), 100_000)] or [np.zeros(0, dtype=bool)])
        yield a[here], r[here]


_FOUND = "node long, n_links long, recall double, other long"


def _found(node: np.ndarray, asks: np.ndarray, counts: np.ndarray, recall: float, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """A row with the count of each of asks, and a row for each edge."""
    k, none = len(asks), pa.nulls
    return pa.table(
        {
            "node": pa.array(node[np.concatenate([asks, a])], pa.int64()),
            "n_links": pa.concat_arrays([pa.array(counts, pa.int64()), none(len(a), pa.int64())]),
            "recall": pa.concat_arrays([pa.array(np.full(k, recall)), none(len(a), pa.float64())]),
            "other": pa.concat_arrays([none(k, pa.int64()), pa.array(node[b], pa.int64())]),
        }
    )


def near_duplicate_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", limit: float = 0.93, shard_size: int = 8000, sample: int = 2000, degree: int = 24, beam: int = 48, alpha: float = 1.2, least_recall: float = 0.995, audits: int = 64, queries_per_task: int = 4000, block: int = 3000) -> DataFrame:
    """(id_col, n_links, component_id, kept, audit_recall) for every row; see the module's text. audit_recall is null for rows that link with nothing by definition."""
    scratch = Scratch(rows.sparkSession, "vector-dup")
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = np.array(pc.and_(batch.column("id").is_valid(), batch.column("label").is_valid()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), encoded(batch.column("v"), wanted)], names=["id", "label", "vec"])

    coded = scratch.save(base.mapInArrow(encode, "id long, label string, vec binary"), "coded")
    shard = F.concat_ws("|", F.lit("s"), F.length("vec"), F.hex("label"))
    classes = coded.where("vec is not null").groupBy("label", "vec").agg(F.min("id").alias("least"), F.count("*").alias("weight"))
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    shards = cluster_shards(classes.select("node", "weight", "vec", shard.alias("shard"), F.lit(True).alias("home")), scratch, limit, shard_size, sample)
    sizes = scratch.save(shards.groupBy("shard").agg(F.count("*").alias("n")), "shard-sizes")
    sized = shards.join(small_side(sizes), "shard")
    light, dense = sized.where(F.col("n") <= shard_size), sized.where(F.col("n") > shard_size)

    def build(table: pa.Table) -> pa.Table:
        node = np.array(table.column("node"))
        lists = build_lists(_unit(_vectors(table.column("vec"))), degree, 2 * degree, alpha)
        a, j = np.nonzero(lists >= 0)
        b = lists[a, j]
        return pa.table({"node": pa.array(node[np.concatenate([a, b])]), "next": pa.array(node[np.concatenate([b, a])])})

    links = light.select("shard", "node", "vec").groupBy("shard").applyInArrow(build, "node long, next long")
    lists = scratch.save(links.groupBy("node").agg(F.collect_set("next").alias("next")), "lists")
    parts = F.ceil(F.col("n") / F.lit(queries_per_task)).cast("long")
    ready = light.join(lists, "node", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    ready = ready.withColumn("asks", F.col("home") & (F.pmod(F.xxhash64("node"), parts) == F.col("part")))

    def search(table: pa.Table) -> pa.Table:
        x, node, weight = _unit(_vectors(table.column("vec"))), np.array(table.column("node")), np.array(table.column("weight"))
        order = np.argsort(node, kind="stable")
        ranked = node[order]
        nexts = table.column("next").combine_chunks()
        owner, flat = np.repeat(np.arange(len(node)), np.array(pc.fill_null(pc.list_value_length(nexts), 0))), np.array(nexts.flatten(), dtype=np.int64)
        at = np.minimum(np.searchsorted(ranked, flat), len(node) - 1)
        here = (ranked[at] == flat) & (order[at] != owner)  # lists of other shards also name nodes that aren't in this one
        owner, flat = owner[here], order[at[here]]
        degrees = np.bincount(owner, minlength=len(node))
        lists = np.full((len(node), max(1, degrees.max())), -1, dtype=np.int64)
        lists[owner, np.arange(len(owner)) - np.repeat(np.cumsum(degrees) - degrees, degrees)] = flat
        asks, starts = np.flatnonzero(np.array(table.column("asks"))), medoids(x)
        step = max(16, min(512, 8_000_000 // max(1, len(x))))
        drawn, partners = audited(x, asks, limit, audits, min(step, 128))
        # where a vector is linked with a tenth of the shard, following the lists is more work than comparing with all
        exact = len(drawn) > 0 and 10 * float(np.mean([len(p) for p in partners])) > len(x) and len(x) > audits
        width, recall = beam, 1.0
        while len(drawn) and not exact:
            recall = mean_recall(len(x), partners, *range_search(x, lists, starts, drawn, limit, width))
            if recall >= least_recall:
                break
            if width >= len(x):  # what the lists don't reach is never found
                recall, exact = 1.0, True
                break
            width *= 2
        counts, ends_a, ends_b = np.zeros(len(node), np.int64), [], []
        for at in range(0, len(asks), step):
            some = asks[at : at + step]
            a, r = all_in_range(x, some, limit) if exact else range_search(x, lists, starts, some, limit, width)
            counts[some] += np.bincount(a, weight[r], len(some)).astype(np.int64)
            ends_a.append(some[a])
            ends_b.append(r)
            if sum(map(len, ends_a)) > 2_000_000:
                ends_a, ends_b = _spanning(len(node), ends_a, ends_b, node)
        ends_a, ends_b = _spanning(len(node), ends_a, ends_b, node)
        return _found(node, asks, counts[asks] + weight[asks] - 1, recall, ends_a[0], ends_b[0])

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        x, node, weight = _unit(_vectors(table.column("vec"))), np.array(table.column("node")), np.array(table.column("weight"))
        home, own = np.array(table.column("home")), np.array(table.column("own"))
        i, j = key[1].as_py(), key[2].as_py()
        counts, ends_a, ends_b = np.zeros(len(node), np.int64), [], []
        for of, to in {(i, j), (j, i)}:
            for a, r in compared(x, np.flatnonzero(home & (own == of)), np.flatnonzero(own == to), limit, 256):
                counts += np.bincount(a, weight[r], len(node)).astype(np.int64)
                ends_a.append(a)
                ends_b.append(r)
                if sum(map(len, ends_a)) > 2_000_000:
                    ends_a, ends_b = _spanning(len(node), ends_a, ends_b, node)
        ends_a, ends_b = _spanning(len(node), ends_a, ends_b, node)
        asks = np.flatnonzero(home)
        return _found(node, asks, counts[asks] + (weight[asks] - 1) * (i == j), 1.0, ends_a[0], ends_b[0])

    found = ready.select("shard", "part", "node", "weight", "vec", "asks", "next").groupBy("shard", "part").applyInArrow(search, _FOUND)
    if dense.limit(1).count():
        side = F.ceil(F.col("n") / F.lit(block)).cast("long")
        placed = dense.withColumn("own", F.pmod(F.xxhash64("node"), side)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), side - 1)))
        placed = placed.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        found = found.unionByName(placed.select("shard", "i", "j", "node", "weight", "vec", "home", "own").groupBy("shard", "i", "j").applyInArrow(compare, _FOUND))
    found = scratch.save(found, "found")
    rows_of = scratch.save(coded.join(classes, ["label", "vec"], "left").select("id", "node", "least"), "rows")
    twice = rows_of.where("node is not null").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    edges = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(rows_of.join(twice, "id").select("a", F.col("node").alias("b")))
    labels = components(edges, scratch, "components").withColumnRenamed("id", "node")
    roots = labels.join(classes.select("node", "least"), "node").groupBy("label").agg(F.min("least").alias("root"))
    counted = found.where("n_links is not null").groupBy("node").agg(F.sum("n_links").alias("n_links"), F.min("recall").alias("recall"))
    per_class = counted.join(labels.join(roots, "label").select("node", "root"), "node", "left")
    root = F.when(F.col("id").isNotNull(), F.coalesce("root", "least", "id"))
    out = rows_of.join(per_class, "node", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(root == F.col("id"), F.lit(True)).alias("kept"), F.col("recall").alias("audit_recall"))


def _spanning(n: int, a: list[np.ndarray], b: list[np.ndarray], rep: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each node that has a link, one edge to the node of least id that it reaches over the links."""
    x, y = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (a, b))
    rank = np.empty(n, dtype=np.int64)
    rank[np.argsort(rep, kind="stable")] = np.arange(n)
    by_rank = np.argsort(rank)
    label = np.arange(n)
    x, y = rank[x], rank[y]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return [by_rank[moved]], [by_rank[label[moved]]]
