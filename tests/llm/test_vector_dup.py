import numpy as np
from helpers import clashing, roots

from siftline.llm import vector_dup

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=700, dim=24, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    rows = []
    for i in range(n):
        b = base[i % len(base)]
        x = b + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.25, 0.4, 2])
        rows.append((i, [float(np.float32(v)) for v in x], int(i % len(base)) % 3))
    rows += [(n + 1, rows[0][1], rows[0][2]), (n + 2, rows[0][1], 1 + rows[0][2]), (n + 3, [2 * v for v in rows[4][1]], rows[4][2])]
    return rows


def expected(rows, limit=0.93):
    good = [(i, np.array(v, dtype=np.float64), c) for i, v, c in rows if i is not None and c is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = []
    for n, (i, x, c) in enumerate(good):
        for j, y, d in good[n + 1 :]:
            if c == d and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= limit:
                links.append((i, j))
    count = {r[0]: 0 for r in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return count, roots(count, links)


def check(spark, rows, **how):
    count, root = expected(rows)
    got = vector_dup.near_duplicate_vectors(clashing(spark.createDataFrame(rows, SCHEMA)), **how).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: r.n_links for r in got} == count
    assert {r.vec_id: r.component_id for r in got} == root


def test_against_all_pairs(spark):
    check(spark, vectors())


def test_many_overlapping_shards(spark):
    check(spark, vectors(seed=6), shard_size=60, sample=50, queries_per_task=40)


def test_dense_group(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    rows = [(i, [float(v) for v in base + rng.normal(size=16) * 0.05], 1) for i in range(400)] + [(400 + i, [float(v) for v in rng.normal(size=16)], 1) for i in range(100)]
    check(spark, rows, shard_size=100, block=70)
    check(spark, rows, shard_size=100)


def clusters(seed=12, n=40, each=60, dim=256):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n, dim))
    return np.concatenate([c + rng.normal(size=(each, dim)) * 0.15 for c in centres])


def test_many_clusters_in_many_dimensions(spark):
    x = clusters()
    rows = [(i, [float(v) for v in y], 1) for i, y in enumerate(x)]
    near = vector_dup._unit(x) @ vector_dup._unit(x).T >= 0.93
    got = vector_dup.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))).collect()
    assert {r.vec_id: r.n_links for r in got} == {i: int(n) - 1 for i, n in enumerate(near.sum(axis=1))}
    assert len({r.component_id for r in got}) == 40 and all(r.audit_recall >= 0.995 for r in got)


def test_the_graph_joins_far_clusters():
    x = vector_dup._unit(clusters(seed=13))
    lists = vector_dup.build_lists(x)
    both = np.full((len(x), 400), -1, dtype=np.int64)
    for i in range(len(x)):
        own = np.unique(np.concatenate([lists[i][lists[i] >= 0], np.flatnonzero((lists == i).any(axis=1))]))
        both[i, : len(own)] = own
    asks = np.arange(0, len(x), 50)
    a, r = vector_dup.range_search(x, both, vector_dup.medoids(x), asks, 0.93, 48)
    true = x[asks] @ x.T >= 0.93
    true[np.arange(len(asks)), asks] = False
    assert len(set(zip(a.tolist(), r.tolist()))) == len(a) and true[a, r].sum() / true.sum() >= 0.995


def test_rows_that_share_an_id(spark):
    rng = np.random.default_rng(5)
    a, b = ([float(v) for v in rng.normal(size=16)] for _ in range(2))
    rows = [(5, a, 1), (5, b, 1), (6, b, 1), (4, a, 2), (7, a, 1), (7, a, 1), (5, a, 2)]
    got = vector_dup.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(4, 1, 4), (5, 1, 4), (5, 1, 4), (5, 2, 4), (6, 1, 4), (7, 2, 4), (7, 2, 4)]


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [1e-30, 0.0], 1)]
    check(spark, rows)
    got = vector_dup.near_duplicate_vectors(spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)], SCHEMA)).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(None, 0, None, True), (1, 0, 1, True)}


def test_empty(spark):
    assert vector_dup.near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_of_the_index():
    x = np.random.default_rng(0).normal(size=(1500, 32))
    x[700:] = x[:800] + np.random.default_rng(1).normal(size=(800, 32)) * 0.15
    x = vector_dup._unit(x)
    lists = vector_dup.build_lists(x)
    asks = np.arange(0, 1500, 50)
    a, r = vector_dup.range_search(x, lists, vector_dup.medoids(x), asks, 0.93, 48)
    true = x[asks] @ x.T >= 0.93
    true[np.arange(len(asks)), asks] = False
    assert true.sum() > 10 and true[a, r].sum() / true.sum() >= 0.9


def test_lone_pairs_in_a_poor_graph(spark):
    # few vectors have partners, and lists of one neighbour don't reach them all
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=24)], 1) for i in range(600)]
    rows += [(600 + i, [v + 0.02 for v in rows[100 * i][1]], 1) for i in range(6)]
    rows += [(700 + i, [float(v) for v in 3 + rng.normal(size=24) * 0.1], 1) for i in range(80)]
    check(spark, rows, degree=1, beam=1)


def test_recall_counts_each_query_alike():
    x = np.eye(3)
    partners = [np.arange(1, 1000), np.array([5])]
    a, r = np.zeros(999, np.int64), np.arange(1, 1000)
    assert vector_dup.mean_recall(2000, partners, a, r) == 0.5
    assert [len(v) for v in vector_dup.audited(x, np.arange(3), 0.9, 64, 2)] == [0, 0]
