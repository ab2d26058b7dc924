import random

from helpers import DOCS, ODD, clashing, prose, roots, shingles

from siftline.llm import near_dup


def corpus(seed=5):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(60):  # groups of a base and edits of it, from light to heavy
        base = prose(rng, rng.choice([3, 6, 12, 40, 200, 900])).split()
        for _ in range(rng.choice([1, 2, 3, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, max(1, len(words) // 25)])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append((n, " ".join(words).title() if rng.random() < 0.2 else " ".join(words)))
            n += 1
    rows += [(n + 1, "x y y x"), (n + 2, "y x x y"), (n + 3, "a b"), (n + 4, "A  b\n")]
    return rows


def expected(rows, k, percent):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, shingles(t, k))
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, roots(sets, links)


def test_against_all_pairs(spark):
    rows = corpus()
    sets, want = expected(rows, 4, 80)
    got = near_dup.near_duplicates(clashing(spark.createDataFrame(rows, DOCS)), k=4, percent=80).collect()
    assert {r.doc_id: r.n_shingles for r in got} == {d: len(s) for d, s in sets.items()}
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)


def test_blocks_give_the_same(spark):
    rows = corpus(8)
    _, want = expected(rows, 5, 80)
    df = spark.createDataFrame(rows, DOCS)
    for how in ({"block": 300}, {"orders": 1, "bins": 64}):
        assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, **how).collect()} == want


def test_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = prose(rng, 130).split()
    rows = []
    for d in range(400):
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(130)] = f"e{rng.randrange(50)}"
        rows.append((d, " ".join(words)))
    _, want = expected(rows, 4, 80)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS), k=4).collect()} == want


def test_rows_that_share_an_id_are_one_document_in_any_order(spark):
    rng = random.Random(4)
    far, near = prose(rng, 100), prose(rng, 100)
    edit = " ".join([*near.split()[:-1], "other"])
    rows = [(6, far), (6, near), (5, edit), (7, far), (7, far), (8, ""), (8, edit)]
    for _ in range(4):
        rng.shuffle(rows)
        got = near_dup.near_duplicates(spark.createDataFrame(rows, DOCS).coalesce(1)).collect()
        assert sorted((r.doc_id, r.component_id) for r in got if r.n_shingles) == [(5, 5), (6, 5), (6, 5), (7, 5), (7, 5), (8, 5)]
        assert [r.component_id for r in got if not r.n_shingles] == [8]


def test_a_pair_that_only_seemed_close_hides_no_other(spark, monkeypatch):
    rng = random.Random(2)
    base = prose(rng, 130).split()
    rows = [(d, " ".join(f"e{rng.randrange(9)}" if rng.random() < 0.02 else w for w in base)) for d in range(150)]
    _, want = expected(rows, 5, 80)
    closer, asked = near_dup._closer, []

    def misled(limit, closest):
        asked.append(closest)
        real = closer(limit, closest)

        def run(key, table):
            out = real(key, table)
            if not closest or not out.num_rows:
                return out
            import pyarrow as pa

            ids, labels = table.column("node").to_pylist(), table.column("label").to_pylist()
            other = next((i for i, x in zip(ids, labels) if x != labels[0]), ids[0])
            return pa.table({"a": pa.array([-1 - min(ids[0], other)]), "b": pa.array([max(ids[0], other)])})

        return run

    monkeypatch.setattr(near_dup, "_closer", misled)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, DOCS), orders=1, bins=64).collect()
    assert {r.doc_id: r.component_id for r in got} == want and asked[0] and len(asked) <= 2


def test_odd_rows(spark):
    got = near_dup.near_duplicates(spark.createDataFrame(ODD, DOCS)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[None].component_id is None and by[None].kept
    assert [by[i].n_shingles for i in (9001, 9002, 9003, 9005, 9007)] == [0, 0, 0, 1, 1]
    assert all(r.component_id == r.doc_id for r in got if r.doc_id is not None)


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert near_dup.near_duplicates(none).count() == 0
    assert near_dup.drop_near_duplicates(none).count() == 0


def test_drop_keeps_columns_and_one_of_each(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words are here now"), (3, "other words are here now"), (4, None), (None, "a b c d e f g")]
    df = clashing(spark.createDataFrame(rows, DOCS))
    got = near_dup.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == [1, 3, 4, None]
