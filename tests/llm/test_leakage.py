import random

from helpers import DOCS, ODD, clashing, plain, prose

from siftline.llm import leakage

ITEMS = "item_id long, text string"


def tables(seed=4):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.choice([0, 1, 4, 9, 10, 11, 30]), 60)) for i in range(40)] + [(7, "repeated id " + prose(rng, 12, 60)), (100, None), (None, prose(rng, 12)), (101, "Same word " * 8)]
    docs = []
    for d in range(150):
        words = prose(rng, rng.randrange(1, 200), 60).split()
        for _ in range(rng.randrange(3)):
            item = (items[rng.randrange(len(items))][1] or "").split()
            a = rng.randrange(max(1, len(item) - 8))
            at = rng.randrange(len(words))
            words[at:at] = item[a : a + rng.choice([9, 10, 14, 99])]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(words).upper() if rng.random() < 0.3 else " ".join(words)))
    return docs + [(500, "same word same word. same word same word same word same word same word")], items


def expected(docs, items, window=10):
    out = {}
    windows = []
    for i, t in items:
        w = plain(t)
        n = min(window, len(w))
        if i is not None and n:
            windows += [(str(i), tuple(w[k : k + n])) for k in range(len(w) - n + 1)]
    for d, t in docs:
        w, hits, found = plain(t), set(), set()
        for i, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hits |= set(range(k, k + len(win)))
                    found.add(i)
        out[d] = (len(w), sorted(hits), sorted(found))
    return out


def result(df):
    return {r.doc_id: (r.n_words, list(r.hits), list(r.items)) for r in df.collect()}


def test_against_plain_search(spark):
    docs, items = tables()
    got = leakage.decontaminate(clashing(spark.createDataFrame(docs, DOCS)).repartition(3), clashing(spark.createDataFrame(items, ITEMS)))
    assert result(got) == expected(docs, items)


def test_blocks_and_small_shards_give_the_same(spark):
    docs, items = tables(9)
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    index = leakage.build_index(d, shard_bytes=500)
    assert result(leakage.decontaminate(d, i, block_words=50, index=index)) == expected(docs, items)
    assert result(leakage.decontaminate(d, i, block_words=50)) == expected(docs, items)


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, item), (2, item.replace("gamma", "x gamma")), (3, item.replace("gamma", "x y z q gamma")), (4, item.replace("delta", ""))]
    got = leakage.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(5, item)], ITEMS), slop=2).collect()
    assert {r.doc_id: (list(r["items"]), list(r.near_items)) for r in got} == {1: (["5"], ["5"]), 2: ([], ["5"]), 3: ([], []), 4: ([], [])}


def test_phrases_end_with_the_document(spark):
    docs = [(1, "a b c d e"), (2, "f g h i j"), (3, "a b c d e f g h i j")]
    got = result(leakage.decontaminate(spark.createDataFrame(docs, DOCS).coalesce(1), spark.createDataFrame([(1, "a b c d e f g h i j")], ITEMS)))
    assert [bool(got[d][1]) for d in (1, 2, 3)] == [False, False, True]


def test_odd_rows_and_empty_tables(spark):
    docs, items = spark.createDataFrame(ODD, DOCS), spark.createDataFrame([(1, "twice the same row here"), (2, None)], ITEMS)
    got = leakage.decontaminate(docs, items).collect()
    assert len(got) == len(ODD) and sum(len(r.hits) for r in got) == 10
    none = spark.createDataFrame([], ITEMS)
    assert [r.n_words for r in leakage.decontaminate(docs, none).where("doc_id = 9007").collect()] == [1]
    assert leakage.decontaminate(spark.createDataFrame([], DOCS), items).count() == 0


def test_drop(spark):
    docs = clashing(spark.createDataFrame([(1, "a b c"), (2, "x a b c y"), (None, "a b c"), (4, "b c a")], DOCS))
    got = leakage.drop_contaminated(docs, spark.createDataFrame([(1, "A, b c!")], ITEMS))
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {None, 4}


def test_a_long_item_goes_in_pieces(spark):
    rng = random.Random(11)
    long = prose(rng, 700, 300)
    words = long.split()
    docs = [(k, " ".join(["before", *words[a : a + n], "after"])) for k, (a, n) in enumerate([(0, 10), (1, 9), (3, 25), (690, 10), (695, 5), (0, 700), (111, 60)])] + [(90, prose(rng, 50)), (91, None)]
    items = [(1, long), (2, " ".join(words[100:130])), (3, "short one"), (4, ""), (5, " ".join(words[:10]))]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert result(leakage.decontaminate(d, i, block_words=200)) == expected(docs, items)
    pieces = leakage._item_words(i, "item_id", "text", leakage.textkit.PLAIN, 10, 25).collect()
    assert max(len(r.words) for r in pieces) == 34 and sum(r.id == "1" for r in pieces) == 28 and {r.id for r in pieces} == {"1", "2", "3", "5"}
