"""Hashing of words, components."""

import random

import numpy as np
import pyarrow as pa
from helpers import plain, roots, spaced

from siftline.llm import textkit
from siftline.llm.components import components
from siftline.llm.storage import Scratch


def hashed(texts, table, step=None):
    data, offsets = textkit.column_bytes(pa.array(texts, pa.string()))
    old = textkit.STEP
    textkit.STEP = step or old
    try:
        h, first = textkit.words(data, offsets, table)
    finally:
        textkit.STEP = old
    return [h[a:b].tolist() for a, b in zip(first[:-1], first[1:])]


def test_words():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB1é日 .\t\x0b\x85\x00-") for _ in range(rng.randrange(60))) for _ in range(500)] + [None, "", " ", "x" * 5000]
    for table, cut in ((textkit.SPACED, spaced), (textkit.PLAIN, plain)):
        whole = hashed(texts, table)
        assert whole == hashed(texts, table, step=64)
        names = {}
        for t, hs in zip(texts, whole):
            words = cut(t)
            assert len(words) == len(hs)
            for w, h in zip(words, hs):
                assert names.setdefault(w, h) == h
        assert len(set(names.values())) == len(names)


def test_shingles_depend_on_order():
    a, b = hashed(["x y y x", "y x x y"], textkit.SPACED)
    assert textkit.shingles(np.array(a, np.uint64), 4) != textkit.shingles(np.array(b, np.uint64), 4)


def test_row_blocks():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "", "cdef" * 10, "g"])], names=["text"])
    got = [t for b, _, _ in textkit.row_blocks(iter([batch]), limit=4) for t in b.column("text").to_pylist()]
    assert got == batch.column("text").to_pylist()


def test_components(spark):
    rng = random.Random(9)
    edges = [(7, i) for i in range(20, 60)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    want = roots({x for e in edges for x in e}, edges)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    for hub in (100_000, 4):
        got = components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"), Scratch(spark, "test"), "cc", hub=hub).collect()
        assert {r.id: r.label for r in got} == {x: want[x] for x in linked}
