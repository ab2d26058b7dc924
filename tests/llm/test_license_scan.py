import random

from helpers import DOCS, ODD, clashing, prose

from siftline.llm import license_scan as L


def test_anchors_are_needed():
    for text in L.TEMPLATES.values():
        every = set(L._shingles(L.template_words(text)))
        marks = L.anchors({"x": text})
        assert sum(not (set(s) & marks) for s in every) < 0.8 * len(every)


def best(words, text, share=0.8):
    """The best window by trying all of them."""
    template = L.template_words(text)
    want, wide = set(L._shingles(template)), L.window_size(len(template))
    step = max(1, wide // 4)
    top = (0.0, 0)
    for first in range(0, len(words), step):
        held = words[first : first + wide]
        c = len(set(L._shingles(held)) & want) / len(want)
        if c > top[0]:
            top = (c, first)
    return top if top[0] >= share else None


def test_against_all_windows(spark):
    rng = random.Random(6)
    docs = []
    for d in range(120):
        words = prose(rng, rng.randrange(0, 120)).split()
        for _ in range(rng.randrange(3)):
            notice = rng.choice(list(L.TEMPLATES.values())).split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                notice[rng.randrange(len(notice))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice[rng.choice([0, 0, 2]) :]
        docs.append((d, (" ".join(words).upper() if rng.random() < 0.3 else " ".join(words))))
    want = {}
    for d, t in docs:
        for name, text in L.TEMPLATES.items():
            if found := best(L.template_words(t), text):
                want[d, name] = found
    got = L.scan_licenses(clashing(spark.createDataFrame(docs, DOCS))).collect()
    assert {(r.doc_id, r.template): (r.containment, r.first_word) for r in got} == want and len(want) > 30


def test_no_python_in_the_plan(spark):
    plan = L.scan_licenses(spark.createDataFrame(ODD, DOCS))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_odd_rows(spark):
    notice = L.TEMPLATES["MIT notice"]
    docs = [*ODD, (None, notice), (1, notice), (1, notice), (2, "license " * 20_000)]
    got = sorted((str(r.doc_id), r.template) for r in L.scan_licenses(spark.createDataFrame(docs, DOCS)).collect())
    assert got == [("1", "MIT notice"), ("None", "MIT notice")]
    assert L.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


def test_short_template(spark):
    got = L.scan_licenses(spark.createDataFrame([(1, "spdx License: MIT"), (2, "a spdx license mit b")], DOCS), templates={"tag": "SPDX license MIT"}).collect()
    assert [r.doc_id for r in got] == [1]


def test_short_notice_at_the_beginning(spark):
    # windows that shared no band with the notice's single shingle when each class had 24 bands
    docs = [(n, f"released under the mit license copyright {n} by") for n in range(20_000)]
    got = L.scan_licenses(spark.createDataFrame(docs, DOCS))
    assert got.where("template = 'MIT notice' and containment = 1").select("doc_id").distinct().count() == len(docs)


def test_bands_follow_the_least_similarity():
    bands = L.bands_for(L.TEMPLATES)
    for text in L.TEMPLATES.values():
        words = L.template_words(text)
        j = L.least_jaccard(len(words), len(set(L._shingles(words))))
        assert (1 - j) ** bands[L.window_size(len(words))] <= 1e-8


def test_long_templates(spark):
    rng = random.Random(8)
    templates = {str(n): " ".join(f"t{n}x{i}" if i % 7 == 0 else f"w{rng.randrange(400)}" for i in range(n)) for n in (2000, 2600, 2900, 4000, 6000)}
    docs = [(int(n), prose(rng, 777, 300) + " " + t + " " + prose(rng, 50, 300)) for n, t in templates.items()] + [(1, prose(rng, 9000, 400))]
    got = L.scan_licenses(spark.createDataFrame(docs, DOCS), templates=templates).collect()
    assert {(str(r.doc_id), r.template) for r in got} == {(n, n) for n in templates}
    for r in got:
        assert (r.containment, r.first_word) == best(L.template_words(dict(docs)[r.doc_id]), templates[r.template])


def test_long_texts_are_cut_to_segments(spark, monkeypatch):
    monkeypatch.setattr(L, "SEGMENT", 8)
    test_against_all_windows(spark)


def test_a_hundred_thousand_words(spark):
    notice = L.TEMPLATES["BSD clause"]
    text = "a license of some words in a row " * 12_000
    got = L.scan_licenses(spark.createDataFrame([(1, text + notice + " " + text[:1000]), (2, text)], DOCS)).where("template = 'BSD clause'").collect()
    assert [(r.doc_id, r.containment) for r in got] == [(1, 1.0)]
