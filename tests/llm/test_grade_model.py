import random

import numpy as np
from helpers import DOCS, ODD, clashing, prose
from pyspark.sql import functions as F

from siftline.llm import grade_model


def corpus(n=900, seed=2):
    """Grade 2 is prose, 1 holds a bad word, 0 two of them and noise."""
    rng = random.Random(seed)
    rows, grades = [], []
    for i in range(n):
        g = rng.choice([0, 1, 2, 2, 2])
        words = prose(rng, rng.randrange(20, 200), 400).split()
        for bad in [["awful", "rotten"], [rng.choice(["awful", "rotten"])], []][g]:
            words.insert(rng.randrange(len(words)), bad)
        if g == 0:
            words = [w + "$$$" for w in words]
        rows.append((i, " ".join(words)))
        grades.append((i, g))
    return rows, grades


def test_held_out_accuracy(spark):
    rows, grades = corpus()
    docs = clashing(spark.createDataFrame(rows, DOCS))
    seen = spark.createDataFrame([x for x in grades if x[0] < 600] + [(None, 1), (3, None), (99999, 2)], "id long, grade int")
    model = grade_model.fit_grades(docs, seen)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in grade_model.score_grades(docs, model).collect()}
    out = [(got[i], g) for i, g in grades if i >= 600]
    assert np.mean([r.keep for r, g in out if g == 2]) >= 0.97
    assert np.mean([not r.keep for r, g in out if g < 2]) >= 0.95
    mean = lambda k: np.mean([r.expected_grade for r, g in out if g == k])
    assert mean(0) < mean(1) < mean(2)
    kept = grade_model.select_graded(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.keep}


def test_odd_rows(spark):
    rows, grades = corpus(200)
    docs = spark.createDataFrame(rows, DOCS)
    model = grade_model.fit_grades(docs, spark.createDataFrame(grades, "id long, grade int"))
    assert grade_model.score_grades(spark.createDataFrame(ODD, DOCS), model).count() == len(ODD)
    assert grade_model.score_grades(docs.limit(0), model).count() == 0


def test_without_labels_all_stay(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    for grades in ([], [(9005, 1), (9006, 1)]):
        model = grade_model.fit_grades(docs, spark.createDataFrame(grades, "id long, grade int"))
        assert all(r.keep for r in grade_model.score_grades(docs, model).collect())


def test_grades(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 1), (4, None, 1)], "doc_id long, quality int, toxic int")
    assert [r.grade for r in grade_model.graded(labels, F.col("quality"), F.col("toxic")).orderBy("id").collect()] == [2, 1, 0, None]


def test_loss_and_gradients_are_the_plain_ones():
    rng = np.random.default_rng(3)
    n, size, grades = 12, 5, 4
    dense = rng.normal(size=(n, size)) * (rng.random((n, size)) < 0.6)
    row, slot = np.nonzero(dense)
    grade, weight = rng.integers(0, grades, n), rng.random(n) + 0.5
    model = grade_model.OrdinalModel(np.arange(size), grades=grades, ridge=0.01)
    w, theta = rng.normal(size=size), rng.normal(size=grades - 1)

    def plain(w, theta):
        cuts = [theta[0]]
        for gap in theta[1:]:
            cuts.append(cuts[-1] + np.exp(gap))
        above = lambda i, j: 1.0 if j == 0 else 0.0 if j == grades else 1 / (1 + np.exp(cuts[j - 1] - dense[i] @ w))
        return sum(-weight[i] * np.log(above(i, grade[i]) - above(i, grade[i] + 1)) for i in range(n)) / n + 0.005 * w @ w

    loss, gw, gt = model.loss(w, theta, row, slot, dense[row, slot], grade, weight)
    assert abs(loss - plain(w, theta)) < 1e-9
    step = 1e-6
    for g, x, other in ((gw, w, lambda x: plain(x, theta)), (gt, theta, lambda x: plain(w, x))):
        for j in range(len(x)):
            e = np.zeros(len(x))
            e[j] = step
            assert abs(g[j] - (other(x + e) - other(x - e)) / (2 * step)) < 1e-6


def test_the_fit_reaches_the_least_loss():
    rng = np.random.default_rng(4)
    n, size = 300, 6
    dense = rng.normal(size=(n, size))
    grade = np.clip(np.digitize(dense @ np.array([2, -1, 0, 0.5, 0, 0]) + rng.logistic(size=n), [-1.0, 1.0]), 0, 2)
    row, slot = np.nonzero(dense)
    model = grade_model.OrdinalModel(np.arange(size)).fit(row, slot, dense[row, slot], grade)
    weight = (1 / np.sqrt([np.mean(grade == j) for j in range(3)]))[grade]
    weight /= weight.mean()
    at = lambda w, t: model.loss(w, np.array([t[0], np.log(t[1] - t[0])]), row, slot, dense[row, slot], grade, weight)
    best, gw, gt = at(model.weights, model.thresholds)
    assert max(np.abs(gw).max(), np.abs(gt).max()) < 1e-3
    for _ in range(50):  # the loss is convex in the weights
        assert at(model.weights + rng.normal(size=size) * 0.05, model.thresholds)[0] > best
