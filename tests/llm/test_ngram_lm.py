import math
import random
from collections import Counter

import pytest
from helpers import DOCS, ODD, clashing, prose, spaced

from siftline.llm import ngram_lm


def expected(docs, order, discount=0.4):
    words = [spaced(t) for _, t in docs]
    grams = [Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)) for w in words]
    total = sum(grams, Counter())
    n = sum(map(len, words))
    out = []
    for w, own in zip(words, grams):
        rest = lambda g: total[g] - own[g]  # noqa: B023, E731
        score = alone = 0
        for i in range(len(w)):
            cost, k = 0.0, min(order, i + 1)
            while k > 1 and rest(tuple(w[i - k + 1 : i + 1])) == 0:
                cost, k = cost + math.log(discount), k - 1
            if k > 1:
                score += cost + math.log(rest(tuple(w[i - k + 1 : i + 1])) / rest(tuple(w[i - k + 1 : i])))
            else:
                score += cost + math.log((rest((w[i],)) + 1) / (n - len(w) + 1))
                alone += 1
        out.append((len(w), alone, score if w else None))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_plain_counts(spark, order):
    rng = random.Random(order)
    docs = [(i, prose(rng, rng.randrange(0, 60), 25)) for i in range(80)] + [(80, "a a a a"), (81, "A a")]
    df = clashing(spark.createDataFrame(docs, DOCS)).repartition(3)
    got = {r.doc_id: r for r in ngram_lm.stupid_backoff(df, order=order, block_bytes=700, part_grams=100).collect()}
    for (d, _), (n, alone, score) in zip(docs, expected(docs, order)):
        assert (got[d].n_words, got[d].n_alone) == (n, alone)
        assert got[d].log_score == (None if score is None else pytest.approx(score, abs=1e-9))


def test_odd_rows(spark):
    got = ngram_lm.stupid_backoff(spark.createDataFrame(ODD, DOCS)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[9001].mean_log_score is None and by[9002].n_words == by[9003].n_words == 0 and by[9005].n_words == 60_000


def test_empty(spark):
    assert ngram_lm.stupid_backoff(spark.createDataFrame([], DOCS)).count() == 0
