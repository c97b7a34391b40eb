import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rxframe.functions import similarity
from tests import brute

GOLDEN = [
    ("dolo 650", "dolo 650", 100),
    ("augmentn", "augmentin", 94),
    ("calpol 650", "calpol 500", 90),
    ("pan", "pan 40", 90),
    ("dolo", "dolo 650 tablet", 90),
    ("lc montek", "montek lc", 95),
    ("", "dolo", 0),
]
PLAIN = {"weighted": brute.weighted}
word = st.one_of(st.sampled_from(["red", "rod", "tablet", "650", "a", "x" * 40]), st.text("abc12", max_size=6))
name = st.lists(word, max_size=4).map(lambda w: " ".join(x for x in w if x))


@pytest.mark.parametrize("a,b,score", GOLDEN)
def test_golden_pairs(a, b, score):
    at = np.array([0])
    assert int(similarity.WeightedRatio([a], [b]).score(at, at)[0]) == score


@settings(max_examples=60, deadline=None)
@given(st.lists(name, min_size=1, max_size=6), st.lists(name, min_size=1, max_size=6), st.sampled_from(list(PLAIN)))
def test_scores_and_bounds(queries, candidates, scorer):
    model = similarity.SCORERS[scorer](queries, candidates)
    i, k = (x.ravel() for x in np.indices((len(queries), len(candidates))))
    want = np.array([PLAIN[scorer](queries[x], candidates[y]) for x, y in zip(i, k)])
    assert np.allclose(model.score(i, k), want, atol=1e-9)
    assert (model.bound()[i, k] >= want - 1e-6).all()


@settings(max_examples=40, deadline=None)
@given(
    st.lists(name, min_size=1, max_size=5),
    st.lists(name, min_size=1, max_size=30),
    st.sampled_from(list(PLAIN)),
    st.booleans(),
    st.sampled_from([0.0, 72.0, 85.0]),
)
def test_best_equals_scoring_every_pair(queries, candidates, scorer, whole, cutoff):
    found, score = similarity.best_candidates(queries, candidates, scorer, whole, cutoff)
    # Scores of every pair come from the model, which the test above ties to the plain definition.
    model = similarity.SCORERS[scorer](queries, candidates)
    for r, q in enumerate(queries):
        every = model.score(np.full(len(candidates), r), np.arange(len(candidates)))
        keys = []
        for k, c in enumerate(candidates):
            s = math.floor(every[k]) if whole else every[k]
            keys.append((-s, abs(len(q) - len(c)) if whole else 0, k))
        best = min(keys)
        if -best[0] >= cutoff:
            assert (found[r], score[r]) == (best[2], -best[0])
        else:
            assert found[r] == -1


def test_texts_longer_than_a_word():
    a, b = "ab" * 50, "ba" * 45 + "c"
    at = np.array([0])
    assert similarity.WeightedRatio([a], [b]).score(at, at)[0] == pytest.approx(brute.weighted(a, b))
    far = "ab" * 40
    long = "xy" * 80 + far
    assert similarity.WeightedRatio([far], [long]).score(at, at)[0] == pytest.approx(brute.weighted(far, long))


def test_words_longer_than_small_integers():
    a, b = "ab" * 17_000, "ab" * 16_999
    assert similarity.best_candidates([a + " x"], [b + " x"], "weighted", True, 0.0)[1][0] >= 99


def test_edit_in_columns(spark, plan):
    from rxframe.operators import scoring

    queries = ["dolo 650", "augmentn", "", "ab" * 60, "pan", "éa"]
    names = ["dolo 500", "dolo 65", "augmentin", "pan 40", "ab" * 55, "ea", ""]
    q = spark.createDataFrame([("x", t) for t in queries], "block string, text string")
    c = spark.createDataFrame([("x", t, t) for t in names], "block string, text string, ord string")
    for whole in (True, False):
        best = scoring.best_per_query(q, c, "edit", whole, 40.0)
        assert "Python" not in plan(best)
        found = {r["text"]: (r["candidate"], r["score"]) for r in best.collect()}
        want = {}
        for t in queries:
            keys = []
            for n in names:
                score = brute.edit(t, n)
                keys.append((-(math.floor(score) if whole else score), abs(len(t) - len(n)) if whole else 0, n))
            if -min(keys)[0] >= 40:
                want[t] = (min(keys)[2], pytest.approx(-min(keys)[0]))
        assert found == want
