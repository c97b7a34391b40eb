"""Matching against brute force over whole small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from checks import fixtures as X
from checks import queries as Q
from rxframe.operators import matching, sampling, scoring
from rxframe.plans import lookup
from rxframe.session import settle
from rxframe.sources import catalogue
from tests import brute


@pytest.fixture(scope="module")
def products(spark, small):
    return settle(X.products(spark, small))


@pytest.fixture(scope="module")
def terms(spark, small):
    return settle(X.terms(spark, small))


@pytest.fixture(scope="module")
def clean(spark, small):
    return settle(Q._clean(spark, small))


@pytest.mark.parametrize("scorer", ["weighted", "edit"])
def test_batch_match_equals_brute_force(spark, products, clean, scorer):
    plain = {"weighted": brute.weighted, "edit": brute.edit}[scorer]
    groups = catalogue.signature_groups(products)
    sigs = {r["signature"]: r for r in groups.collect()}
    got = matching.match_lines(clean, products, groups, scorer).collect()
    assert len(got) == clean.count()
    items = products.collect()
    answers = {}
    for r in got:
        q = " ".join(r["drug_name_normalized"].lower().split())
        if q not in answers:
            scored = [
                (-math.floor(plain(q, p["name_norm"])), abs(len(q) - len(p["name_norm"])), p["name"], p["price"], p["pos"], p["salt"], p["signature"])
                for p in items
                if p["block_key"] == q[:3]
            ]
            answers[q] = min(scored, default=None)
        best = answers[q]
        score = -best[0] if best else 0
        assert r["match_score"] == score
        if score < 85:
            assert (r["match_method"], r["matched_product"], r["saving"]) == ("unmatched", None, None)
        else:
            generic = sigs[best[6]]
            assert r["match_method"] == ("exact" if score == 100 else "blocked_fuzzy")
            assert (r["matched_product"], r["matched_salt"], r["brand_price"]) == (best[2], best[5], best[3])
            assert (r["generic_name"], r["generic_price"]) == (generic["generic_name"], generic["generic_price"])
            assert r["saving"] == pytest.approx(round(best[3] - generic["generic_price"], 2))


def tiered_plain(query, ordered):
    """ordered: terms by registration as (term, tier, pos)."""
    if not query:
        return None, None, 0
    for term, tier, pos in ordered:
        if term == query:
            return tier, pos, 100

    def best(candidates, cutoff):
        top = None
        for term, tier, pos in candidates:
            s = brute.weighted(query, term)
            if s >= cutoff and (top is None or s > top[0]):
                top = (s, tier, pos)
        return top

    cur = best([t for t in ordered if t[1] == 0], 72)
    if cur and int(cur[0]) >= 95:
        return cur[1], cur[2], int(cur[0])
    bulk = None
    if len(query) >= 3:
        bulk = best([t for t in ordered if t[0][:3] == query[:3]], 85)
    if bulk and int(bulk[0]) >= (int(cur[0]) if cur else 0):
        return bulk[1], bulk[2], int(bulk[0])
    return (cur[1], cur[2], int(cur[0])) if cur else (None, None, 0)


def test_tiered_match_equals_brute_force(spark, terms):
    ordered = [
        (r["term"], r["tier"], r["pos"])
        for r in terms.orderBy("tier", "pos", "variant").collect()
    ]
    rng = random.Random(3)
    names = ["", "  ", "Tab ", "re", "zz top", "Tab. RED-ROD 3", "hot", "syrup of hot rod"]
    for term, _, _ in rng.sample(ordered, 40):
        cut = rng.randrange(len(term))
        names += [term, "Tab " + term.upper(), term[:cut] + term[cut + 1 :], term + " forte", term[::-1]]
    asked = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    got = matching.tiered_match(asked, terms).orderBy("i").collect()
    assert len(got) == len(names)
    import re

    prefix = re.compile(r"(?i)^(tab|tablet|cap|capsule|syp|syrup|inj|injection|oint|cream|drops?|t|c)\.?\s+")
    for r in got:
        query = " ".join(prefix.sub("", r["name"].strip()).lower().replace("-", " ").split())
        assert (r["tier"], r["pos"], r["match_score"]) == tiered_plain(query, ordered), r


def test_best_of_two_prefers_the_interpretation(spark, terms):
    some = [r["term"] for r in terms.filter("variant = 1 and tier = 1").orderBy("term").limit(2).collect()]
    a, b = some
    rows = [(0, a, b), (1, a, "qqqq"), (2, "", a), (3, "qqqq", ""), (4, None, None)]
    asked = spark.createDataFrame(rows, "i int, raw string, said string")
    got = matching.best_of_two(asked, terms, "raw", "said").orderBy("i").collect()
    pos = {r["term"]: r["pos"] for r in terms.collect()}
    assert [r["pos"] for r in got] == [pos[b], pos[a], pos[a], None, None]
    assert [r["match_score"] for r in got] == [100, 100, 100, 0, 0]


def test_hot_block_is_spread_over_chunks(spark, monkeypatch):
    """Small chunks force many chunk pairs in one block; the answer stays the same."""
    monkeypatch.setattr(scoring, "QUERY_CHUNK", 5)
    monkeypatch.setattr(scoring, "CANDIDATE_CHUNK", 7)
    monkeypatch.setattr(scoring, "QUERY_CHUNKS_PER_KEY", 2)
    rng = random.Random(5)
    word = lambda: "red" + "".join(rng.choice("abcdef ") for _ in range(8)).rstrip()
    queries = sorted({word() for _ in range(60)})
    candidates = sorted({word() for _ in range(90)})
    left = spark.createDataFrame([("red", q) for q in queries], "block string, text string")
    right = spark.createDataFrame([("red", c, c) for c in candidates], "block string, text string, ord string")
    got = {r["text"]: (r["score"], r["ord"]) for r in scoring.best_per_query(left, right).collect()}
    for q in queries:
        s, gap, c = min((-math.floor(brute.weighted(q, c)), abs(len(q) - len(c)), c) for c in candidates)
        assert got[q] == (-s, c)


def test_no_cross_join(spark, products, clean, plan):
    groups = catalogue.signature_groups(products)
    text = plan(matching.match_lines(clean, products, groups))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_sample_is_exact_and_repeats(spark, products):
    names = products.select("pos", "name")
    total = names.count()
    for n in (0, 1, total // 2, total, total + 10, 3 * total):
        rows = sampling.noisy_sample(names, n).collect()
        assert len(rows) == n and len({r["line_id"] for r in rows}) == n
        for r in rows:
            assert r["noisy"] == r["name"] or (len(r["name"]) - len(r["noisy"]) == 1 and r["noisy"][0] == r["name"][0])


def test_lookup_report(spark, small):
    ref = lookup.Reference(*[settle(f(spark, small)) for f in (X.terms, X.entries, X.products, X.rules)])
    some = ref.products.orderBy("pos").limit(3).collect()
    names = [(1, i, p["name"]) for i, p in enumerate(some)] + [(1, 3, "qqqq"), (2, 0, " "), (2, 1, "zzzz")]
    asked = spark.createDataFrame(names, "rx_id int, position int, name string")
    report = lookup.lookup(lookup.names_as_requests(asked), ref)
    meds = {(r["rx_id"], r["position"]): r for r in report.medicines.collect()}
    assert set(meds) == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 1)}
    assert not meds[1, 3]["matched"] and meds[1, 0]["match_score"] == 100
    assert meds[1, 0]["ocr_confidence"] == "high"
    for r in meds.values():
        assert r["brand"] not in [a["brand"] for a in r["alternatives"]]
        prices = [a["price"] for a in r["alternatives"]]
        assert prices == sorted(prices) and len(prices) <= 5
    totals = {r["rx_id"]: r for r in report.totals.collect()}
    assert totals[2]["brand"] == 0.0 and totals[2]["saving_pct"] == 0
    brand = sum(m["brand_price"] for k, m in meds.items() if k[0] == 1 and m["matched"])
    assert totals[1]["brand"] == pytest.approx(brand)
    sections = {r["section"] for r in report.sections().collect()}
    assert {"medicine", "totals"} <= sections


def test_saved_requests_skip_known_brands(spark, small):
    ref = lookup.Reference(*[settle(f(spark, small)) for f in (X.terms, X.entries, X.products, X.rules)])
    p = ref.products.orderBy("pos").first()
    brand = ref.entries.join(ref.terms.filter(F.col("term") == p["name_norm"]), ["tier", "pos"]).first()["brand"]
    asked = spark.createDataFrame([(1, 5, p["name"]), (1, 4, p["name"]), (2, 6, p["name"]), (2, 7, "qqqq")], "user_id int, id int, name string")
    have = spark.createDataFrame([(2, brand)], "user_id int, brand string")
    got = lookup.resolve_saved(asked, have, ref).collect()
    assert [(r["user_id"], r["id"], r["brand"]) for r in got] == [(1, 4, brand)]


@pytest.mark.parametrize(("whole", "cutoff"), [(True, 0.0), (True, 60.0), (False, 0.0), (False, 72.0)])
def test_bounded_edit_scorer_equals_every_pair(spark, whole, cutoff):
    r = random.Random(5)
    texts = ["".join(r.choice("abé ") for _ in range(r.randint(0, 9))) for _ in range(150)]
    asked, known = sorted(set(texts[:60])), sorted(set(texts[60:]) | {"ab", "ba", ""})
    queries = spark.createDataFrame([("x", t) for t in asked], "block string, text string")
    candidates = spark.createDataFrame([("x", t, i % 7) for i, t in enumerate(known)], "block string, text string, ord int")
    found = {
        row.text: (row.candidate, row.ord, row.score)
        for row in scoring.best_per_query(queries, candidates, "edit", whole, cutoff).collect()
    }
    wanted = {}
    for q in asked:
        for i, c in enumerate(known):
            score = float(math.floor(brute.edit(q, c))) if whole else brute.edit(q, c)
            rank = (-score, abs(len(q) - len(c)) if whole else 0, i % 7, c)
            if score >= cutoff:
                wanted[q] = min(wanted.get(q, rank), rank)
    assert found == {t: (c, o, -s) for t, (s, _, o, c) in wanted.items()}
