"""Exact and near dedup of documents and vectors against plain versions."""

import random

import numpy as np
import pytest

from rxframe.llm import components, embedding_dedup, exact_dedup, near_dedup
from tests.llm import plain


def test_exact_groups(documents):
    rows = [(5, "a b"), (3, "a  b"), (4, "ab"), (9, None), (8, ""), (7, " \n"), (1, "x"), (2, "é "), (6, "é"), (10, "ab" * 50_000)]
    found = exact_dedup.mark(exact_dedup.fingerprints(documents(rows))).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in found} == plain.exact_groups(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found) and found[0].row == 1
    assert {r.doc_id for r in exact_dedup.dedup(documents(rows)).collect()} == {3, 7, 1, 2, 6, 10}


def test_exact_repeated_rows_and_null_ids(documents):
    rows = [(1, "a"), (1, "a"), (1, "a"), (None, "b"), (2, "b"), (None, "c"), (None, "c")]
    found = exact_dedup.mark(exact_dedup.fingerprints(documents(rows))).collect()
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in found)
    assert got == [
        ("1", "1", 3, False), ("1", "1", 3, False), ("1", "1", 3, True), ("2", "2", 2, True),
        ("None", "2", 2, False), ("None", "None", 2, False), ("None", "None", 2, True),
    ]
    kept = exact_dedup.dedup(documents(rows))
    assert kept.count() == 3 and kept.columns == documents(rows).columns
    assert exact_dedup.dedup(documents([])).count() == 0


def test_full_filter_changes_nothing(documents):
    """A filter much too small lets more rows through to the shuffle, with the same result."""
    rows = [(i, str(i % 700)) for i in range(1000)]
    small = exact_dedup.mark(exact_dedup.fingerprints(documents(rows)), max_bits=64)
    assert {r.doc_id: (r.keep_id, r.group_size) for r in small.collect()} == plain.exact_groups(rows)


def test_only_possible_repeats_are_tested_positive(spark):
    rows = spark.range(20_000).selectExpr("cast(id as string) AS digest").union(spark.range(50).selectExpr("cast(id as string)"))
    bits = exact_dedup.filter_bits(20_050)
    found = exact_dedup.maybe_repeated(rows, "digest", exact_dedup.repeated_bits(rows, "digest", bits), bits)
    hit = {r.digest for r in found.filter("maybe").collect()}
    assert {str(i) for i in range(50)} <= hit and len(hit) < 400


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(99), r.randrange(99)) for _ in range(60)] + [(500, i) for i in range(501, 560)]
    r.shuffle(links)
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    ids = {i for x in links if x[0] != x[1] for i in x}
    assert {x.id: x.component for x in found} == plain.smallest_reachable(ids, [x for x in links if x[0] != x[1]])
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"w{r.randrange(4000)}"
    return " ".join(words)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates_match_all_pairs(documents, width, percent):
    """A large group of edited copies at all distances, chains of copies of copies, short texts and odd ones."""
    r = random.Random(percent)
    base = [f"w{r.randrange(4000)}" for _ in range(150)]
    rows = [(i, edited(r, base, r.randrange(12))) for i in range(10, 130)]
    chain = base[:90]
    for i in range(200, 240):
        chain = edited(r, chain, 1).split()
        rows.append((i, " ".join(chain[: 90 - (i % 7)])))
    rows += [(300 + i, " ".join(base[i : i + 60])) for i in range(0, 40, 2)]
    rows += [(400 + i, " ".join(base[:n])) for i, n in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 2, 1, 9])]
    rows += [(500, None), (501, " \t "), (502, "ONE two\x0bthree"), (503, "one\nTWO three"), (504, "ÉCOLE a"), (505, "école a"), (506, " ".join(base * 200))]
    found = near_dedup.near_duplicates(documents(rows), width=width, percent=percent).collect()
    sets, expected = plain.near_components(dict(rows), width, percent)
    assert {x.doc_id: x.component_id for x in found} == expected
    assert {x.doc_id: x.n_shingles for x in found} == {i: len(s) for i, s in sets.items()}
    assert all(x.kept == (x.doc_id == x.component_id) for x in found) and len(set(expected.values())) < len(rows) - 100


@pytest.mark.parametrize("few,shingles,sets", [(10**9, 300, 4), (0, 1 << 18, 1024)])
def test_open_lists_in_tiles_or_rounds(spark, documents, few, shingles, sets):
    """Many tiles of one bundle, and centres alone until nothing is open: the same components."""
    r = random.Random(9)
    base = [f"w{r.randrange(3000)}" for _ in range(80)]
    rows = [(i, edited(r, base[: 80 - i % 5], r.randrange(5))) for i in range(70 if few else 8)]
    docs = documents(rows)
    match = near_dedup.matches(85)
    classes = near_dedup.signatures(docs, width=3).withColumnRenamed("doc_id", "id").cache()
    texts = docs.select(near_dedup.F.col("doc_id").alias("id"), "text")
    post = near_dedup.postings(classes, 85, match=match).cache()
    links = near_dedup.Links(classes, texts, 85, 3, match)
    found = {x.id: x.component for x in near_dedup.linked(post, links, few, shingles, sets).collect()}
    _, expected = plain.near_components(dict(rows), 3, 85)
    assert {i: found.get(i, i) for i in expected} == expected and 1 < len(set(expected.values())) < len(rows)


def test_near_duplicates_clashing_columns(spark):
    text = " ".join(f"x{i}" for i in range(30))
    rows = [(1, text, 5, "a", 7), (2, text + " y", 6, "b", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int, id string, row int")
    assert [tuple(x) for x in near_dedup.dedup(docs).collect()] == rows[:1]


def test_near_duplicates_odd_rows(documents):
    text = " ".join(f"x{i}" for i in range(30))
    rows = [(None, text), (None, text), (1, text), (2, text + " y"), (2, text + " y"), (3, None)]
    found = near_dedup.near_duplicates(documents(rows)).collect()
    assert sorted((str(x.doc_id), str(x.component_id), x.kept) for x in found) == [
        ("1", "1", True), ("2", "1", False), ("2", "1", False), ("3", "3", True), ("None", "None", True), ("None", "None", True),
    ]
    kept = near_dedup.dedup(documents(rows))
    assert kept.columns == documents(rows).columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == ["1", "3", "None", "None"]
    assert near_dedup.near_duplicates(documents([])).count() == 0


def test_near_duplicates_of_the_given_table(given):
    docs = given("documents")
    _, expected = plain.near_components({x.doc_id: x.text for x in docs.collect()}, 3, 85)
    assert {x.doc_id: x.component_id for x in near_dedup.near_duplicates(docs, width=3, percent=85).collect()} == expected


def all_links(rows, threshold=0.93):
    ids = [x[0] for x in rows if x[0] is not None]
    known = [(i, np.array(v, "f8"), y) for i, v, y in rows if i is not None and y is not None and v and None not in v]
    known = [(i, v, y) for i, v, y in known if np.isfinite(v).all() and v.any()]
    links = [
        (a, b) for n, (a, v, y) in enumerate(known) for b, w, z in known[n + 1 :]
        if y == z and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= threshold
    ]
    count = {i: 0 for i in ids}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return count, plain.smallest_reachable(ids, links)


def test_vectors_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 40)
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=16).tolist(), int(r.integers(3))) for i in range(400)]
    for c in range(12):
        center, label = r.normal(size=16), int(r.integers(3))
        rows += [(1000 + 100 * c + i, (center + 0.1 * r.normal(size=16)).tolist(), label) for i in range(3 + 8 * c)]
    rows += [(5000 + i, [1.0] * 16, 1) for i in range(30)] + [(6000, [2.0] * 16, 1), (6001, [1.0] * 8, 1), (6002, [1.0] * 8, 1)]
    rows += [(7000, None, 1), (7001, [0.0] * 16, 1), (7002, [1.0] * 16, None), (7003, [float("nan")] + [1.0] * 15, 1), (7004, [float("inf")] * 16, 1), (7005, [None] * 16, 1), (7006, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    expected, component = all_links(rows)
    found = embedding_dedup.near_duplicates(table, window=16).collect()
    assert len(found) == len(rows)
    total = sum(expected.values())
    assert sum(min(x.n_links, expected[x.vec_id]) for x in found) >= 0.98 * total and all(x.n_links <= expected[x.vec_id] for x in found)
    assert sum(x.component_id == component[x.vec_id] for x in found) >= 0.98 * len(rows)
    assert all(x.kept == (x.vec_id == x.component_id) for x in found)
    assert {x.vec_id: x.n_links for x in found if x.vec_id >= 5000} == {i: n for i, n in expected.items() if i >= 5000}


def test_vectors_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, label int, links int, id string"
    rows = [(None, [1.0, 0.0], 1, 0, "a"), (1, [1.0, 0.0], 1, 0, "a"), (2, [1.0, 0.01], 1, 0, "a"), (2, [1.0, 0.01], 1, 0, "a")]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, kind)).collect()
    assert sorted((str(x.vec_id), x.n_links, str(x.component_id), x.kept) for x in found) == [
        ("1", 2, "1", True), ("2", 2, "1", False), ("2", 2, "1", False), ("None", 0, "None", True)
    ]
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], kind)).count() == 0


def hot_label(rows, seed, dim=32, common=0.0):
    """One label of unit vectors, ``common`` of whose square lies in one direction, with 200 pairs at the threshold."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(rows, dim))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * np.sqrt(1 - common)
    x[:, 0] += np.sqrt(common)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(200):
        side = r.normal(size=dim)
        side -= (side @ x[i]) * x[i]
        x[200 + i] = 0.932 * x[i] + np.sqrt(1 - 0.932**2) * side / np.linalg.norm(side)
    return x


@pytest.mark.parametrize("common", [0.0, 0.3])
def test_vectors_of_a_hot_label(spark, monkeypatch, common):
    """Pairs at the threshold in a label far larger than its windows; the label takes passes, then all pairs on demand."""
    x = hot_label(6000, 5, common=common)
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    near = np.argwhere(np.triu(x @ x.T >= 0.93, 1))
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    plan = embedding_dedup.planned(embedding_dedup.classes(table, "vec_id", "embedding", "label"), 0.93, 4, 4).first()
    assert plan["passes"] and 16 < plan["passes"] < 6000 / 16
    found = {v.vec_id: v.component_id for v in embedding_dedup.near_duplicates(table, passes=4, window=4).collect()}
    recall = np.mean([found[a] == found[b] for a, b in near])
    assert len(near) >= 200 and recall >= 0.98, recall
    monkeypatch.setattr(embedding_dedup, "TILE", 1024)
    found = {v.vec_id: v.component_id for v in embedding_dedup.near_duplicates(table).collect()}
    assert np.mean([found[a] == found[b] for a, b in near]) >= 0.98
    found = {v.vec_id: v.component_id for v in embedding_dedup.near_duplicates(table, whole=6000).collect()}
    assert all(found[a] == found[b] for a, b in near)


def test_passes_grow_with_a_label():
    """Calculated passes rise with rows and with a common direction; a narrow cone is left to all pairs."""
    x = hot_label(4096, 6)
    counts = [embedding_dedup.needed(x, n, 0.93, 64)[0] for n in (100_000, 1_000_000, 10_000_000)]
    assert 8 < counts[0] < counts[1] < counts[2] and counts[2] > 25
    assert embedding_dedup.needed(hot_label(4096, 6, common=0.5), 1_000_000, 0.93, 64)[0] > counts[1]
    assert embedding_dedup.needed(hot_label(4096, 6, common=0.9), 1_000_000, 0.93, 64)[0] > 1_000_000 / 1024
