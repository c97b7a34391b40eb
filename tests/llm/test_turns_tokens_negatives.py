"""Conversation repair, byte-level BPE and hard negatives against plain versions."""

import base64
import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from rxframe.llm import byte_pairs, hard_negatives, queries, turn_repair
from tests.llm import plain

TALK = "conv_id long, turn long, role string, text string"


def expected_repairs(rows):
    by = defaultdict(list)
    for conv, *row in plain.damaged(rows):
        by[conv].append(row)
    return {conv: plain.repaired(by[conv]) for conv in {r[0] for r in rows}}


def found_repairs(table, **how):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = turn_repair.repair_damaged(table, **how).collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: tuple(r[n] for n in names) for r in rows}


def talk(r, convs, most):
    texts = ["Yes.", "No!", "why", "so?", "", " ", "a b", "x.\n", "\x0b.", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "aide"]
    for conv in range(convs):
        for turn in sorted(r.sample(range(most * 2), r.randrange(1, most))):
            yield (conv, turn, r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"t{turn}" + r.choice([".", "", "!"]))


@pytest.mark.parametrize("part_bits", [1, 2, 12])
def test_repair_matches_all_edits(spark, part_bits):
    r = random.Random(part_bits)
    rows = list(talk(r, 120, 14)) + [(900, t, r.choice(["user", "assistant"]), f"m{r.randrange(60)}.") for t in range(300)]
    table = spark.createDataFrame([(*x, "z") for x in rows], TALK + ", audit string").repartition(5)
    assert found_repairs(table, part_bits=part_bits) == expected_repairs(rows)


def test_repair_of_every_short_order():
    """All orders of up to five symbols: tables, blocks of any size and trace equal the plain search."""
    t, roles = turn_repair.Tables(2), ["system", "user", "assistant", "other"]
    for n in range(1, 6):
        for code in range(0, 9**n, 1 if n < 4 else 61):
            symbols = [code // 9**k % 9 for k in range(n)]
            rows = [(k, roles[s % 4] if s < 8 else "user", "" if s == 8 else f"{k}" + ("" if s >= 4 else ".")) for k, s in enumerate(symbols)]
            want = plain.repaired(rows)
            padded = turn_repair._padded(np.array(symbols), np.array([0]), np.array([n]), n + n % 2)
            at, cost = t.borders(t.codes(padded), np.array([t.number[(0, 10, 5, 0)]]))
            edits, exits = t.trace(padded, at)
            audit = "".join(t.texts[e] for e in edits[0, 0]) + turn_repair.at_end(int(exits[0, 0]))
            assert (int(cost[0] + t.values[at[0, 0], 0]), audit) == want[5:7]


def test_repair_odd_tables(spark):
    long = "x" * 200_000 + "."
    rows = [(1, None, "user", "a."), (None, None, "user", "a."), (None, 3, "assistant", None), (2, 5, None, None), (2**60, 2**40, "user", long), (2**60, 2**40 + 9, "assistant", long)]
    table = spark.createDataFrame(rows, TALK)
    assert found_repairs(table) == expected_repairs(rows)
    assert turn_repair.repair_damaged(table.limit(0)).count() == 0
    same = [(4, 1, "user", "a.")] * 6
    assert found_repairs(spark.createDataFrame(same, TALK)) == expected_repairs(same)
    said = turn_repair.messages(table, turn_repair.repair(table)).collect()
    assert {(m.conv_id, m.place): (m.role, m.text) for m in said if m.conv_id == 2**60} == {(2**60, 0): ("user", long), (2**60, 1): ("assistant", long)}


def test_repair_of_the_given_table(spark, given):
    rows = [tuple(x[c] for c in ("conv_id", "turn", "role", "text")) for x in given("conversations").collect()]
    assert found_repairs(given("conversations")) == expected_repairs(rows)


@pytest.fixture(scope="module")
def library():
    ranks = byte_pairs.read_ranks(byte_pairs.default_ranks())
    return tiktoken.Encoding("own", pat_str=byte_pairs.default_pattern(), mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    r = random.Random(12)
    yield from [None, "", " ", "a", "<|endoftext|>", "it's  we'll\n\n x", "a" * 5000, "ab" * 3000, "é" * 3000, "z" * 60_000, "\U0001f600" * 40, "\x00\x1c\u0085 "]
    yield "".join(r.choice("abcdefgh") for _ in range(9000))
    yield "word " * 300_000
    for _ in range(150):
        yield "".join(r.choice("aeiostnr ") for _ in range(r.randrange(200)))
        yield "".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0x3000), r.randrange(0x10000, 0x1FFFF)])) for _ in range(r.randrange(120)))


def test_tokens_are_those_of_the_library(spark, documents, library):
    texts = list(odd_texts())
    docs = documents([*enumerate(texts), (None, "no id"), (5, "again"), (5, "again")])
    rows = byte_pairs.decode(byte_pairs.encode(docs)).collect()
    found = {x.doc_id: x for x in rows if x.doc_id is not None and x.doc_id != 5}
    assert len(rows) == len(texts) + 3
    assert all(found[i].ids == library.encode_ordinary(t or "") and bytes(found[i].bytes) == (t or "").encode() for i, t in enumerate(texts) if i != 5)
    assert byte_pairs.encode(documents([])).count() == 0


def test_long_matches_merge_like_short_ones(library):
    """The heap and the matrix give the same ids, also where every pair has the same rank."""
    e = byte_pairs.encoder(byte_pairs.default_ranks(), byte_pairs.default_pattern())
    r = random.Random(4)
    words = [bytes(r.choice(b"aeinst") for _ in range(r.randrange(2, 90))) for _ in range(200)] + [b"a" * n for n in range(2, 60)]
    assert all((a == e.merged_long(w)).all() for w, a in zip(words, e.merged(words), strict=True))


def test_small_vocabulary_with_crossing_merges():
    """A made-up vocabulary in which a longer token has the lower rank, against merging one by one."""
    ranks = {bytes([b]): 100 + b for b in range(256)} | {b"ab": 9, b"xab": 3, b"xa": 7, b"ba": 8, b"abab": 4}
    e = byte_pairs.Encoder(ranks, r"\S+|\s+")

    def plainly(parts):
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            _, i = min(pairs)
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]

    r = random.Random(6)
    words = [bytes(r.choice(b"abx") for _ in range(n)) for n in range(2, 40)]
    for w, ids in zip(words, e.merged(words), strict=True):
        assert ids.tolist() == plainly([w[i : i + 1] for i in range(len(w))]) == e.merged_long(w).tolist()


def test_ids_outside_of_the_vocabulary(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [x.bytes for x in byte_pairs.decode(rows).orderBy("doc_id").collect()] == [None, b""]
    with pytest.raises(Exception, match="outside of the vocabulary"):
        byte_pairs.decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>")).collect()


def test_token_query(spark, small, given, library):
    want = {}
    for x in given("documents").collect():
        ids = library.encode_ordinary(x.text or "")
        want[x.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x.text or "").encode()).hexdigest())
    found = queries.op12_byte_bpe(spark, small).collect()
    assert {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in found} == want
    assert base64 and pa


def mined(table, **how):
    return sorted(tuple(x) for x in hard_negatives.mine(table, **how).collect())


@pytest.mark.parametrize("block_rows,group_rows", [(7, 3), (512, 2048)])
def test_negatives_match_all_pairs(spark, block_rows, group_rows):
    r = np.random.default_rng(block_rows)
    centers = r.normal(size=(6, 10))
    rows = [(i, centers[r.integers(6)] + 0.4 * r.normal(size=10), int(r.integers(3))) for i in range(0, 4000, 10)]
    rows += [(100_000 + i, np.ones(10), i % 2) for i in range(0, 200, 5)] + [(200_000 + i, -np.ones(4), 1) for i in range(0, 300, 50)]
    table = spark.createDataFrame([(i, x.tolist(), y, "v") for i, x, y in rows], "vec_id long, embedding array<double>, label int, v string").repartition(4)
    found = mined(hard_negatives.prepared(table), block_rows=block_rows, group_rows=group_rows)
    whole = [(i, [int(np.floor(256 * c)) for c in x], y) for i, x, y in rows]
    assert found == sorted(plain.hard_negatives(whole)) and len(found) > 500


def test_blocks_that_cannot_count_are_not_read(spark):
    r = np.random.default_rng(2)
    rows = [(100 * i, (np.eye(8)[c] * 3 + 0.05 * r.normal(size=8)).tolist(), int(r.integers(2))) for i, c in enumerate(np.repeat(np.arange(8), 60))]
    table = hard_negatives.prepared(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    stored = hard_negatives.blocks(hard_negatives.ordered(table), 16).cache()
    groups = hard_negatives.anchor_groups(hard_negatives.anchor_rows(stored, 100, 5)).cache()
    chosen = hard_negatives.choose(groups, stored, 5, negatives=False).collect()
    met, most = sum(len(x.who) // 4 for x in chosen), stored.count() * len(rows)
    assert met < 0.5 * most


def test_negatives_odd_rows(spark):
    big = 1e300
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (2, [0.9, 0.1], 2), (2, [0.9, 0.1], 2), (3, None, 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (None, [1.0, 0.0], 2), (7, [1.0, 0.0], None), (8, [], 1), (100, [], 2)]
    whole = [(i, [int(np.floor(256 * c)) for c in x], y) for i, x, y in rows[:6] + rows[12:]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(hard_negatives.prepared(table)) == sorted(plain.hard_negatives(whole))
    assert mined(hard_negatives.prepared(table.limit(0))) == []
    wide = spark.createDataFrame([(0, [big, 1.0], 1), (1, [big, 1.0], 1), (2, [big, 0.5], 2)], "vec_id long, embedding array<double>, label int")
    assert mined(hard_negatives.prepared(wide)) == [(0, 1, 1, 2, 2**63 - 1, 2**63 - 1)]


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        place = hard_negatives.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()
