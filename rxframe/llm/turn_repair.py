"""Conversation structure repair by Four-Russians block tables.

The cheapest edits (keep, rerole, delete, insert) that give a conversation the role order ``(s?(ua)+)?`` follow from a
cost vector: for each of four states (nothing yet, after s, after u, after a) the least cost of all that comes after it.
Vectors are kept normalised (least entry 0, the rest beside it); only a few dozen ever occur. A table holds, for every
such vector and every block of ``BLOCK`` symbols, the vector before the block and the cost between, so a conversation
is processed block by block from its end by lookup. For the audit, each block is expanded backward from its right
border into the vectors between its rows; a second table then gives, for the vector behind a row, the row's symbol and
the state before it, the least edits in ASCII order among the cheapest, so ties fall the same way on every path.

Long conversations are cut into segments of at most ``2**PART_BITS`` rows. A segment is worked on for each of the four
states at its right border (cost matrix), then, with its true border vector, for each of the four states at its left
border (edits); a conversation only puts together what its segments found. Rows get their place by a range shuffle
without texts, so one hot conversation is spread over tasks. Texts move once, to be written out as repaired messages.

Defined cases: null role or text is one blank; null turns come first, rows of one turn are in order of a digest of role
and text; a null conversation id is a conversation of its own; the initial of a role is its first character, others than
s, u, a fit nowhere; rows repeated whole are duplicates; a conversation whose rows are all deleted has no messages;
an empty table gives empty results; other columns are not returned.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxframe.llm.common import SPACE_CHARS, WORD, column
from rxframe.session import settle

BLOCK = 4
PART_BITS = 12
CELLS = 1 << 18
INF = 1 << 40
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a. Where each role may follow, and what rerole and insert make next.
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = (2, 2, 3, 2)
ROLE_OF = {2: "user", 3: "assistant"}
ENDS = (0, INF, INF, 0)
CLASSES = "sua?"
#: Symbols: sound rows by class, truncated rows by class, rows that must go, padding.
MUST_GO, PAD, SYMBOLS = 8, 9, 10
FINE, CUT, BLANK, AGAIN = range(4)
FOLDED = "conv_id long, part long, n long, blank long, duplicate long, truncated long, illegal long, turns long, first_class int, last_class int, first_turn long, last_turn long, low long, high long, matrix array<long>"
STATS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, part long, border array<long>"
TRACED = "conv_id long, part long, exits array<int>, audits array<string>"
AUDITED = "conv_id long, audit string"
MESSAGES = "conv_id long, place long, role string, text string"


def normalised(costs) -> tuple[tuple, int]:
    least = min(costs)
    return tuple(c - least if c < INF else INF for c in costs), least


def inserted(costs: list) -> list:
    """``costs`` where any number of turns may be inserted first."""
    out = list(costs)
    for _ in range(3):
        out = [min(c, INSERT + out[NEXT[q]]) for q, c in enumerate(out)]
    return [min(c, INF) for c in out]


def options(symbol: int, state: int, behind: tuple) -> list[tuple[str, int, int]]:
    """Edit, state after it and cost to the end, of the ways to get past one row, in ASCII order."""
    ways = [("D", state, DELETE + behind[state])]
    if symbol < MUST_GO:
        extra = TRUNCATED if symbol >= 4 else 0
        to = AFTER.get((state, CLASSES[symbol % 4]))
        if to is not None:
            ways.append(("K", to, KEEP + extra + behind[to]))
        ways.append(("R", NEXT[state], REROLE + extra + behind[NEXT[state]]))
    return ways


def before(symbol: int, behind: tuple) -> list:
    """The costs before a row of ``symbol`` from the costs ``behind`` it."""
    if symbol == PAD:
        return list(behind)
    return inserted([min(cost for _, _, cost in options(symbol, q, behind)) for q in range(4)])


def least_edits(symbol: int, state: int, behind: tuple) -> tuple[str, int]:
    """The ASCII-least cheapest edits from ``state`` past one row, and the state after it."""
    if symbol == PAD:
        return "", state
    costs, out = before(symbol, behind), ""
    if costs[state] >= INF:
        return "", state  # no way from here to the right border
    while True:
        delete, *rest = options(symbol, state, behind)
        if delete[2] == costs[state]:
            return out + "D", delete[1]
        if INSERT + costs[NEXT[state]] == costs[state]:
            out, state = out + "I", NEXT[state]
            continue
        return next((out + e, to) for e, to, cost in rest if cost == costs[state])


class Tables:
    """Vectors, their transitions by symbol and by block, and the edits of each (vector, symbol, state)."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors: list[tuple] = []
        self.number: dict[tuple, int] = {}
        units = [[0 if q == e else INF for q in range(4)] for e in range(4)]
        for costs in (ENDS, *units):
            self._add(normalised(inserted(costs))[0])
        step: list[list[tuple]] = []
        for vector in self.vectors:  # grows while it is read
            found = [normalised(before(s, vector)) for s in range(SYMBOLS)]
            step.append([(self._add(v), c) for v, c in found])
        self.next = np.array([[v for v, _ in row] for row in step], "i4")
        self.cost = np.array([[c for _, c in row] for row in step], "i8")
        # Block codes are decimal, first symbol first; the last symbol is processed first.
        go, pay = self.next, self.cost
        for _ in range(block - 1):
            go, pay = self.next[go].swapaxes(1, 2).reshape(len(go), -1), (pay[:, None, :] + self.cost[go].swapaxes(1, 2)).reshape(len(go), -1)
        self.block_next, self.block_cost = go, pay
        self.texts: list[str] = []
        of: dict[str, int] = {}
        self.edit = np.zeros((len(self.vectors), SYMBOLS, 4), "i4")
        self.exit = np.zeros((len(self.vectors), SYMBOLS, 4), "i4")
        for v, s, q in itertools.product(range(len(self.vectors)), range(SYMBOLS), range(4)):
            text, to = least_edits(s, q, self.vectors[v])
            self.edit[v, s, q] = of.setdefault(text, len(of))
            self.exit[v, s, q] = to
        self.texts = list(of)
        self.values = np.array(self.vectors, "i8")

    def _add(self, vector: tuple) -> int:
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector]

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """Block codes of rows of symbols, whose width is a multiple of the block."""
        powers = 10 ** np.arange(self.block - 1, -1, -1)
        return symbols.reshape(len(symbols), -1, self.block) @ powers

    def borders(self, codes: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vector behind each block, and before the first, from those ``right`` of the last; and the cost between."""
        at = np.empty((len(codes), codes.shape[1] + 1), "i4")
        at[:, -1] = right
        cost = np.zeros(len(codes), "i8")
        for k in range(codes.shape[1] - 1, -1, -1):
            cost += self.block_cost[at[:, k + 1], codes[:, k]]
            at[:, k] = self.block_next[at[:, k + 1], codes[:, k]]
        return at, cost

    def trace(self, symbols: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of four states on the left: numbers of the edits of each row, and the state on the right."""
        state = np.tile(np.arange(4, dtype="i4"), (len(symbols), 1))
        edits = np.zeros((len(symbols), 4, symbols.shape[1]), "i2")
        for k in range(symbols.shape[1] // self.block):
            inner = symbols[:, k * self.block : (k + 1) * self.block]
            behind = [borders[:, k + 1]]
            for j in range(self.block - 1, 0, -1):
                behind.append(self.next[behind[-1], inner[:, j]])
            for j, vector in enumerate(reversed(behind)):
                place = (vector[:, None], inner[:, j, None], state)
                edits[:, :, k * self.block + j] = self.edit[place]
                state = self.exit[place]
        return edits, state


_tables: dict[int, Tables] = {}


def tables(block: int = BLOCK) -> Tables:
    if block not in _tables:
        _tables[block] = Tables(block)
    return _tables[block]


def at_end(state: int) -> str:
    """What is still inserted behind the last row."""
    return {0: "", 1: "II", 2: "I", 3: ""}[state]


def cleaned(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role`` and ``text`` without nulls in the last two, and ``digest`` of conversation, role and text."""
    role, text = (F.coalesce(column(rows, c, "string"), F.lit(" ")) for c in ("role", "text"))
    out = rows.select(column(rows, "conv_id", "long").alias("conv_id"), column(rows, "turn", "long").alias("turn"), role.alias("role"), text.alias("text"))
    whole = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.length("role"), F.lit(":"), "role", "text")
    return out.withColumn("digest", F.unhex(F.sha2(whole, 256)))


def places(rows: DataFrame) -> DataFrame:
    """Cleaned rows without texts: ``conv_id``, ``turn``, ``digest``, ``class``, ``fault`` and ``pos``, their place."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    last = F.right(F.rtrim("text", F.lit(SPACE_CHARS)), F.lit(1))
    fault = F.when(~F.col("text").rlike(WORD), BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(FINE)
    slim = rows.select("conv_id", "turn", "digest", kind.cast("int").alias("class"), fault.cast("int").alias("fault"))
    keys = ["conv_id", "turn", "digest"]
    return slim.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pos", F.monotonically_increasing_id())


def segments(placed: DataFrame, part_bits: int = PART_BITS) -> DataFrame:
    """``conv_id``, ``part`` and up to ``2**part_bits`` rows in order; duplicates are rows behind the first of their digest."""
    first = placed.groupBy(F.col("digest").alias("_digest")).agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    marked = placed.join(first, F.col("digest") == F.col("_digest"), "left")
    again = (F.col("fault") != BLANK) & F.coalesce(F.col("_first") < F.col("pos"), F.lit(False))
    marked = marked.withColumn("fault", F.when(again, AGAIN).otherwise(F.col("fault")))
    row = F.struct("pos", "turn", F.col("class"), "fault")
    return marked.groupBy("conv_id", F.shiftright("pos", part_bits).alias("part")).agg(F.sort_array(F.collect_list(row)).alias("rows"))


def _symbols(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    kind, fault = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("class", "fault"))
    return np.where(fault >= BLANK, MUST_GO, kind + 4 * (fault == CUT)), kind


def _alike(lengths: np.ndarray, block: int):
    """Segments of about the same number of blocks, as many as fit into ``CELLS``; and their width."""
    blocks = -(-lengths // block)
    order = np.argsort(blocks, kind="stable")
    start = 0
    while start < len(order):
        stop = start + 1
        least = blocks[order[start]]
        while stop < len(order) and blocks[order[stop]] <= 2 * least and (stop - start) * blocks[order[stop]] * block < CELLS:
            stop += 1
        yield order[start:stop], int(blocks[order[stop - 1]]) * block
        start = stop


def _padded(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Segments as rows of one width, padded in front."""
    from_ = np.arange(width) - (width - lengths)[:, None]
    return np.where(from_ >= 0, symbols[np.maximum(starts[:, None] + from_, 0)], PAD)


def fold(found: DataFrame) -> DataFrame:
    """Counts of each segment and its cost matrix: from each state on the left to each on the right."""

    def run(batches):
        t = tables()
        for batch in batches:
            flat = batch.column("rows").flatten()
            symbols, kind = _symbols(flat)
            fault = flat.field("fault").to_numpy(zero_copy_only=False)
            turns = flat.field("turn").to_pylist()
            ends = np.cumsum(batch.column("rows").value_lengths().to_numpy())
            lengths = np.diff(np.r_[0, ends])
            starts = ends - lengths
            matrix = np.zeros((len(starts), 4, 4), "i8")
            for some, width in _alike(lengths, t.block):
                codes = t.codes(_padded(symbols, starts[some], lengths[some], width))
                for e in range(4):
                    unit, least = normalised(inserted([0 if q == e else INF for q in range(4)]))
                    at, cost = t.borders(codes, np.full(len(some), t.number[unit]))
                    matrix[some, :, e] = np.minimum(t.values[at[:, 0]] + cost[:, None] + least, INF)
            pair = np.zeros(len(kind), bool)
            pair[1:] = ~np.isin(kind[:-1] * 4 + kind[1:], [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])
            pair[starts] = False
            rows = []
            for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
                known = [x for x in turns[a:b] if x is not None]
                rows.append((
                    batch.column("conv_id")[i].as_py(), batch.column("part")[i].as_py(), b - a, *((fault[a:b] == f).sum() for f in (BLANK, AGAIN, CUT)),
                    pair[a:b].sum(), len(set(known)), kind[a], kind[b - 1], known[0] if known else None, known[-1] if known else None,
                    known[0] if known else None, known[-1] if known else None, matrix[i].ravel(),
                ))
            yield _batch(rows, FOLDED)

    return found.mapInArrow(run, FOLDED)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()),
        "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
    }
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def stats(folded: DataFrame) -> DataFrame:
    """One row a segment: counts and cost of the conversation, and the cost vector right of the segment."""
    fields = [f.split()[0] for f in FOLDED.split(", ")][1:]
    whole = folded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("parts"))

    def run(batches):
        for batch in batches:
            rows = []
            for conv, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                total = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
                for a, b in itertools.pairwise(parts):
                    total["illegal"] += (a["last_class"], b["first_class"]) not in {(0, 1), (1, 2), (2, 1)}
                known = [p for p in parts if p["low"] is not None]
                total["turns"] -= sum(a["last_turn"] == b["first_turn"] for a, b in itertools.pairwise(known))
                gaps = known[-1]["high"] - known[0]["low"] + 1 - total["turns"] if known else 0
                border, borders = inserted(list(ENDS)), []
                for p in reversed(parts):
                    borders.append(border)
                    m = np.array(p["matrix"]).reshape(4, 4)
                    border = np.minimum((m + np.array(border)).min(1), INF).tolist()
                for p, right in zip(parts, reversed(borders), strict=True):
                    rows.append((conv, gaps, total["blank"], total["duplicate"], total["truncated"], total["illegal"], border[0], p["part"], right))
            yield _batch(rows, STATS)

    return whole.mapInArrow(run, STATS)


def trace(found: DataFrame, borders: DataFrame) -> DataFrame:
    """The edits of each segment for each of four states on its left."""
    side = borders.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "border")
    met = found.join(side, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))).select("conv_id", "part", "rows", "border")

    def run(batches):
        t = tables()
        texts = np.array(t.texts, object)
        for batch in batches:
            symbols, _ = _symbols(batch.column("rows").flatten())
            ends = np.cumsum(batch.column("rows").value_lengths().to_numpy())
            lengths = np.diff(np.r_[0, ends])
            right = np.array([t.number[normalised(b)[0]] for b in batch.column("border").to_pylist()])
            out: list = [None] * len(lengths)
            for some, width in _alike(lengths, t.block):
                padded = _padded(symbols, (ends - lengths)[some], lengths[some], width)
                edits, exits = t.trace(padded, t.borders(t.codes(padded), right[some])[0])
                for k, i in enumerate(some):
                    out[i] = (exits[k], ["".join(texts[edits[k, q, width - lengths[i] :]]) for q in range(4)])
            rows = [(c, p, *o) for c, p, o in zip(batch.column("conv_id").to_pylist(), batch.column("part").to_pylist(), out, strict=True)]
            yield _batch(rows, TRACED)

    return met.mapInArrow(run, TRACED)


def audits(traced: DataFrame) -> DataFrame:
    """The edits of each conversation: those of its segments from the state where the one before ended."""
    whole = traced.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "exits", "audits"))).alias("parts"))

    def run(batches):
        for batch in batches:
            rows = []
            for conv, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                state, audit = 0, []
                for p in parts:
                    audit.append(p["audits"][state])
                    state = p["exits"][state]
                rows.append((conv, "".join([*audit, at_end(state)])))
            yield _batch(rows, AUDITED)

    return whole.mapInArrow(run, AUDITED)


def repair(rows: DataFrame, part_bits: int = PART_BITS) -> DataFrame:
    """``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost`` and ``audit`` of each conversation."""
    placed = settle(places(cleaned(rows)), "places")
    found = settle(segments(placed, part_bits), "segments")
    counted = settle(stats(fold(found)), "stats")
    edits = audits(trace(found, counted)).withColumnRenamed("conv_id", "_conv")
    one = counted.groupBy("conv_id").agg(*[F.first(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")])
    return one.join(edits, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


def messages(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """The repaired messages: ``conv_id``, ``place``, ``role`` and ``text``.

    All messages of a conversation come one after another in order of place, inside one partition; they are streamed,
    so a conversation may be any length.
    """
    texts = cleaned(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "digest", "role", "text", F.lit(None).cast("string").alias("audit"))
    edits = repaired.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"),
                            F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    keys = ["conv_id", "kind", "turn", "digest"]
    stream = texts.unionByName(edits).repartition("conv_id").sortWithinPartitions(*keys).drop("digest", "turn")

    def run(batches):
        conv, edits, state, place = None, iter(()), 0, 0

        def until_row():
            """Insertions up to the next edit of a row, and that edit."""
            nonlocal state, place
            for edit in edits:
                if edit != "I":
                    return edit
                state = NEXT[state]
                out.append((conv, place, ROLE_OF[state], ""))
                place += 1
            return None

        for batch in batches:
            out: list[tuple] = []
            for name, kind, role, text, audit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "audit")), strict=True):
                if kind == 0:
                    until_row()
                    conv, edits, state, place = name, iter(audit), 0, 0
                    continue
                edit = until_row()
                if edit == "D":
                    continue
                state = NEXT[state] if edit == "R" else AFTER[state, role[0]]
                out.append((conv, place, ROLE_OF[state] if edit == "R" else role, text))
                place += 1
            yield _batch(out, MESSAGES)
        out = []
        until_row()
        yield _batch(out, MESSAGES)

    return stream.mapInArrow(run, MESSAGES)


def digests(said: DataFrame) -> DataFrame:
    """SHA-256 of ``role:text`` lines of each conversation, from the ordered stream of ``messages``."""

    def run(batches):
        held: list = []
        for batch in batches:
            out = []
            for name, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
                if place == 0:
                    if held:
                        out.append((held[0], held[1].hexdigest()))
                    held = [name, hashlib.sha256()]
                else:
                    held[1].update(b"\n")
                held[1].update(f"{role}:{text}".encode())
            yield _batch(out, "conv_id long, repaired_sha256 string")
        yield _batch([(held[0], held[1].hexdigest())] if held else [], "conv_id long, repaired_sha256 string")

    return said.mapInArrow(run, "conv_id long, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """Rows with the faults that CRC-32 of ``conv_id:turn`` picks: dropped, emptied, unended, repeated or of the wrong role."""
    part = lambda c: F.coalesce(column(rows, c, "string"), F.lit(" "))
    pick = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    out = rows.select(column(rows, "conv_id", "long").alias("conv_id"), column(rows, "turn", "long").alias("turn"), part("role").alias("role"), part("text").alias("text"), pick.alias("pick"))
    text = F.when(F.col("pick") == 1, "").when(F.col("pick") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("pick") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("pick") == 3, 2).otherwise(1)))
    return out.filter("pick != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair_damaged(rows: DataFrame, part_bits: int = PART_BITS) -> DataFrame:
    """Every conversation of ``rows``, damaged and repaired, with ``repaired_sha256`` of its messages."""
    harmed = damage(rows)
    repaired = settle(repair(harmed, part_bits), "repaired")
    hashed = digests(messages(harmed, repaired)).withColumnRenamed("conv_id", "_hashed")
    every = rows.select(column(rows, "conv_id", "long").alias("id")).distinct()
    out = every.join(repaired, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(hashed, F.col("id").eqNullSafe(F.col("_hashed")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit(""), 256)
    return out.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
