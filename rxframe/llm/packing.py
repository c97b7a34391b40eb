"""Best-fit decreasing packing of documents into sequences of a fixed number of tokens.

A text's ids are cut into pieces no longer than a sequence. Best fit puts the longest pieces first, each into the
fullest open sequence that still has room. What that does depends on the lengths alone, and there are no more
lengths than ``capacity``: so the counts of pieces by length (at most ``capacity`` rows) are packed once, with runs
of equal pieces put into runs of equally full sequences, and every piece finds its place by its rank among the
pieces of its length. A segment tree over the remaining capacities finds the tightest open sequence in logarithmic
time. The result is that of best-fit decreasing over all pieces together, on any number of machines.

The plan has at most about ``24 * capacity`` runs, since a run of sequences that takes pieces keeps less than half
of its room each time: 100,000 runs or 5 MB for 4,096, whatever the input.

Defined cases: null text is empty, and an empty text is the end token alone; white space is dropped by the
tokenizer; a null id stays null; rows repeated whole are documents of their own; an empty table gives no pieces.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxframe.llm.common import column, running
from rxframe.session import settle

CAPACITY = 4096
END = 1
ROWS_PER_PART = 20_000
#: Parts whose ids a task remembers from one batch to the next.
REMEMBERED = 400_000
#: Fixed values of the tokenizer file: its parts of a lower-cased word. Words of other letters go to it whole.
PARTS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[^\W_]|(?:[^\w\s]|_)+")
SIMPLE = r"^[\x21-\x7e\x{bf}-\x{12f}\x{131}-\x{24f}]*$"

_tokenizers: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` one after another."""
    ends = np.cumsum(lengths)
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Ids of whole texts.

    This tokenizer drops white space and never joins across it, so a text is the ids of its words one after another,
    and a word of common letters is that of its parts. A batch looks each distinct word up once and splits the
    distinct words at once; ids of parts are remembered up to a bound, and new parts reach the tokenizer together.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {}

    def _learn(self, parts: list[str]) -> list[bytes]:
        """One call for all new parts: a blank ends a part, and the tokenizer says which part an id is of."""
        new = [p for p in parts if p not in self.parts]
        if new:
            encoded = self.tokenizer.encode(" ".join(new), add_special_tokens=False)
            ids, of = np.array(encoded.ids, "<u4"), np.array(encoded.word_ids)
            cuts = np.searchsorted(of, np.arange(len(new) + 1))
            self.parts.update((p, ids[i:j].tobytes()) for p, i, j in zip(new, cuts[:-1], cuts[1:], strict=True))
        found = [self.parts[p] for p in parts]
        if len(self.parts) > REMEMBERED:
            # Parts met first are the frequent ones.
            self.parts = dict(itertools.islice(self.parts.items(), REMEMBERED // 2))
        return found

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of common letters, one after another, and the number of each."""
        coded = pa.array(PARTS.findall("\n".join([*words, ""]).lower())).dictionary_encode()
        parts, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        ends = np.flatnonzero(code == parts.index("\n"))
        found = self._learn([p for p in parts if p != "\n"])
        found.insert(parts.index("\n"), b"")
        lengths = np.fromiter(map(len, found), "i8", len(found)) // 4
        ids = _gather(np.frombuffer(b"".join(found), "<u4"), (np.cumsum(lengths) - lengths)[code], lengths[code])
        return ids, np.diff(np.r_[0, np.cumsum(lengths[code])[ends]])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of an Arrow batch, which is bounded in bytes."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = words.flatten().dictionary_encode()
        distinct, code = coded.dictionary, coded.indices.to_numpy()
        plain = pc.and_(pc.match_substring_regex(distinct, SIMPLE), pc.invert(pc.match_substring(distinct, "<|")))
        lengths, pools = np.zeros(len(distinct), "i8"), []
        mask = plain.to_numpy(zero_copy_only=False)
        if mask.any():
            ids, lengths[mask] = self._plain(distinct.filter(plain).to_pylist())
            pools.append(ids)
        if not mask.all():
            found = self.tokenizer.encode_batch(distinct.filter(pc.invert(plain)).to_pylist(), add_special_tokens=False)
            lengths[~mask] = [len(e.ids) for e in found]
            pools.append(np.array(list(itertools.chain.from_iterable(e.ids for e in found)), "<u4"))
        # Plain words stand first in the pool.
        order = np.r_[np.flatnonzero(mask), np.flatnonzero(~mask)]
        starts = np.empty(len(distinct), "i8")
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        ids = _gather(np.concatenate(pools) if pools else np.array([], "<u4"), starts[code], lengths[code])
        cuts = np.r_[0, np.cumsum(lengths[code])][words.offsets.to_numpy() - words.offsets[0].as_py()]
        return [ids[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def encoder(path: str) -> Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def pieces(
    docs: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``) of each piece of each document."""
    path = tokenizer or default_tokenizer()

    def cut(batches):
        encode = encoder(path).encode
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for name, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for number, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    row = (name, number, start, len(part), zlib.crc32(part.tobytes()), part if with_ids else None)
                    for values, value in zip(out, row, strict=True):
                        values.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            arrays = [pa.array(v, k) for v, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names[: 5 + with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    slim = docs.select(column(docs, ident, "long").alias("doc_id"), column(docs, text, "string").alias("text"))
    return slim.mapInArrow(cut, schema)


class OpenSequences:
    """Runs of open sequences by remaining capacity, with a segment tree over the capacities."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.runs: dict[int, deque[tuple[int, int]]] = {}

    def _count(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.tree[node] += by
            node //= 2

    def put(self, room: int, first: int, n: int, front: bool = False) -> None:
        if room and n:
            runs = self.runs.setdefault(room, deque())
            runs.appendleft((first, n)) if front else runs.append((first, n))
            self._count(room, 1)

    def take(self, room: int) -> tuple[int, int]:
        self._count(room, -1)
        return self.runs[room].popleft()

    def tightest(self, least: int) -> int | None:
        """The least remaining capacity of an open sequence that is ``least`` or more."""
        node = self.leaves + least
        if self.tree[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, pieces, first sequence, pieces in each, offset), and the number of sequences.

    Equal pieces go on filling the sequence that took the first of them, since it stays the tightest.
    """
    still, runs, sequences = OpenSequences(capacity), [], 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = still.tightest(length)
            if room is None:
                room, first = capacity, sequences
                n = -(-left // (capacity // length))
                sequences += n
            else:
                first, n = still.take(room)
            each, used = room // length, capacity - room
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, used))
                still.put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            first, n = first + full, n - full
            if n and left:
                runs.append((length, rank, left, first, left, used))
                still.put(room - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            still.put(room, first, n, front=True)
    return np.array(runs, dtype="i8").reshape(-1, 6), sequences


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset``. ``cut`` has a stable ``row_id``, ``doc_id``, ``piece``, ``length``."""
    lengths = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in lengths.collect()}  # at most ``capacity`` rows
    runs, _ = best_fit(counts, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    keys = (runs[:, 0] << 44) + runs[:, 1]

    def find(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            run = runs[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            within = rank - run[:, 1]
            own = batch.drop_columns(["rank"])
            arrays = [pa.array(run[:, 3] + within // run[:, 4]), pa.array(run[:, 5] + within % run[:, 4] * length)]
            yield pa.RecordBatch.from_arrays([*own.columns, *arrays], [*own.schema.names, "sequence_id", "offset"])

    spread = F.broadcast(lengths.select("length", F.ceil(F.col("n") / ROWS_PER_PART).alias("_parts")))
    ranked = cut.join(spread, "length").select(
        *cut.columns,
        F.expr("pmod(xxhash64(doc_id, piece), _parts)").alias("_part"),
        F.lit(1).cast("long").alias("_one"),
    )
    ranked = running(ranked, ["length"], "_part", ["doc_id", "piece", "row_id"], "_one", "rank")
    ranked = ranked.select(*cut.columns, (F.col("rank") - 1).alias("rank"))
    schema = ", ".join(f"`{n}` {k}" for n, k in cut.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(find, schema)


def pack(docs: DataFrame, ident: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its place; the texts are read and encoded once."""
    cut = pieces(docs, ident, text, tokenizer, capacity).withColumn("row_id", F.monotonically_increasing_id())
    return place(settle(cut, "pieces"), capacity).drop("row_id")


def sequences(docs: DataFrame, ident: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``ids`` and the ``documents`` in them. A group holds one sequence."""
    cut = pieces(docs, ident, text, tokenizer, capacity, with_ids=True).withColumn("row_id", F.monotonically_increasing_id())
    cut = settle(cut, "pieces")
    placed = place(cut.drop("ids"), capacity).select("row_id", "sequence_id", "offset")
    rows = cut.join(placed, "row_id").groupBy("sequence_id")
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return rows.agg(inside.alias("p")).select(
        "sequence_id",
        F.flatten(F.col("p.ids")).alias("ids"),
        F.transform("p", lambda x: F.struct(x.doc_id.alias("doc_id"), x.piece.alias("piece"), x.offset.alias("offset"))).alias("documents"),
    )
