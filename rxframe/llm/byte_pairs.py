"""Byte-level BPE over length-bucketed numpy matrices, and back.

A text is split by the pattern; each match is encoded on its own. A batch looks every distinct match up once: a match
that is a token as a whole takes its rank, the others are put into matrices of byte ids, one a length bucket, padded
with ``NONE``. Each round merges the leftmost pair of least rank in every row, closes the gap and looks the two changed
pairs up in a hash table of pairs (open addressing, in numpy arrays); rows without a pair left leave the matrix. So the
number of rounds is that of the longest row, and no row meets a loop of its own. Matches of more than ``LONGEST`` bytes,
whose rounds times length would grow with the square, keep the same pairs in a heap: same order of merges, same ids.

Ids are the ranks of the file, as the tiktoken library has them. A task remembers at most ``REMEMBERED`` matches and
works on at most ``CHUNK`` characters at once, however long a text is.

Defined cases: null text is empty and has no ids; a row without id is encoded like any other; repeated rows are encoded
each; an empty table gives an empty table; other columns are not returned. ``decode`` gives null for null ids and raises
``ValueError`` for an id outside of the vocabulary. The rank file is read by driver and tasks, so all need it at one path.
"""

from __future__ import annotations

import base64
import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rxframe.llm.common import column

#: Fixed value: no rank, no token.
NONE = 2**31 - 1
LONGEST = 4096
REMEMBERED = 300_000
CHUNK = 1 << 18
CELLS = 1 << 18
EMPTY = np.uint64(2**64 - 1)

_loaded: dict[tuple[str, str], Encoder] = {}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Pairs:
    """(left id, right id) to the id of their joined bytes: a hash table in two arrays, searched for many at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray):
        size = 1 << max(4, (3 * len(left)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, EMPTY)
        self.values = np.full(size, NONE, "i4")
        key = self._key(left, right)
        slot, rest = self._slot(key), np.arange(len(key))
        while len(rest):
            free = np.flatnonzero(self.keys[slot] == EMPTY)
            at, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[at], self.values[at] = key[rest[won]], joined[rest[won]]
            left_over = np.ones(len(rest), bool)
            left_over[won] = False
            rest, slot = rest[left_over], (slot[left_over] + np.uint64(1)) & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype("u8") << np.uint64(32) | right.astype("u8")

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40) & self.mask

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = self._key(left, right)
        out = np.full(len(key), NONE, "i4")
        slot, rest = self._slot(key), np.arange(len(key))
        while len(rest):
            found = self.keys[slot]
            hit = found == key[rest]
            out[rest[hit]] = self.values[slot[hit]]
            on = ~hit & (found != EMPTY)
            rest, slot = rest[on], (slot[on] + np.uint64(1)) & self.mask
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split = regex.compile(pattern)
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], "i4")
        cuts = [(ranks.get(t[:i]), ranks.get(t[i:]), r) for t, r in ranks.items() for i in range(1, len(t))]
        table = np.array([c for c in cuts if c[0] is not None and c[1] is not None], "i8").reshape(-1, 3)
        self.pairs = Pairs(*table.T)
        self._forget()

    def _forget(self):
        self.known: dict[str, int] = {}
        self.starts = np.zeros(0, "i8")
        self.lengths = np.zeros(0, "i8")
        self.pool = np.zeros(0, "i4")

    def merged(self, matches: list[bytes]) -> list[np.ndarray]:
        """The ids of each match, none of which is longer than ``LONGEST``."""
        out: list = [None] * len(matches)
        size = np.fromiter(map(len, matches), "i8", len(matches))
        bucket = np.ceil(np.log2(np.maximum(size, 2))).astype(int)
        for b in np.unique(bucket):
            rows = np.flatnonzero(bucket == b)
            step = max(1, CELLS >> int(b))
            for start in range(0, len(rows), step):
                self._rounds(matches, rows[start : start + step], size, out)
        return out

    def _rounds(self, matches: list[bytes], rows: np.ndarray, size: np.ndarray, out: list) -> None:
        width = int(size[rows].max())
        place = np.arange(width)
        inside = place < size[rows][:, None]
        ids = np.full(inside.shape, NONE, "i4")
        ids[inside] = self.single[np.frombuffer(b"".join(matches[i] for i in rows), "u1")]
        rank = np.full(inside.shape, NONE, "i4")
        two = inside[:, 1:]
        rank[:, :-1][two] = self.pairs(ids[:, :-1][two], ids[:, 1:][two])
        length = size[rows].copy()
        while len(rows):
            at = rank.argmin(1)
            line = np.arange(len(rows))
            least = rank[line, at]
            done = least == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[rows[i]] = ids[i, : length[i]].copy()
                live = ~done
                rows, length, at, least = rows[live], length[live], at[live], least[live]
                if not len(rows):
                    return
                width = int(length.max())
                ids, rank, line = ids[live, :width], rank[live, :width], np.arange(len(rows))
            # The joined id takes the place of the left one; all behind the right one moves up.
            behind = place[: ids.shape[1] - 1] > at[:, None]
            ids[line, at] = least
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(behind, rank[:, 1:], rank[:, :-1])
            ids[:, -1] = rank[:, -1] = NONE
            length -= 1
            self._again(ids, rank, line, at, at + 1 < length)
            self._again(ids, rank, line, at - 1, at > 0)

    def _again(self, ids: np.ndarray, rank: np.ndarray, line: np.ndarray, at: np.ndarray, has: np.ndarray) -> None:
        rank[line[~has & (at >= 0)], at[~has & (at >= 0)]] = NONE
        line, at = line[has], at[has]
        rank[line, at] = self.pairs(ids[line, at], ids[line, at + 1])

    def merged_long(self, match: bytes) -> np.ndarray:
        """The same merges for one long match: pairs in a heap by rank and place, neighbours as linked places."""
        get, n = self.ranks.get, len(match)
        begin, end = list(range(-1, n)), list(range(1, n + 2))  # places before and behind, by first byte
        tail = list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(match[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if gone[i] or tail[i] >= stop or end[i] >= n or tail[end[i]] != stop:
                continue
            j = end[i]
            gone[j] = 1
            tail[i], end[i] = stop, end[j]
            if end[i] < n:
                begin[end[i]] = i
                if (r := get(match[i : tail[end[i]]])) is not None:
                    heapq.heappush(heap, (r, i, tail[end[i]]))
            if begin[i] >= 0 and (r := get(match[begin[i] : stop])) is not None:
                heapq.heappush(heap, (r, begin[i], stop))
        return np.array([self.ranks[match[i : tail[i]]] for i in range(n) if not gone[i]], "i4")

    def _learn(self, matches: list[str]) -> None:
        new = [m for m in set(matches) if m not in self.known]
        if not new:
            return
        raw = [m.encode("utf-8", "surrogatepass") for m in new]
        whole = [self.ranks.get(r) for r in raw]
        open_ = [r for r, w in zip(raw, whole, strict=True) if w is None and len(r) <= LONGEST]
        found = iter(self.merged(open_))
        ids = [
            np.array([w], "i4") if w is not None else next(found) if len(r) <= LONGEST else self.merged_long(r)
            for r, w in zip(raw, whole, strict=True)
        ]
        lengths = np.fromiter(map(len, ids), "i8", len(ids))
        self.starts = np.r_[self.starts, len(self.pool) + np.cumsum(lengths) - lengths]
        self.lengths = np.r_[self.lengths, lengths]
        self.pool = np.concatenate([self.pool, *ids])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))

    def _codes(self, matches: list[str]) -> np.ndarray:
        """Ids of the matches one after another, and how many each has."""
        if len(self.known) > REMEMBERED:
            self._forget()
        self._learn(matches)
        code = np.fromiter(map(self.known.__getitem__, matches), "i8", len(matches))
        lengths, starts = self.lengths[code], self.starts[code]
        ends = np.cumsum(lengths)
        ids = self.pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, ends

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; the texts together hold about ``CHUNK`` characters, or are one longer text."""
        if len(texts) == 1 and len(texts[0] or "") > CHUNK:
            parts = iter(m.group() for m in self.split.finditer(texts[0]))
            return [np.concatenate([self._codes(some)[0] for some in iter(lambda: list(itertools.islice(parts, CHUNK // 4)), [])])]
        split = [self.split.findall(t) if t else [] for t in texts]
        ids, ends = self._codes(list(itertools.chain.from_iterable(split)))
        cuts = np.r_[0, ends][np.cumsum([0, *map(len, split)])]
        return [ids[i:j] for i, j in itertools.pairwise(cuts)]


def encoder(ranks: str, pattern: str) -> Encoder:
    if (ranks, pattern) not in _loaded:
        _loaded[ranks, pattern] = Encoder(read_ranks(ranks), pattern)
    return _loaded[ranks, pattern]


def chunks(texts: list[str | None], size: int = CHUNK):
    """Slices of ``texts`` of at most ``size`` characters; a longer text is a slice of its own."""
    start = held = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and held + n > size:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(texts):
        yield slice(start, len(texts))


def round_trip(docs: DataFrame, ident: str = "doc_id", text: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``decode`` of ``encode`` in one Python step: half the workers, and the ids pass between them without a copy."""
    path, pat = ranks or default_ranks(), pattern or default_pattern()

    def run(batches):
        work = encoder(path, pat)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in chunks(texts):
                found = work.encode(texts[part])
                ends = np.cumsum([0, *map(len, found)]).astype("i4")
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype("i4")))
                data = pa.array([joined(work.bytes, listed) for listed in found], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], ids, data], ["doc_id", "ids", "bytes"])

    slim = docs.select(column(docs, ident, "long").alias("doc_id"), column(docs, text, "string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, ids array<int>, bytes binary")


def joined(table: list[bytes], ids: np.ndarray) -> bytes:
    """The bytes that ids stand for."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(table)):
        raise ValueError("an id outside of the vocabulary")
    return b"".join(map(table.__getitem__, ids.tolist()))


def encode(docs: DataFrame, ident: str = "doc_id", text: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` of each document."""
    path, pat = ranks or default_ranks(), pattern or default_pattern()

    def run(batches):
        work = encoder(path, pat)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in chunks(texts):
                found = work.encode(texts[part])
                ends = np.cumsum([0, *map(len, found)]).astype("i4")
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype("i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], ids], ["doc_id", "ids"])

    slim = docs.select(column(docs, ident, "long").alias("doc_id"), column(docs, text, "string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` and the ``bytes`` that they stand for."""
    path, pat = ranks or default_ranks(), pattern or default_pattern()

    def run(batches):
        table = encoder(path, pat).bytes
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                data = None if ids is None else joined(table, ids.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], batch.column(1)[i : i + 1], pa.array([data], pa.binary())], ["doc_id", "ids", "bytes"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, bytes binary")
