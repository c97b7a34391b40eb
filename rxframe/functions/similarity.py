"""Batch string similarity used inside scoring tasks.

A task receives a bounded chunk of query texts and a bounded chunk of candidate texts of one block and
returns the best candidate per query. A cheap upper bound on every pair (shared letters, shared
words) decides which pairs are scored at all, so the result equals scoring every pair.
"""

from __future__ import annotations

import numpy as np

SLICE = 150_000  # pairs or windows scored at once
WORD = 64  # letters that fit one machine word


class Texts:
    """A list of texts as letter codes over one shared alphabet, with word statistics."""

    def __init__(self, texts: list[str], alphabet: np.ndarray):
        self.texts = texts
        self.n = len(texts)
        self.codes, self.length = _encode(texts, alphabet)
        self.alphabet = alphabet
        self._masks: np.ndarray | None = None

    def masks(self) -> np.ndarray:
        """Per text and letter, a word whose bits mark where the letter stands (first 64 only)."""
        if self._masks is None:
            masks = np.zeros((self.n, len(self.alphabet) + 1), dtype=np.uint64)
            rows = np.arange(self.n)
            for j in range(min(WORD, self.codes.shape[1])):
                masks[rows, self.codes[:, j]] |= np.uint64(1 << j)
            masks[:, 0] = 0
            self._masks = masks
        return self._masks

    def histogram(self) -> np.ndarray:
        out = np.zeros((self.n, len(self.alphabet) + 1), dtype=np.uint32)
        rows = np.arange(self.n)
        for j in range(self.codes.shape[1]):
            np.add.at(out, (rows, self.codes[:, j]), 1)
        return out[:, 1:]


def _letters(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)


def alphabet_of(*lists: list[str]) -> np.ndarray:
    """Sorted distinct letters; a letter's code is its place, counted from 1."""
    return np.unique(np.concatenate([_letters(texts) for texts in lists]))


def _encode(texts: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.fromiter(map(len, texts), dtype=np.int32, count=len(texts))
    width = max(1, int(length.max(initial=0)))
    flat = np.searchsorted(alphabet, _letters(texts)).astype(np.int32) + 1
    codes = np.zeros((len(texts), width), dtype=np.int32)
    codes[np.arange(width)[None, :] < length[:, None]] = flat
    return codes, length


def _lcs_long(a: str, b: str) -> int:
    """Longest common subsequence of two texts of any length, on arbitrary wide integers."""
    masks: dict[str, int] = {}
    for i, letter in enumerate(a):
        masks[letter] = masks.get(letter, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for letter in b:
        hit = state & masks.get(letter, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def _lcs_words(pattern: Texts, ip, text: Texts, it, start=None, size=None) -> np.ndarray:
    """Common subsequence length per pair; the pattern side has at most 64 letters.

    ``start``/``size`` limit the text side of each pair to a window.
    """
    masks = pattern.masks()
    start = np.zeros(len(ip), dtype=np.int64) if start is None else start
    size = text.length[it] if size is None else size
    state = np.full(len(ip), np.uint64(0xFFFFFFFFFFFFFFFF))
    last = text.codes.shape[1] - 1
    for j in range(int(size.max(initial=0))):
        codes = np.where(j < size, text.codes[it, np.minimum(start + j, last)], 0)
        hit = state & masks[ip, codes]
        state = (state + hit) | (state - hit)
    return np.bitwise_count(~state).astype(np.int32)


def lcs(a: Texts, ia: np.ndarray, b: Texts, ib: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ia), dtype=np.int32)
    short_a = a.length[ia] <= b.length[ib]
    fits = np.minimum(a.length[ia], b.length[ib]) <= WORD
    for left, il, right, ir, pick in (
        (a, ia, b, ib, short_a & fits),
        (b, ib, a, ia, ~short_a & fits),
    ):
        where = np.flatnonzero(pick)
        for s in range(0, len(where), SLICE):
            w = where[s : s + SLICE]
            out[w] = _lcs_words(left, il[w], right, ir[w])
    for w in np.flatnonzero(~fits):
        out[w] = _lcs_long(a.texts[ia[w]], b.texts[ib[w]])
    return out


def ratio(a: Texts, ia: np.ndarray, b: Texts, ib: np.ndarray) -> np.ndarray:
    """100 x (1 - insertions and deletions / total length)."""
    total = a.length[ia] + b.length[ib]
    distance = total - 2 * lcs(a, ia, b, ib)
    return (1.0 - distance / np.maximum(total, 1)) * 100.0


def _partial_one_way(short: Texts, i: np.ndarray, long: Texts, k: np.ndarray) -> np.ndarray:
    """Best ratio of the short text against windows of the long one (cut windows at both ends)."""
    best = np.zeros(len(i))
    if not len(i):
        return best
    m, n = short.length[i].astype(np.int64), long.length[k].astype(np.int64)
    windows = m + n - 1
    bounds = np.concatenate([[0], np.cumsum(windows)])
    step = 0
    while step < len(i):
        stop = max(step + 1, int(np.searchsorted(bounds, bounds[step] + SLICE, side="right")) - 1)
        pair = np.repeat(np.arange(step, stop), windows[step:stop])
        offset = np.arange(len(pair)) - (bounds[pair] - bounds[step]) - (m[pair] - 1)
        start = np.maximum(offset, 0)
        size = np.minimum(offset + m[pair], n[pair]) - start
        fits = m[pair] <= WORD
        common = np.zeros(len(pair), dtype=np.int64)
        if fits.any():
            common[fits] = _lcs_words(
                short, i[pair[fits]], long, k[pair[fits]], start[fits], size[fits]
            )
        for w in np.flatnonzero(~fits):
            window = long.texts[k[pair[w]]][start[w] : start[w] + size[w]]
            common[w] = _lcs_long(short.texts[i[pair[w]]], window)
        total = m[pair] + size
        score = (1.0 - (total - 2 * common) / total) * 100.0
        np.maximum.at(best, pair, score)
        step = stop
    return best


def partial_ratio(a: Texts, ia: np.ndarray, b: Texts, ib: np.ndarray) -> np.ndarray:
    """Best ratio of the shorter text against any window of the longer one."""
    la, lb = a.length[ia], b.length[ib]
    out = np.where((la == 0) & (lb == 0), 100.0, 0.0)
    live = (la > 0) & (lb > 0)
    for short, i, long, k, pick in (
        (a, ia, b, ib, live & (la <= lb)),
        (b, ib, a, ia, live & (lb <= la)),
    ):
        where = np.flatnonzero(pick)
        out[where] = np.maximum(out[where], _partial_one_way(short, i[where], long, k[where]))
    return out


class Words:
    """Word-level view of a list of texts."""

    def __init__(self, texts: list[str], alphabet: np.ndarray):
        split = [t.split() for t in texts]
        self.sets = [frozenset(w) for w in split]
        self.sorted = Texts([" ".join(sorted(w)) for w in split], alphabet)
        self.count = np.fromiter((len(s) for s in self.sets), dtype=np.int32, count=len(texts))
        self.letters = np.fromiter(
            (sum(map(len, s)) for s in self.sets), dtype=np.int32, count=len(texts)
        )
        self.repeats = np.fromiter(
            (len(w) != len(s) for w, s in zip(split, self.sets)), dtype=bool, count=len(texts)
        )


def shared_words(a: Words, b: Words) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct words, and letters in them, that each pair has in common."""
    rows_a: dict[str, list[int]] = {}
    rows_b: dict[str, list[int]] = {}
    for rows, words in ((rows_a, a), (rows_b, b)):
        for i, s in enumerate(words.sets):
            for w in s:
                rows.setdefault(w, []).append(i)
    count = np.zeros((len(a.sets), len(b.sets)), dtype=np.int64)
    letters = np.zeros_like(count)
    for w in rows_a.keys() & rows_b.keys():
        cell = np.ix_(rows_a[w], rows_b[w])
        count[cell] += 1
        letters[cell] += len(w)
    return count, letters


def _joined(letters, words):
    """Length of that many words joined by single blanks."""
    return letters + np.maximum(words - 1, 0)


class WeightedRatio:
    """The weighted ratio: best of plain, word-order-free and windowed ratios, each scaled.

    Length ratio below 1.5: plain or 0.95 x word ratio. Otherwise plain, s x windowed ratio or
    0.95 x s x windowed word ratio with s = 0.9 up to length ratio 8 and 0.6 beyond.
    """

    def __init__(self, queries: list[str], candidates: list[str]):
        alphabet = alphabet_of(queries, candidates, [" "])
        self.alphabet = alphabet
        self.q, self.c = Texts(queries, alphabet), Texts(candidates, alphabet)
        self.qw, self.cw = Words(queries, alphabet), Words(candidates, alphabet)
        self.common, self.common_letters = shared_words(self.qw, self.cw)

    def bound(self) -> np.ndarray:
        """An upper bound of the score of every pair."""
        bag = _shared_letters(self.q, self.c).astype(np.float32)
        lq = self.q.length[:, None].astype(np.float32)
        lc = self.c.length[None, :].astype(np.float32)
        total, short = lq + lc, np.minimum(lq, lc)
        stretch = np.maximum(lq, lc) / np.maximum(short, 1)
        plain = 200.0 * bag / np.maximum(total, 1)
        shared = self.common > 0
        repeats = self.qw.repeats[:, None] | self.cw.repeats[None, :]

        nq, nc = self.qw.count[:, None], self.cw.count[None, :]
        rest_q = _joined(self.qw.letters[:, None] - self.common_letters, nq - self.common)
        rest_c = _joined(self.cw.letters[None, :] - self.common_letters, nc - self.common)
        sect = _joined(self.common_letters, self.common)
        glue = shared.astype(np.int32)
        side_q, side_c = sect + glue + rest_q, sect + glue + rest_c
        rest_bag = np.minimum(
            np.minimum(rest_q, rest_c),
            bag - self.common_letters - np.minimum(nq, nc) + 1
            + np.maximum(np.minimum(nq, nc) - self.common - 1, 0),
        )
        rest = 100.0 * (1 - (rest_q + rest_c - 2 * rest_bag) / np.maximum(side_q + side_c, 1))
        by_sect = 100.0 * (1 - (glue + np.minimum(rest_q, rest_c)) / np.maximum(
            sect + np.where(rest_q <= rest_c, side_q, side_c), 1))
        contained = shared & ((nq == self.common) | (nc == self.common))
        word = np.where(shared, np.maximum(rest, by_sect), 0.0)
        word = np.where(contained | repeats, 100.0, np.maximum(word, plain))
        near = np.maximum(plain, 0.95 * word)

        reach = np.minimum(bag, short)
        window = 200.0 * reach / np.maximum(short + reach, 1)
        scale = np.where(stretch <= 8.0, 0.9, 0.6)
        word_window = np.where(shared | repeats, 100.0, window)
        far = np.maximum(plain, scale * np.maximum(window, 0.95 * word_window))

        out = np.where(stretch < 1.5, near, far)
        out[(lq[:, 0] == 0), :] = 0.0
        out[:, (lc[0] == 0)] = 0.0
        return out + 1e-3

    def score(self, i: np.ndarray, k: np.ndarray, floor: np.ndarray | None = None) -> np.ndarray:
        """Scores of pairs; a pair that cannot reach its ``floor`` may come back lower."""
        lq, lc = self.q.length[i], self.c.length[k]
        common = lcs(self.q, i, self.c, k)
        best = (1.0 - (lq + lc - 2 * common) / np.maximum(lq + lc, 1)) * 100.0
        short = np.minimum(lq, lc)
        stretch = np.maximum(lq, lc) / np.maximum(short, 1)
        near = np.flatnonzero(stretch < 1.5)
        best[near] = np.maximum(best[near], self._word_ratio(i[near], k[near]) * 0.95)
        far = np.flatnonzero(stretch >= 1.5)
        word_window = self._word_window(i[far], k[far])
        scale = np.where(stretch[far] <= 8.0, 0.9, 0.6)
        best[far] = np.maximum(best[far], word_window * 0.95 * scale)
        # No window shares more than the whole text does, which rules out most windowed ratios.
        reach = 200.0 * common[far] / np.maximum(short[far] + common[far], 1) * scale + 1e-3
        needed = best[far] if floor is None else np.maximum(best[far], floor[far])
        far, scale = far[reach >= needed], scale[reach >= needed]
        best[far] = np.maximum(best[far], partial_ratio(self.q, i[far], self.c, k[far]) * scale)
        best[(lq == 0) | (lc == 0)] = 0.0
        return best

    def _rest(self, i: np.ndarray, k: np.ndarray) -> tuple[Texts, np.ndarray, Texts, np.ndarray]:
        """Per pair, the sorted distinct words only one side has."""
        left, right = {}, {}
        il, ir = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.int64)
        for p, (x, y) in enumerate(zip(i, k)):
            a, b = self.qw.sets[x], self.cw.sets[y]
            il[p] = left.setdefault(" ".join(sorted(a - b)), len(left))
            ir[p] = right.setdefault(" ".join(sorted(b - a)), len(right))
        return Texts(list(left), self.alphabet), il, Texts(list(right), self.alphabet), ir

    def _word_ratio(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        out = ratio(self.qw.sorted, i, self.cw.sorted, k)
        common = self.common[i, k].astype(np.int32)
        sect = _joined(self.common_letters[i, k].astype(np.int32), common)
        contained = (common > 0) & ((self.qw.count[i] == common) | (self.cw.count[k] == common))
        out[contained] = 100.0
        mixed = np.flatnonzero(
            ~contained & ((common > 0) | self.qw.repeats[i] | self.cw.repeats[k])
        )
        if len(mixed):
            left, il, right, ir = self._rest(i[mixed], k[mixed])
            a, b = left.length[il], right.length[ir]
            distance = a + b - 2 * lcs(left, il, right, ir)
            sect, glue = sect[mixed], (common[mixed] > 0).astype(np.int32)
            side_a, side_b = sect + glue + a, sect + glue + b
            best = 100.0 - 100.0 * distance / np.maximum(side_a + side_b, 1)
            for rest, side in ((a, side_a), (b, side_b)):
                against = 100.0 - 100.0 * (glue + rest) / np.maximum(sect + side, 1)
                best = np.where(sect > 0, np.maximum(best, against), best)
            out[mixed] = np.maximum(out[mixed], best)
        return out

    def _word_window(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        out = np.full(len(i), 100.0)
        apart = np.flatnonzero(self.common[i, k] == 0)
        out[apart] = partial_ratio(self.qw.sorted, i[apart], self.cw.sorted, k[apart])
        again = apart[self.qw.repeats[i[apart]] | self.cw.repeats[k[apart]]]
        if len(again):
            left, il, right, ir = self._rest(i[again], k[again])
            out[again] = np.maximum(out[again], partial_ratio(left, il, right, ir))
        return out


def _shared_letters(a: Texts, b: Texts) -> np.ndarray:
    ha, hb = a.histogram(), b.histogram()
    out = np.zeros((a.n, b.n), dtype=np.uint32)
    for letter in range(ha.shape[1]):
        x, y = ha[:, letter], hb[:, letter]
        rows, cols = np.flatnonzero(x), np.flatnonzero(y)
        if len(rows) and len(cols):
            out[np.ix_(rows, cols)] += np.minimum.outer(x[rows], y[cols])
    return out


SCORERS = {"weighted": WeightedRatio}


def best_candidates(
    queries: list[str], candidates: list[str], scorer: str, whole: bool, cutoff: float
) -> tuple[np.ndarray, np.ndarray]:
    """Index and score of the best candidate per query; index -1 when none reaches ``cutoff``.

    ``whole`` compares scores cut to whole numbers and prefers the candidate closest in length;
    otherwise exact scores are compared. Remaining ties go to the earlier candidate.
    """
    model = SCORERS[scorer](queries, candidates)
    bound = model.bound()
    nq, nc = bound.shape
    gap = np.abs(model.q.length[:, None] - model.c.length[None, :]) if whole else None
    best = np.full(nq, -1, dtype=np.int64)
    top = np.full(nq, -np.inf)
    if whole:
        bound = np.floor(bound)
    open_ = bound >= cutoff
    width = 8
    while open_.any():
        rows = np.flatnonzero(open_.any(axis=1))
        live = np.where(open_[rows], bound[rows], -1.0)
        take = min(width, nc)
        if take < nc:
            cols = np.argpartition(-live, take - 1, axis=1)[:, :take]
        else:
            cols = np.broadcast_to(np.arange(nc), live.shape)
        i, k = np.repeat(rows, take), cols.ravel()
        keep = open_[i, k]
        i, k = i[keep], k[keep]
        open_[i, k] = False
        score = model.score(i, k, np.maximum(top[i], cutoff))
        score = np.floor(score) if whole else score
        ok = score >= cutoff
        i, k, score = i[ok], k[ok], score[ok]
        tie = gap[i, k] if whole else np.zeros(len(i), dtype=np.int64)
        order = np.lexsort((k, tie, -score, i))
        first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
        for p in first:
            r, c, s = i[p], k[p], score[p]
            if best[r] < 0:
                better = True
            elif s != top[r]:
                better = s > top[r]
            else:
                old = (gap[r, best[r]] if whole else 0, best[r])
                better = (tie[p], c) < old
            if better:
                best[r], top[r] = c, s
        open_ &= bound >= top[:, None]
        width *= 4
    return best, np.where(best >= 0, top, 0.0)
