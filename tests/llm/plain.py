"""Plain versions of the operators for small inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = WORDS.findall(low)
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def smallest_reachable(ids, links):
    """The smallest id reachable from each id."""
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def near_components(docs: dict, width: int, percent: int):
    sets = {i: shingle_set(t, width) for i, t in docs.items()}
    by_word = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by_word[x].append(i)
    pairs = {(a, b) for own in by_word.values() for a in own for b in own if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, smallest_reachable(docs, links)


def exact_groups(rows):
    """keep id and size for (id, text) rows with distinct ids."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}


def fill(sizes: dict, weights=(5, 2, 1), repeats=3) -> dict:
    """Targets: shares by weight, full sources cut at ``repeats`` sizes, the rest shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        rest = total - sum(done.values())
        open_ = [s for s in names if s not in done]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > repeats * sizes[s]]
        if not full:
            return done | share
        done |= {s: repeats * sizes[s] for s in full}


def best_fit_count(lengths, capacity):
    """Sequences that best-fit decreasing needs, one piece at a time."""
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in room if r >= n]
        if fit:
            room.remove(min(fit))
            room.append(min(fit) - n)
        else:
            room.append(capacity - n)
    return len(room)


def damaged(rows):
    """(conv_id, turn, role, text) rows with the faults their CRC-32 picks."""
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        pick = zlib.crc32(name.encode()) % 20
        text = "" if pick == 1 else re.sub("[.!?]", "", text) if pick == 2 else text
        row = (conv, turn, "user" if pick == 4 else role, text)
        yield from [] if pick == 0 else [row, row] if pick == 3 else [row]


def repaired(rows):
    """Counts, cost, audit and hash of one conversation's (turn, role, text) rows, by comparing all edits row by row."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    go = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    then, name = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    def relaxed(best):
        for _ in range(3):
            best = {q: min(b, (best[then[q]][0] + 5, "I" + best[then[q]][1])) for q, b in best.items()}
        return best

    best = relaxed({0: (0, ""), 1: (10**9, ""), 2: (10**9, ""), 3: (0, "")})
    for (_, role, _), fault in reversed(list(zip(rows, faults, strict=True))):
        new = {}
        for q in range(4):
            ways = [(2 + best[q][0], "D" + best[q][1])]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                to = go.get((q, role[:1]))
                if to is not None:
                    ways.append((more + best[to][0], "K" + best[to][1]))
                ways.append((1 + more + best[then[q]][0], "R" + best[then[q]][1]))
            new[q] = min(ways)
        best = relaxed(new)
    cost, audit = best[0] if rows else (0, "")
    state, left, said = 0, iter(rows), []
    for edit in audit:
        role, text = next(left)[1:] if edit != "I" else ("", "")
        if edit == "D":
            continue
        state = go[state, role[:1]] if edit == "K" else then[state]
        said.append(f"{role if edit == 'K' else name[state]}:{text}")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = "".join(role[:1] or "?" for _, role, _ in rows)
    illegal = sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def hard_negatives(rows, per_anchor=5):
    """(anchor, positive, rank, negative, scores) of (id, integer vector, label) rows, all compared with all."""
    out = []
    for a, x, y in rows:
        if a % 100:
            continue
        scores = [(-sum(p * q for p, q in zip(x, v, strict=True)), b, z) for b, v, z in rows if b != a and len(v) == len(x)]
        for s, p, _ in sorted(t for t in scores if t[2] == y)[:per_anchor]:
            found = sorted(t for t in scores if t[2] != y and 80 * -s <= 100 * -t[0] <= 100 * -s)[:per_anchor]
            out += [(a, p, n + 1, b, -s, -t) for n, (t, b, _) in enumerate(found)]
    return out
