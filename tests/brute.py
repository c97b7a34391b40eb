"""Plain definitions used to check the scoring tasks."""


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a, b):
    total = len(a) + len(b)
    return (1.0 - (total - 2 * lcs(a, b)) / total) * 100.0 if total else 100.0


def partial(a, b):
    if not a or not b:
        return 100.0 if not a and not b else 0.0

    def one(s, t):
        return max(ratio(s, t[max(0, o) : o + len(s)]) for o in range(1 - len(s), len(t)))

    if len(a) == len(b):
        return max(one(a, b), one(b, a))
    return one(a, b) if len(a) < len(b) else one(b, a)


def weighted(a, b):
    if not a or not b:
        return 0.0
    stretch, base = max(len(a), len(b)) / min(len(a), len(b)), ratio(a, b)
    wa, wb = a.split(), b.split()
    both, only_a, only_b = set(wa) & set(wb), set(wa) - set(wb), set(wb) - set(wa)
    sa, sb = " ".join(sorted(wa)), " ".join(sorted(wb))
    xa, xb = " ".join(sorted(only_a)), " ".join(sorted(only_b))
    if stretch < 1.5:
        by_set = 100.0
        if not (both and (not only_a or not only_b)):
            sect = len(" ".join(both))
            glue = 1 if sect else 0
            left, right = sect + glue + len(xa), sect + glue + len(xb)
            by_set = 100.0 - 100.0 * (len(xa) + len(xb) - 2 * lcs(xa, xb)) / (left + right)
            if sect:
                by_set = max(
                    by_set,
                    100.0 - 100.0 * (1 + len(xa)) / (sect + left),
                    100.0 - 100.0 * (1 + len(xb)) / (sect + right),
                )
        return max(base, max(ratio(sa, sb), by_set) * 0.95)
    scale = 0.9 if stretch <= 8 else 0.6
    by_word = 100.0 if both else max(partial(sa, sb), partial(xa, xb))
    return max(base, partial(a, b) * scale, by_word * 0.95 * scale)


def edit(a, b):
    row = list(range(len(b) + 1))
    for r, x in enumerate(a, 1):
        new = [r]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    longer = max(len(a), len(b))
    return (longer - row[-1]) * 100.0 / longer if longer else 0.0
