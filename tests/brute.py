"""Plain Python versions of operators, for comparison on small inputs."""

from __future__ import annotations

import math
import re

PAIR_TYPES = {"UU", "UR", "RU", "DD", "MM", "MU", "NM", "NN", "NU", "WW"}


def split_quoted(line: str) -> list[str] | None:
    """Fields of a tab-separated line; None where the quoting is broken."""
    out, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            j, text = i + 1, []
            while True:
                if j >= n:
                    return None
                if line[j] == '"':
                    if j + 1 < n and line[j + 1] == '"':
                        text.append('"')
                        j += 2
                        continue
                    break
                text.append(line[j])
                j += 1
            out.append("".join(text))
            j += 1
            if j < n and line[j] != "\t":
                return None
            i = j
        else:
            j = line.find("\t", i)
            j = n if j < 0 else j
            out.append(line[i:j])
            i = j
        if i >= n:
            return out
        i += 1
        if i == n:  # a tab at the end opens one more, empty field
            out.append("")
            return out


def reason(line: str | None, sizes: dict[str, int]) -> str | None:
    f = split_quoted(line or "")
    if f is None:
        return "quoting"
    if len(f) != 12:
        return "column_count"

    def number(x, low, high):
        return bool(re.fullmatch("[0-9]+", x)) and low <= int(x) <= high

    for c, p in ((f[1], f[2]), (f[3], f[4])):
        if c not in sizes and c != "!":
            return "bad_value"
        if p != "." and not number(p, 1, sizes.get(c, 0)):
            return "bad_value"
    if not ({f[5], f[6]} <= {"+", "-"} and f[7] in PAIR_TYPES and number(f[10], 0, 60) and number(f[11], 0, 60)):
        return "bad_value"
    return None


def periods_and_gaps(rows):
    """rows: (key, start, end) -> set of (key, kind, from, to)."""
    by = {}
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and s < e:
            by.setdefault(k, []).append((s, e))
    out = set()
    for k, iv in by.items():
        merged = []
        for s, e in sorted(iv):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        out |= {(k, "period", s, e) for s, e in merged}
        out |= {(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def mirrored(p, n):
    """The place that position p of a vector of n values stands for, the vector being continued by its mirror image."""
    p %= 2 * n
    return p if p < n else 2 * n - 1 - p


def smoothed(xs, sigma, at=None):
    """Gaussian mean of the known values around each place; None stays None."""
    reach, n = int(4 * sigma + 0.5), len(xs)

    def one(i):
        taps = [(math.exp(-0.5 * (k / sigma) ** 2) if k else 1.0, xs[mirrored(i + k, n)]) for k in range(-reach, reach + 1)]
        return sum(w * x for w, x in taps if x is not None) / sum(w for w, x in taps if x is not None)

    return [None if x is None else one(i) for i, x in enumerate(xs)]


def filled(xs, sigma=0.0):
    """Missing values on the line between the (smoothed) known ones beside them, constant beyond the ends."""
    known = [i for i, x in enumerate(xs) if x is not None]
    anchor = smoothed(xs, sigma) if sigma else xs

    def one(i):
        low, high = max((k for k in known if k < i), default=None), min((k for k in known if k > i), default=None)
        if low is None or high is None:
            return None if low is high else anchor[high if low is None else low]
        return anchor[low] + (anchor[high] - anchor[low]) * (i - low) / (high - low)

    return [one(i) if x is None else x for i, x in enumerate(xs)]


def diagonal_means(m, first):
    lines = [[m[i][i + d] for i in range(len(m) - d) if m[i][i + d] is not None] for d in range(first, len(m))]
    return [sum(x) / len(x) if x else None for x in lines]


def filled_map(m, sigma):
    """Every diagonal filled; one without values by the filled mean decay."""
    n, typical = len(m), filled(diagonal_means(m, 0))
    out = [[None] * n for _ in range(n)]
    for d in range(n):
        line = [m[i][i + d] for i in range(n - d)]
        width = sigma(d) if callable(sigma) else sigma
        line = filled(line, width) if any(x is not None for x in line) else [typical[d]] * len(line)
        for i, x in enumerate(line):
            out[i][i + d] = out[i + d][i] = x
    return out


def row_sums(m, flanks=False, k=1):
    n = len(m)
    sums = [sum(m[i][j] for j in range(n) if abs(i - j) >= k and m[i][j] is not None) for i in range(n)]
    if not flanks:
        return sums
    decay = [None, *filled(diagonal_means(m, 1))]
    return [s and s + sum(decay[d] for d in range(1, n) if d > i) + sum(decay[d] for d in range(1, n) if d > n - i) for i, s in enumerate(sums)]


def balanced(m, rounds, tol, sigma=None, flanks=False):
    """(map, biases): what :func:`weftmap.operators.balance.balance_map` must give for one region; ``sigma`` interpolates."""
    n, bias = len(m), [1.0] * len(m)

    def seen(first):
        w = [[None if x is None else x / (bias[i] * bias[j]) for j, x in enumerate(row)] for i, row in enumerate(m)]
        return filled_map(w, sigma) if sigma is not None else [[0.0 if x is None and first else x for x in row] for row in w]

    for k in range(rounds):
        s = row_sums(seen(k == 0), flanks)
        some = [x for x in s if x]
        bias = [b * x * len(some) / sum(some) if x else b for b, x in zip(bias, s)]
        if sum(x * x for x in s) / n - (sum(s) / n) ** 2 < tol:
            break
    return seen(False), bias


def peaks(xs, prominence):
    """(place, rise) of the tops: runs of equal values between lower ones, measured against every stretch beside them without a higher value."""
    out, n = [], len(xs)
    for a in range(1, n):
        b = a
        while b + 1 < n and xs[b + 1] == xs[a]:
            b += 1
        if b + 1 < n and xs[a - 1] < xs[a] > xs[b + 1]:
            left = min(min(xs[c : a + 1]) for c in range(a + 1) if max(xs[c : a + 1]) <= xs[a] and (c == 0 or xs[c - 1] > xs[a]))
            right = min(min(xs[b : c + 1]) for c in range(b, n) if max(xs[b : c + 1]) <= xs[a] and (c == n - 1 or xs[c + 1] > xs[a]))
            if xs[a] - max(left, right) >= prominence:
                out.append(((a + b) // 2, xs[a] - max(left, right)))
    return out
