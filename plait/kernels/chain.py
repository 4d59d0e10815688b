"""Colinear chaining of anchors.

An anchor is (begin1, end1, begin2, end2, weight) on a pair of paths, ends exclusive. A chain is a list
of anchors, each beginning where or after the one before ends on both sides. Its score is the weights'
sum, plus the scores of the differences in length between successive gaps if gaps are scored. A chain
must score strictly above nothing.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np


class PrefixMax:
    """Largest (value, item) over a prefix, under raises."""

    def __init__(self, n: int) -> None:
        self.value = [float("-inf")] * (n + 1)
        self.item = [-1] * (n + 1)

    def put(self, at: int, value: float, item: int) -> None:
        at += 1
        while at < len(self.value):
            if value > self.value[at]:
                self.value[at], self.item[at] = value, item
            at += at & -at

    def best(self, upto: int) -> tuple[float, int]:
        """Over places below ``upto``."""
        v, k = float("-inf"), -1
        while upto > 0:
            if self.value[upto] > v:
                v, k = self.value[upto], self.item[upto]
            upto -= upto & -upto
        return v, k


class PrefixMaxOf:
    """Largest value over a rectangle [0, a) x [b, ...), under raises: a tree of trees over the second
    coordinates that each node of the first will ever hold."""

    def __init__(self, points: list[tuple[int, float]], n: int) -> None:
        held: list[set[float]] = [set() for _ in range(n + 1)]
        for a, b in points:
            a += 1
            while a <= n:
                held[a].add(b)
                a += a & -a
        self.keys = [sorted(h, reverse=True) for h in held]  # descending: a suffix in b is a prefix here
        self.neg = [[-b for b in k] for k in self.keys]
        self.trees = [PrefixMax(len(k)) for k in self.keys]
        self.n = n

    def put(self, a: int, b: float, value: float, item: int) -> None:
        a += 1
        while a <= self.n:
            self.trees[a].put(bisect_left(self.neg[a], -b), value, item)
            a += a & -a

    def best(self, upto: int, least: float) -> tuple[float, int]:
        v, k = float("-inf"), -1
        while upto > 0:
            got = self.trees[upto].best(bisect_right(self.neg[upto], -least))
            if got[0] > v:
                v, k = got
            upto -= upto & -upto
        return v, k


def gap_value(diff: int, opens: tuple[float, ...], extends: tuple[float, ...], scale: float) -> float:
    return scale * max(-(o + e * abs(diff)) for o, e in zip(opens, extends)) if diff and opens else 0.0


def _trace(score: list[float], back: list[int]) -> tuple[float, list[int]]:
    if not score:
        return 0.0, []
    i = int(np.argmax(score))
    if score[i] <= 0:
        return 0.0, []
    best, out = score[i], []
    while i >= 0:
        out.append(i)
        i = back[i]
    return best, out[::-1]


def exhaustive(anchors: list[tuple], opens: tuple[float, ...] = (), extends: tuple[float, ...] = (), scale: float = 1.0) -> tuple[float, list[int]]:
    """(score, indices) by looking at every pair of anchors."""
    order = sorted(range(len(anchors)), key=lambda i: (anchors[i][1], anchors[i][3]))
    score, back = [0.0] * len(anchors), [-1] * len(anchors)
    for i in order:
        b1, _, b2, _, w = anchors[i]
        score[i] = w
        for j in order:
            _, e1, _, e2, _ = anchors[j]
            if j != i and e1 <= b1 and e2 <= b2:
                v = score[j] + w + gap_value((b1 - e1) - (b2 - e2), opens, extends, scale)
                if v > score[i]:
                    score[i], back[i] = v, j
    return _trace(score, back)


def sparse(anchors: list[tuple]) -> tuple[float, list[int]]:
    """The same without gap scores, in n log n: anchors enter by end on side 1 and ask by begin."""
    if not anchors:
        return 0.0, []
    ends = sorted({a[3] for a in anchors})
    tree = PrefixMax(len(ends))
    score, back = [0.0] * len(anchors), [-1] * len(anchors)
    events = sorted([(a[1], 0, i) for i, a in enumerate(anchors)] + [(a[0], 1, i) for i, a in enumerate(anchors)])
    # an anchor of no length would enter before it asks
    for i, a in enumerate(anchors):
        if a[1] <= a[0] or a[3] <= a[2]:
            raise ValueError(f"anchor {i} is empty")
    for _, asks, i in events:
        a = anchors[i]
        if asks:
            v, j = tree.best(bisect_right(ends, a[2]))
            score[i] = a[4] + max(v, 0.0)
            back[i] = j if v > 0 else -1
        else:
            tree.put(bisect_left(ends, a[3]), score[i], i)
    return _trace(score, back)


def sparse_affine(anchors: list[tuple], opens: tuple[float, ...], extends: tuple[float, ...], scale: float = 1.0) -> tuple[float, list[int]]:
    """The same with piecewise-affine gap scores, in n log^2 n. By diagonal d = end1 - end2, an earlier
    anchor lies above, below or on the asking one's; above, a piece costs open + extend * (d' - d), so its
    value plus the extension up to its own diagonal is kept, and the best is taken over ends on side 2 and
    diagonals; below alike; on the diagonal no gap is paid."""
    if not anchors:
        return 0.0, []
    n = len(anchors)
    ends = sorted({a[3] for a in anchors})
    place = [bisect_left(ends, a[3]) for a in anchors]
    # the gap is (b1 - e1) - (b2 - e2) = (b1 - b2) - (e1 - e2)
    own = [a[1] - a[3] for a in anchors]
    ask = [a[0] - a[2] for a in anchors]
    k = len(opens)
    above = [PrefixMaxOf([(p, d) for p, d in zip(place, own)], len(ends)) for _ in range(k)]  # d' >= ask
    below = [PrefixMaxOf([(p, -d) for p, d in zip(place, own)], len(ends)) for _ in range(k)]  # d' <= ask
    level: dict[int, PrefixMax] = {}
    score, back = [0.0] * n, [-1] * n
    events = sorted([(a[1], 0, i) for i, a in enumerate(anchors)] + [(a[0], 1, i) for i, a in enumerate(anchors)])
    for _, asks, i in events:
        a = anchors[i]
        if not asks:
            for t in range(k):
                e = scale * extends[t]
                above[t].put(place[i], own[i], score[i] - e * own[i], i)
                below[t].put(place[i], -own[i], score[i] + e * own[i], i)
            level.setdefault(own[i], PrefixMax(len(ends))).put(place[i], score[i], i)
            continue
        upto, d = bisect_right(ends, a[2]), ask[i]
        best, frm = 0.0, -1
        if d in level:
            v, j = level[d].best(upto)
            if v > best:
                best, frm = v, j
        for t in range(k):
            o, e = scale * opens[t], scale * extends[t]
            v, j = above[t].best(upto, d)
            if v + e * d - o > best:
                best, frm = v + e * d - o, j
            v, j = below[t].best(upto, -d)
            if v - e * d - o > best:
                best, frm = v - e * d - o, j
        score[i], back[i] = a[4] + best, frm
    return _trace(score, back)


def score_scale(anchors: list[tuple], chain: list[int]) -> float:
    """Weight of a free-gap chain per base that it covers on side 1."""
    covered = sum(anchors[i][1] - anchors[i][0] for i in chain)
    return sum(anchors[i][4] for i in chain) / covered if covered else 0.0


def reanchor_budget(sizes: list[int], total: int) -> list[int]:
    """Shares of a budget of match pairs by the product of the gaps' sizes, rounded up."""
    whole = sum(sizes)
    return [-(-total * s // whole) if whole else 0 for s in sizes]


def fill_in(chain: list[int], anchors: list[tuple], extra: list[tuple], opens=(), extends=(), scale: float = 1.0) -> list[tuple]:
    """Anchors of ``chain`` with those of ``extra`` that chain best inside each of its gaps."""
    held = [anchors[i] for i in chain]
    out: list[tuple] = []
    before = (0, 0)
    for after in [*held, None]:
        hi = (after[0], after[2]) if after else (float("inf"), float("inf"))
        inside = [a for a in extra if a[0] >= before[0] and a[2] >= before[1] and a[1] <= hi[0] and a[3] <= hi[1]]
        _, got = sparse_affine(inside, opens, extends, scale) if opens else sparse(inside)
        out += [inside[i] for i in got]
        if after:
            out.append(after)
            before = after[1], after[3]
    return out
