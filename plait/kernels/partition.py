"""One-dimensional segmentations: which stretches of a chain to align, and which to leave.

Items are (score, length) in order, with the (score, length) of what lies between neighbours. A segment
is a stretch of items with all that lies between them; a partition is a list of half-open segments.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

import numpy as np

Segments = list[tuple[int, int]]


def _sums(items, between) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums (score, length): a segment [i, j) has end[j - 1] - begin[i]."""
    n = len(items)
    begin, end = np.zeros((n, 2)), np.zeros((n, 2))
    at = np.zeros(2)
    for i, x in enumerate(items):
        begin[i] = at
        at = at + np.array(x, dtype=float)
        end[i] = at
        if i + 1 < n:
            at = at + np.array(between[i], dtype=float)
    return begin, end


def _walk(back: list[tuple[int, int] | None], at: int) -> Segments:
    """Follow choices down from ``at``: None leaves an item out, else the segment ending there."""
    out: Segments = []
    while at > 0:
        if back[at] is None:
            at -= 1
        else:
            out.append(back[at])
            at = back[at][0]
    return out[::-1]


def maximum_weight(items, between, least: float) -> Segments:
    """Segments of the greatest sum of scores minus ``least`` for each segment, in linear time."""
    if not len(items):
        return []
    begin, end = _sums(items, between)
    best, back = [0.0] * (len(items) + 1), [None] * (len(items) + 1)
    open_, start = float("-inf"), -1
    for j in range(1, len(items) + 1):
        v = best[j - 1] - begin[j - 1, 0]
        if v > open_:
            open_, start = v, j - 1
        best[j] = best[j - 1]
        v = open_ + end[j - 1, 0] - least
        if v > best[j]:
            best[j], back[j] = v, (start, j)
    return _walk(back, len(items))


class _Fenwick:
    def __init__(self, n: int) -> None:
        self.v, self.k = [float("-inf")] * (n + 1), [-1] * (n + 1)

    def put(self, at: int, v: float, k: int) -> None:
        at += 1
        while at < len(self.v):
            if v > self.v[at]:
                self.v[at], self.k[at] = v, k
            at += at & -at

    def best(self, upto: int) -> tuple[float, int]:
        v, k = float("-inf"), -1
        while upto > 0:
            if self.v[upto] > v:
                v, k = self.v[upto], self.k[upto]
            upto -= upto & -upto
        return v, k


def average_constrained(items, between, least: float, average: float) -> Segments:
    """As :func:`maximum_weight`, of segments whose score over length is at least ``average``: with
    t = score - average * length in prefix sums, a start serves an end if its t is no greater."""
    n = len(items)
    if not n:
        return []
    begin, end = _sums(items, between)
    tb, te = begin[:, 0] - average * begin[:, 1], end[:, 0] - average * end[:, 1]
    # equal but for rounding counts as equal
    keys = sorted(set(np.round(tb, 9).tolist()))
    tree = _Fenwick(len(keys))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        tree.put(bisect_left(keys, round(float(tb[j - 1]), 9)), best[j - 1] - begin[j - 1, 0], j - 1)
        best[j] = best[j - 1]
        v, i = tree.best(bisect_left(keys, round(float(te[j - 1]), 9) + 1e-9 * 0.5))
        v += end[j - 1, 0] - least
        if i >= 0 and v > best[j]:
            best[j], back[j] = v, (i, j)
    return _walk(back, n)


def bad_windows(items, between, average: float, window: float) -> list[bool]:
    """For each item, whether the stretch of ``window`` length that begins with it falls short of the
    average; a stretch that the end cuts is judged over what it has. Items and what lies between them
    count in proportion where the window's end cuts them."""
    n = len(items)
    begin, end = _sums(items, between)
    edges = np.stack([begin[:, 1], end[:, 1]], axis=1).ravel()
    values = np.stack([begin[:, 0], end[:, 0]], axis=1).ravel()
    out = []
    for i in range(n):
        stop = min(begin[i, 1] + window, edges[-1])
        out.append(bool(np.interp(stop, edges, values) - begin[i, 0] < average * (stop - begin[i, 1]) - 1e-9))
    return out


def window_average(items, between, least: float, average: float, window: float) -> Segments:
    """As :func:`maximum_weight`, of segments in which every window meets the average: a window that begins
    with an item and ends inside the segment must; a segment shorter than a window must as a whole. Starts
    that a bad window rules out for later ends leave, so each item enters and leaves once; short segments
    are looked at one by one."""
    n = len(items)
    if not n:
        return []
    begin, end = _sums(items, between)
    bad = bad_windows(items, between, average, window)
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    long_, limit, first_long = deque(), 0, 0  # starts of segments of a window or more, values falling
    for j in range(1, n + 1):
        # items whose window has ended by now: a bad one rules out all starts up to it
        while first_long < j and begin[first_long, 1] + window <= end[j - 1, 1]:
            if bad[first_long]:
                limit = first_long + 1
            v = best[first_long] - begin[first_long, 0]
            while long_ and long_[-1][0] <= v:
                long_.pop()
            long_.append((v, first_long))
            first_long += 1
        while long_ and long_[0][1] < limit:
            long_.popleft()
        best[j] = best[j - 1]
        if long_ and (v := long_[0][0] + end[j - 1, 0] - least) > best[j]:
            best[j], back[j] = v, (long_[0][1], j)
        for i in range(max(first_long, limit), j):
            size, score = end[j - 1, 1] - begin[i, 1], end[j - 1, 0] - begin[i, 0]
            if score >= average * size - 1e-9 and (v := best[i] + score - least) > best[j]:
                best[j], back[j] = v, (i, j)
    return _walk(back, n)


def value(items, between, segments: Segments, least: float) -> float:
    begin, end = _sums(items, between)
    return float(sum(end[j - 1, 0] - begin[i, 0] - least for i, j in segments))


def weak_anchors(scores: list[float], gaps: list[int], share: float, least_gap: int) -> list[tuple[int, int]]:
    """Runs of anchors to take out because they pin a large gap: ``gaps[i]`` is the difference in length
    before anchor i (one more after the last). A run between two gaps of at least ``least_gap`` bases goes
    if its scores sum to less than ``share`` of the chain's; longest runs first, without overlap."""
    total, out, used = sum(scores), [], [False] * len(scores)
    large = [i for i, g in enumerate(gaps) if abs(g) >= least_gap]
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    spans = [(i, j) for x, i in enumerate(large) for j in large[x + 1 :] if sums[j] - sums[i] < share * total]
    for i, j in sorted(spans, key=lambda t: (t[0] - t[1], t[0])):
        if not any(used[i:j]):
            used[i:j] = [True] * (j - i)
            out.append((i, j))
    return sorted(out)


def longest_near_optimal(shared: list[tuple[float, float, float]], between: list[tuple[float, float, float]], least_length: float, share: float) -> Segments:
    """Stretches of (length, first score, second score) items, each at least ``least_length`` long, whose
    second score is at least ``share`` of the first, that cover the greatest length. A stretch's t =
    second - share * first must not fall from its start to its end."""
    n = len(shared)
    if not n:
        return []
    pos, t = np.zeros((n, 2)), np.zeros((n, 2))
    length = lean = 0.0
    for i, (x, a, b) in enumerate(shared):
        pos[i, 0], t[i, 0] = length, lean
        length, lean = length + x, lean + b - share * a
        pos[i, 1], t[i, 1] = length, lean
        if i + 1 < n:
            length, lean = length + between[i][0], lean + between[i][2] - share * between[i][1]
    keys = sorted(set(np.round(t[:, 0], 9).tolist()))
    tree = _Fenwick(len(keys))
    best, back, enter = [0.0] * (n + 1), [None] * (n + 1), 0
    for j in range(1, n + 1):
        while enter < j and pos[j - 1, 1] - pos[enter, 0] >= least_length:
            tree.put(bisect_left(keys, round(float(t[enter, 0]), 9)), best[enter] - pos[enter, 0], enter)
            enter += 1
        best[j] = best[j - 1]
        v, i = tree.best(bisect_left(keys, round(float(t[j - 1, 1]), 9) + 5e-10))
        if i >= 0 and v + pos[j - 1, 1] > best[j]:
            best[j], back[j] = v + pos[j - 1, 1], (i, j)
    return _walk(back, n)
