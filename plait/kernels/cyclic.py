"""Alignments of paths through cyclic graphs, and merging of tandem duplications.

A bond joins two stretches of one path that are copies of each other: a list of elements (offset1,
offset2, length) in order.
"""

from __future__ import annotations

from math import ceil

from plait.kernels.align import Pair, nonrepeating_common_subsequence, with_gaps

#: Runs of as many bases on either side, up to this, are read as mismatches.
MISMATCHES = 4

Bond = list[tuple[int, int, int]]


def close_short_gaps(alignment: list[Pair], most: int = MISMATCHES) -> list[Pair]:
    """Runs of gaps of one length on both sides, up to ``most``, become pairs."""
    out: list[Pair] = []
    i = 0
    while i < len(alignment):
        if None not in alignment[i]:
            out.append(alignment[i])
            i += 1
            continue
        j = i
        while j < len(alignment) and None in alignment[j]:
            j += 1
        one = [a for a, _ in alignment[i:j] if a is not None]
        two = [b for _, b in alignment[i:j] if b is not None]
        out += zip(one, two) if len(one) == len(two) <= most else alignment[i:j]
        i = j
    return out


def blocks(path1: list[int], path2: list[int]) -> list[list[Pair]]:
    """Colinear blocks (offset, offset) of two paths that may repeat nodes: the longest stretch of a common
    subsequence without repeats, then the same before and after it, until nothing is shared."""
    out: list[list[Pair]] = []
    todo = [(0, len(path1), 0, len(path2))]
    while todo:
        a, b, c, d = todo.pop()
        found = nonrepeating_common_subsequence(path1[a:b], path2[c:d])
        if not found:
            continue
        (x0, y0), (x1, y1) = found[0], found[-1]
        inner = with_gaps([(x - x0, y - y0) for x, y in found], x1 - x0 + 1, y1 - y0 + 1)
        out.append(close_short_gaps([(None if x is None else x + x0 + a, None if y is None else y + y0 + c) for x, y in inner]))
        if x0 and y0:
            todo.append((a, a + x0, c, c + y0))
        if a + x1 + 1 < b and c + y1 + 1 < d:
            todo.append((a + x1 + 1, b, c + y1 + 1, d))
    return sorted(out, key=lambda k: k[0])


def noncyclic_extension(path: list[int], intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each interval [begin, end) grown, first to the right and then to the left, as far as the path
    repeats no node in it and no other interval begins."""
    taken = sorted(intervals)
    out: list[tuple[int, int]] = []
    for i, (b, e) in enumerate(taken):
        seen = set(path[b:e])
        if len(seen) < e - b:
            raise ValueError("an interval repeats a node")
        stop = taken[i + 1][0] if i + 1 < len(taken) else len(path)
        while e < stop and path[e] not in seen:
            seen.add(path[e])
            e += 1
        floor = out[-1][1] if out else 0
        while b > floor and path[b - 1] not in seen:
            b -= 1
            seen.add(path[b])
        out.append((b, e))
    return out


def same_bond(a: Bond, b: Bond, slack: int) -> bool:
    """Whether two bonds join about the same stretches, either way round."""

    def spans(x: Bond) -> tuple[tuple[int, int], tuple[int, int]]:
        return (x[0][0], x[-1][0] + x[-1][2]), (x[0][1], x[-1][1] + x[-1][2])

    def close(p: tuple[int, int], q: tuple[int, int]) -> bool:
        inside = lambda s, t: s[0] - slack <= t[0] and t[1] <= s[1] + slack
        return inside(p, q) or inside(q, p)

    (a1, a2), (b1, b2) = spans(a), spans(b)
    return (close(a1, b1) and close(a2, b2)) or (close(a1, b2) and close(a2, b1))


def distinct_bonds(bonds: list[Bond], least_length: int, proportion: float = 0.1) -> list[Bond]:
    """One of each set of bonds that join the same stretches: in order, the longer of two stays, the later
    one on a tie."""
    slack, size = ceil(proportion * least_length), [sum(n for *_, n in b) for b in bonds]
    keep = [True] * len(bonds)
    for i, a in enumerate(bonds):
        for j in range(i + 1, len(bonds)):
            if keep[i] and same_bond(a, bonds[j], slack):
                if size[i] > size[j]:
                    keep[j] = False
                else:
                    keep[i] = False
    return [b for b, k in zip(bonds, keep) if k]


def bonded_pairs(path: list[int], bonds: list[Bond]) -> list[tuple[int, int]]:
    """Node pairs that bonds align, for merging within a graph."""
    return [(path[x + k], path[y + k]) for b in bonds for x, y, n in b for k in range(n)]


def masked(pairs: list[tuple[list[int], list[int]]], chain: list[tuple[list[int], list[int]]]) -> list[bool]:
    """Which match pairs share a node pair at one offset with a pair of the chain."""
    held = {p for a, b in chain for p in zip(a, b)}
    return [any(p in held for p in zip(a, b)) for a, b in pairs]


def trimmed(scores: list[float], lengths: list[float], least: float, window: float) -> tuple[int, int]:
    """[begin, end) of a stretch without end windows of lower average than ``least``: items go from an end
    while the window that begins there falls short."""

    def short(order: list[int]) -> bool:
        total = size = 0.0
        for i in order:
            part = min(1.0, (window - size) / lengths[i]) if lengths[i] else 1.0
            total, size = total + part * scores[i], size + part * lengths[i]
            if size >= window:
                break
        return total < least * size

    b, e = 0, len(scores)
    while b < e and short(list(range(b, e))):
        b += 1
    while b < e and short(list(range(e - 1, b - 1, -1))):
        e -= 1
    return b, e
