"""Suffix arrays, tries and deterministic automata on small inputs."""

from __future__ import annotations

import numpy as np


def suffix_array(codes: list[int] | np.ndarray) -> np.ndarray:
    """Starts of suffixes in order, by doubling the length that ranks tell apart."""
    rank = np.unique(np.asarray(codes), return_inverse=True)[1].astype(np.int64)
    n, k = len(rank), 1
    if n == 0:
        return np.empty(0, dtype=np.int64)
    while True:
        second = np.full(n, -1, dtype=np.int64)
        second[: n - k] = rank[k:] if k < n else []
        order = np.lexsort((second, rank))
        new = np.concatenate(([0], np.cumsum((np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0))))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1 or k >= n:
            return order
        k *= 2


def common_prefixes(codes, order) -> np.ndarray:
    """Length of the prefix that each suffix in order shares with the one before (0 for the first)."""
    n = len(codes)
    place, out, h = np.empty(n, dtype=np.int64), np.zeros(n, dtype=np.int64), 0
    place[order] = np.arange(n)
    for i in range(n):
        if place[i]:
            j = order[place[i] - 1]
            while i + h < n and j + h < n and codes[i + h] == codes[j + h]:
                h += 1
            out[place[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out


class Trie:
    """Sequences of nodes, sharing prefixes."""

    def __init__(self) -> None:
        self.children: list[dict[int, int]] = [{}]
        self.value: list[int | None] = [None]
        self.paths: dict[str, int] = {}

    def insert(self, name: str, items: list[int]) -> int:
        """The node that the sequence ends at."""
        at = 0
        for x in items:
            if x not in self.children[at]:
                self.children[at][x] = len(self.children)
                self.children.append({})
                self.value.append(x)
            at = self.children[at][x]
        self.paths[name] = at
        return at

    def follow(self, items: list[int]) -> int | None:
        """The node that a prefix ends at; None if no sequence begins with it."""
        at = 0
        for x in items:
            if (at := self.children[at].get(x, -1)) < 0:
                return None
        return at


def reverse_deterministic(labels: str, pred: list[list[int]], sinks: list[int]) -> tuple[str, list[tuple[int, int]], list[frozenset[int]]]:
    """(labels, edges, members) of a graph with the same walks in which no node has two predecessors of one
    label, by subset construction backwards from the sinks. Exponential in the worst case."""

    def split(nodes) -> dict[str, frozenset[int]]:
        by: dict[str, set[int]] = {}
        for v in nodes:
            by.setdefault(labels[v], set()).add(v)
        return {c: frozenset(s) for c, s in by.items()}

    names: dict[frozenset[int], int] = {}
    out, edges, todo = [], [], []

    def name(s: frozenset[int]) -> int:
        if s not in names:
            names[s] = len(out)
            out.append(s)
            todo.append(s)
        return names[s]

    for s in split(sinks).values():
        name(s)
    while todo:
        s = todo.pop()
        for p in split({p for v in s for p in pred[v]}).values():
            edges.append((name(p), names[s]))
    return "".join(labels[next(iter(s))] for s in out), sorted(edges), out
