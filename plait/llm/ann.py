"""Approximate nearest neighbours by a hash-prefix forest.

Every shard of the table holds a forest: for each tree a sorted array of hash strings of ``BITS``
signs of random projections. A query descends each tree by binary search to its longest matching
prefix, and all trees ascend together, one bit at a time, until the rows that share the current
prefix in some tree are enough candidates; these are scored on the original vectors.

How many are enough is measured, not guessed: on a bounded sample of the table the search is compared
with brute force, and the share of a shard to gather is the least one (from a fixed ladder) that finds
``TARGET`` of the true neighbours. Every row is indexed, and the sample bounds only this calibration.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.llm import vectors

TREES, BITS, SEED = 12, 24, 7
TARGET = 0.96
#: Rows and queries of the calibration sample, and the shares of a shard that are tried.
SAMPLE, SAMPLE_QUERIES = 8192, 128
LADDER = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)


class Forest:
    """Sorted hash strings of one shard, one array a tree."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> None:
        self.bits = bits
        planes = np.random.default_rng(seed).standard_normal((trees, rows.shape[1], bits))
        self.planes = planes
        self.sorted, self.order = [], []
        for p in planes:
            h = self._hash(rows, p)
            order = np.argsort(h, kind="stable")
            self.sorted.append(h[order])
            self.order.append(order)

    def _hash(self, x: np.ndarray, planes: np.ndarray) -> np.ndarray:
        weights = 1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64)
        return (x @ planes > 0) @ weights

    def candidates(self, queries: np.ndarray, enough: int):
        """For each query the positions of its candidates: all trees at the longest prefix length whose
        matches number ``enough`` over all trees, repeats included once."""
        n, trees = self.sorted[0].size, len(self.sorted)
        hashes = [self._hash(queries, p) for p in self.planes]
        length = np.full(len(queries), -1)
        low = np.zeros((trees, len(queries)), dtype=np.int64)
        high = np.full((trees, len(queries)), n, dtype=np.int64)
        for depth in range(self.bits, -1, -1):  # synchronous ascent
            todo = np.flatnonzero(length < 0)
            if not len(todo):
                break
            step = self.bits - depth
            lo, hi = np.empty((trees, len(todo)), dtype=np.int64), np.empty((trees, len(todo)), dtype=np.int64)
            for t in range(trees):
                prefix = hashes[t][todo] >> step << step
                lo[t] = np.searchsorted(self.sorted[t], prefix)
                hi[t] = np.searchsorted(self.sorted[t], prefix + (1 << step))
            found = (hi - lo).sum(axis=0) >= enough if depth else np.ones(len(todo), dtype=bool)
            at = todo[found]
            length[at] = depth
            low[:, at], high[:, at] = lo[:, found], hi[:, found]
        seen = np.zeros(n, dtype=bool)
        for i in range(len(queries)):
            for t in range(trees):
                seen[self.order[t][low[t, i] : high[t, i]]] = True
            got = np.flatnonzero(seen)
            seen[got] = False
            yield got


def answer(r_ids: np.ndarray, r: np.ndarray, k: int, share: float):
    """Of one shard, what gives the k nearest candidates of (query ids, queries)."""
    forest = Forest(r)
    enough = max(16 * k, int(share * len(r) * TREES / 2))

    def nearest_of(q_ids: np.ndarray, q: np.ndarray) -> tuple:
        out: list[list[np.ndarray]] = [[], [], []]
        for i, got in enumerate(forest.candidates(q, enough)):
            got = got[r_ids[got] != q_ids[i]]
            rough = r[got] @ q[i]
            if len(got) > 2 * k:  # the rough product may differ in the last bits from the exact one
                cut = np.partition(rough, len(got) - k)[len(got) - k]
                got = got[rough >= cut - 1e-9 * max(1.0, abs(cut))]
            score = (r[got] * q[i]).sum(axis=1)
            best = vectors.top(score, r_ids[got], k)
            for col, x in zip(out, (np.full(len(best), q_ids[i]), r_ids[got[best]], score[best])):
                col.append(x)
        return tuple(np.concatenate(c) if c else np.empty(0, dtype=t) for c, t in zip(out, (np.int64, np.int64, np.float64)))

    return nearest_of


def calibrate(rows: DataFrame, k: int) -> float:
    """The least share of a shard that finds ``TARGET`` of the true k nearest in a sample."""
    got = rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).toArrow().combine_chunks()
    if got.num_rows <= 20 * k:
        return 1.0
    ids, x = max(vectors.by_length(got.column("vec_id").to_numpy(), got.column("embedding").combine_chunks()).values(), key=lambda v: len(v[0]))
    if len(ids) <= 20 * k:
        return 1.0
    q_ids, q = ids[:SAMPLE_QUERIES], x[:SAMPLE_QUERIES]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    true = np.argpartition(-s, k, axis=1)[:, :k]
    for share in LADDER:
        a, b, _ = answer(ids, x, k, share)(q_ids, q)
        hit = sum(len(np.intersect1d(ids[true[i]], b[a == q_ids[i]])) for i in range(len(q)))
        if hit >= TARGET * true.size:
            return share
    return 1.0


def nearest(df: DataFrame, every: int = 20, k: int = 20, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest rows, by inner product in double precision, of every row whose id is divisible by
    ``every``; the query's own row is no candidate (of repeated ids, all rows with the query's id).

    Returns ``query_id, rank, vec_id, score``; ties go to the smaller vec_id. Vectors that are null,
    empty, zero or hold a null or non-finite component take no part, nor do rows with a null id.
    Vectors are compared with those of their own length. Repeated rows are candidates as often as they
    stand. An empty table gives no rows.
    """
    rows = vectors.usable(df, id, embedding)
    share = calibrate(rows, k)
    return vectors.search(rows, rows.where(F.col("vec_id") % every == 0), k, lambda ids, x: answer(ids, x, k, share), "double")
