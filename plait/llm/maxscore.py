"""Exact top-k search by MaxScore over sharded postings.

Every component is a term, its integer weights are the term's postings. In a shard, a query's term
has a score bound: the largest product of the query's weight with a weight of its postings, or zero
where a row may lack the term. Terms are ordered by bound. Once the running k-th best score exceeds
the sum of the smallest bounds, their terms are non-essential: postings of the essential terms are
traversed for all rows of a block, and the others are probed, in descending order of bound, only for
rows whose partial score plus remaining bounds can still compete. All arithmetic is exact: on doubles
where no sum reaches 2^53, on longs where none reaches 2^63, and on whole numbers of any size beyond.
Shards' answers are merged by query.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.llm import vectors

SCALE = 1024
#: Rows of a block of postings, over which the k-th best score is carried.
POSTINGS = 2048


def _probe(w: np.ndarray, q: np.ndarray, order: np.ndarray, tail: np.ndarray, split: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one block that reach ``floor`` or more, with their exact scores."""
    left = np.arange(len(w))
    part = w[:, order[:split]] @ q[order[:split]]
    for i in range(split, len(order), 8):
        keep = (part + tail[i] >= floor).astype(bool)
        left, part = left[keep], part[keep]
        if not len(left):
            return left, part
        terms = order[i : i + 8]
        part = part + w[np.ix_(left, terms)] @ q[terms]
    keep = (part >= floor).astype(bool)
    return left[keep], part[keep]


def weights(x: np.ndarray, scale: int, dtype) -> np.ndarray:
    """floor(scale * x) in a type that holds the sums exactly."""
    with np.errstate(over="ignore"):
        w = np.nan_to_num(np.floor(x * float(scale)))  # beyond a double, the largest one
    return np.array([[int(v) for v in row] for row in w], dtype=object).reshape(w.shape) if dtype is object else w.astype(dtype)


def kind_of(r: np.ndarray, q: np.ndarray, scale: int):
    """The type in which no inner product of weights overflows."""
    top = lambda x: float(np.abs(x * float(scale)).max(initial=0.0)) + 1.0
    with np.errstate(over="ignore"):
        most = top(r) * top(q) * r.shape[1]
    return np.float64 if most < 2**53 else np.int64 if most < 2**62 else object


def answer(r_ids: np.ndarray, r: np.ndarray, k: int, scale: int = SCALE):
    """Of one shard, what gives the k best rows of (query ids, queries). Scores beyond a long are given as
    the nearest long."""
    # rows in order of id, so that of equal scores the first ones seen win
    by_id = np.argsort(r_ids, kind="stable")
    ids, r = r_ids[by_id], r[by_id]
    made: dict[type, np.ndarray] = {}

    def best_of(q_ids: np.ndarray, q: np.ndarray) -> tuple:
        kind = kind_of(r, q, scale)
        if kind not in made:
            made[kind] = weights(r, scale, kind)
        w, own = made[kind], weights(q, scale, kind)
        low, high = w.min(axis=0), w.max(axis=0)
        out: list[list[np.ndarray]] = [[], [], []]
        for qi, qv in zip(q_ids.tolist(), own):
            bounds = np.maximum(np.maximum(qv * low, qv * high), 0)
            order = np.array(sorted(range(len(bounds)), key=lambda i: -bounds[i]), dtype=np.int64)  # noqa: B023
            tail = np.append(np.cumsum(bounds[order][::-1])[::-1], bounds.dtype.type(0) if kind is not object else 0)
            best_ids, best = np.empty(0, dtype=np.int64), np.empty(0, dtype=w.dtype)
            floor, split = -np.inf, len(order)
            for at in range(0, len(w), POSTINGS):
                rows, score = _probe(w[at : at + POSTINGS], qv, order, tail, split, floor)
                rows = rows + at
                other = ids[rows] != qi
                best_ids, best = np.concatenate((best_ids, ids[rows[other]])), np.concatenate((best, score[other]))
                keep = vectors.top(best, best_ids, k)
                best_ids, best = best_ids[keep], best[keep]
                if len(best) == k and best[-1] > floor:
                    floor = best[-1]
                    # essential: the fewest leading terms whose remaining bounds fall short of the floor
                    split = min(max(1, int((tail >= floor).sum())), len(order))
            if kind is object:
                best = np.array([min(max(x, -(2**63)), 2**63 - 1) for x in best], dtype=np.int64)
            for col, x in zip(out, (np.full(len(best), qi), best_ids, best.astype(np.int64))):
                col.append(x)
        return tuple(np.concatenate(c) if c else np.empty(0, dtype=np.int64) for c in out)

    return best_of


def top_k(df: DataFrame, every: int = 100, k: int = 10, scale: int = SCALE, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k highest integer inner products, of components floor(scale * x), for every row whose id is
    divisible by ``every``; the query's own row is no candidate (of repeated ids, all rows with it).

    Returns ``query_id, rank, vec_id, score``; ties go to the smaller vec_id. Vectors that are null,
    empty or hold a null or non-finite component take no part, nor do rows with a null id; zero vectors
    do. Vectors are compared with those of their own length. Repeated rows are candidates as often as they
    stand; scores beyond a long are given as the nearest long. An empty table gives no rows.
    """
    rows = vectors.usable(df, id, embedding, zero=True)
    return vectors.search(rows, rows.where(F.col("vec_id") % every == 0), k, lambda ids, x: answer(ids, x, k, scale), "long")
