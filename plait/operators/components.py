"""Connected components of an undirected edge table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.runtime import lean, shared_dir, ship

#: Edges that one task may be given whole (16 bytes each).
ONE_GROUP = 2_000_000


def smallest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges in order, and the smallest node of each one's component: roots join smaller ones
    that an edge leads to, and all paths are halved until they end at a root."""
    names, ends = np.unique(np.concatenate((src, dst)), return_inverse=True)
    a, b = ends[: len(src)], ends[len(src) :]
    up = np.arange(len(names))
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return names, names[up]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up != (up := up[up])).any():
            pass


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) of ``edges`` (u, v), longs, which one task holds."""
    ship(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if held:
            node, component = smallest(*(np.concatenate(x) for x in zip(*held)))
            for at in range(0, len(node), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in (node, component)], ["node", "component"])

    return edges.repartition(1).mapInArrow(lean(run), "node long, component long")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, one_group: int = 0) -> DataFrame:
    """Label every node of ``edges`` with the smallest node of its component.

    Returns ``(node, component)`` with one row per node that has an edge; self-loops give their
    node its own label; rows with a null end are ignored. Large-star and small-star rounds
    alternate, so the number of rounds grows with the logarithm of the component size and not
    with its diameter. The per-node minimum is checkpointed before each join, so that both sides
    of the join are plain shuffles which adaptive execution can split at a hot node. Rounds write some
    files a task, however few the edges: up to ``one_group`` edges between longs, which are counted first
    and should be cheap to read, one task does all.
    """
    shared_dir(edges.sparkSession)
    base = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    if one_group and base.count() <= one_group:
        return _in_one_task(base)
    base = base.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    loops = base.where("u = v").select(F.col("u").alias("node"))
    e = base.where("u > v")
    total = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = total(e)
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
        up = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = up.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct().checkpoint()
        low = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.union(low.select("u", F.col("m").alias("v"))).where("u > v").distinct().checkpoint()
        state = total(e)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    labelled = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    alone = loops.join(labelled, "node", "left_anti").select("node", F.col("node").alias("component"))
    return labelled.union(alone)
