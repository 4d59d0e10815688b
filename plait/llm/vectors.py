"""What the two vector searches share: usable vectors, and query sets in bounded blocks.

A query set that grows with the table is never sent whole. Queries are split by hash into blocks of
about ``BLOCK`` rows; one block at a time is broadcast (``BLOCK`` x dimensions x 8 bytes, 16 MB at 64
dimensions) and meets every row where it lies. Each task indexes its shards and answers the block from
each, with at most k rows a query; the shards' answers are merged by query and written before the next
block is sent and the last one freed. Vectors are never shuffled. Only vectors of one length are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plait.runtime import materialise, ship

BLOCK = 32_768
#: Rows of a shard: a task's rows are taken in shards of this many, so its memory stays bounded.
SHARD = 32_768


def usable(df: DataFrame, id: str = "vec_id", embedding: str = "embedding", zero: bool = False) -> DataFrame:
    """(vec_id, embedding) of rows with an id and a vector of finite components; unless ``zero``, not
    all of them zero."""
    v = F.col(embedding)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    keep = F.col(id).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad)
    if not zero:
        keep &= F.exists(v, lambda x: x != 0)
    return df.where(keep).select(F.col(id).cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"))


def by_length(ids: np.ndarray, col: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors in double precision) of a list column, by the vectors' length."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    n = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(n):
        return {}
    if (n == n[0]).all():
        return {int(n[0]): (ids, flat.reshape(len(n), -1))}
    start = np.cumsum(n) - n
    return {int(k): (ids[n == k], flat[start[n == k][:, None] + np.arange(k)]) for k in np.unique(n)}


def query_blocks(queries: DataFrame, block: int = BLOCK) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The queries by length, a block at a time."""
    n = -(-queries.count() // block)
    for i in range(n):
        part = queries if n == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == i)
        got = part.toArrow().combine_chunks()
        if got.num_rows:
            yield by_length(got.column("vec_id").to_numpy(), got.column("embedding").combine_chunks())


def shards(batches: Iterator[pa.RecordBatch], rows: int = SHARD) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A task's rows (vec_id, embedding) in shards of about ``rows``, by length."""
    held: dict[int, list] = {}
    n = 0

    def out() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for k, parts in held.items():
            yield k, np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        held.clear()

    for b in batches:
        for k, part in by_length(b.column(0).to_numpy(), b.column(1)).items():
            held.setdefault(k, []).append(part)
        n += b.num_rows
        if n >= rows:
            yield from out()
            n = 0
    yield from out()


def search(rows: DataFrame, queries: DataFrame, k: int, index: Callable, score: str, block: int = BLOCK) -> DataFrame:
    """``index(row ids, row vectors)`` gives what answers (query ids, query vectors) with (query, vec_id,
    score) arrays of at most k rows a query; for every block and shard, merged to ``query_id, rank, vec_id,
    score``."""
    spark = rows.sparkSession
    ship(spark)
    schema = f"query_id long, vec_id long, score {score}"
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.select("*", F.row_number().over(w).cast("int").alias("rank")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    out, sent = None, None
    for own in query_blocks(queries, block):
        if sent is not None:
            out = materialise(out, "answers")
            sent.unpersist()
        sent = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for length, r_ids, r in shards(batches):
                if length in sent.value:
                    q_ids, q = sent.value[length]
                    answer = index(r_ids, r)
                    for at in range(0, len(q_ids), 4096):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in answer(q_ids[at : at + 4096], q[at : at + 4096])], ["query_id", "vec_id", "score"])

        part = best(rows.mapInArrow(run, schema))
        out = part if out is None else out.union(part)
    return best(spark.createDataFrame([], schema)) if out is None else out


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids, best first."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
