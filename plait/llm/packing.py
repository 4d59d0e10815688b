"""Best-fit packing of token sequences with certified bounds.

Texts are tokenised where they lie, and only piece lengths travel. Pieces are dealt to partitions by
hash; each partition runs best-fit decreasing and compares its bin count with the largest of several
lower bounds from dual feasible functions. Bins with gaps that might still be closed give their
documents back; these are exchanged, dealt anew to fewer partitions, and packed again, until one
partition is left or nothing is given back. Pieces of the full length need no packing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.runtime import lean, materialise, ship

CAPACITY = 1024
END_ID = 2
#: Pieces in a partition, about; below FEW in all, one partition takes them.
PART_ROWS = 50_000
FEW = 2000
#: Partitions of a first round, if pieces are fewer than fill more, and bins that each should then fill.
LEAST_PARTS, PART_BINS = 16, 64
#: The split pattern of byte-level BPE vocabularies of this kind (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond these letters two pattern engines may hold different Unicode versions.
_OUTSIDE = re.compile("[^\u0000-ɏ‐-‧€]")


@lru_cache(maxsize=4)
def encoder(path: str):
    """text → ids, as the tokenizers library encodes it with the vocabulary file at ``path`` without
    added special tokens. Plain Latin texts go through tiktoken with the same vocabulary (a byte-level
    BPE file orders its merges by id), which is four times as fast; others through the library."""
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    special = [t.content for t in library.get_added_tokens_decoder().values()]
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    byte = {(chr(b) if b in plain else chr(next(spare))): b for b in range(256)}
    ranks = {bytes(byte[c] for c in t): i for t, i in library.get_vocab(with_added_tokens=False).items() if t not in special}
    fast = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if _OUTSIDE.search(text) or any(s in text for s in special):
            return np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(fast.encode_ordinary(text), dtype="<u4")

    return encode


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids with ``end_id`` at the end, cut
    into pieces of ``capacity`` from the end, so that only the first piece may be shorter."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        tail = np.array([end_id], dtype="<u4")
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.concatenate((encode(t), tail)) if t else tail
                n = len(ids)
                start, end, k = 0, n % capacity or capacity, 0
                while start < n:
                    for col, x in zip(out, (doc, k, start, end - start, zlib.crc32(ids[start:end]))):
                        col.append(x)
                    start, end, k = end, end + capacity, k + 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(out, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, offset in it, fill of each bin). Bins are kept by free space, and a bit set of
    the spaces in use gives the tightest one in a step, so a run costs items times a constant."""
    order = np.argsort(-lengths, kind="stable")
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, fill = 0, []
    which, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        rest = used >> size
        if rest:
            free = size + (rest & -rest).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                used ^= 1 << free
        else:
            free, b = capacity, len(fill)
            fill.append(0)
        which[i], offset[i] = b, fill[b]
        fill[b] += size
        left = free - size
        if left:
            by_free[left].append(b)
            used |= 1 << left
    return which, offset, np.array(fill, dtype=np.int64)


def bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest lower bound on the bins from two families of dual feasible functions: the threshold
    functions (above ``capacity - e`` counts as a bin, below ``e`` as nothing) for every e up to half
    the capacity, and the rounding functions u^(k) for k up to 20."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    n_above, total = np.cumsum(count[::-1])[::-1], np.cumsum(count * size)
    e = np.arange(capacity // 2 + 1)
    high = np.where(capacity - e + 1 <= capacity, n_above[np.minimum(capacity - e + 1, capacity)], 0)
    middle = total[capacity - e] - np.where(e > 0, total[e - 1], 0)
    best = int((high + -(-middle // capacity)).max())
    for k in range(1, 21):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # times k
        best = max(best, int(-(-(value * count).sum() // (capacity * k))))
    return best


def _pack_part(rows: pd.DataFrame, capacity: int, tag: int, last: bool) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "piece", "start", "ids_crc32"], kind="stable", na_position="first").reset_index(drop=True)
    lengths = rows["length"].to_numpy()
    which, offset, fill = best_fit_decreasing(lengths, capacity)
    least = bound(lengths, capacity)
    given = np.zeros(len(fill), dtype=bool)
    if not last:
        # a certified partition gives its emptiest bin, which others may complete; one above its
        # bound also gives what it has too much
        n = 1 + len(fill) - least
        emptiest = np.argsort(fill, kind="stable")[:n]
        given[emptiest[fill[emptiest] < capacity]] = True
    rows["sequence_id"] = (tag << 44) + (int(rows["part"].iloc[0]) << 22) + which if len(rows) else which
    rows["offset"] = offset
    rows["given"] = given[which]
    rows["part_bins"], rows["part_bound"] = len(fill), least
    return rows


def _kernel(capacity: int, tag: int, last: bool):
    return lambda rows: _pack_part(rows, capacity, tag, last)


def pack(cut: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """Pack pieces (doc_id, piece, start, length, ids_crc32) of at most ``capacity`` tokens.

    Returns the pieces with ``sequence_id``, ``offset`` (gapless from 0), and ``part_bins`` and
    ``part_bound``, the bin count and certified lower bound of the partition that packed them.
    ``cut`` should be a written table, as it is read once a round. An empty table gives no rows.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, sequence_id long, offset long, given boolean, part_bins long, part_bound long"
    ship(cut.sparkSession)
    full = cut.where(F.col("length") >= capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(1).cast("long").alias("part_bins"), F.lit(1).cast("long").alias("part_bound")
    )
    done, rest, tag = [full], cut.where(F.col("length") < capacity), 0
    size = lambda: rest.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    most, (n, tokens) = LEAST_PARTS, size()
    while n:
        # parts of full size always settle bins; smaller ones may give all back, so they get fewer each round
        parts = 1 if n <= FEW else max(1, -(-n // part_rows), min(most, tokens // (PART_BINS * capacity)))
        # null or repeated ids are dealt by row
        part = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id(), F.lit(tag)), F.lit(parts)).cast("int").alias("part")
        packed = materialise(rest.select("doc_id", "piece", "start", "length", "ids_crc32", part).groupBy("part").applyInPandas(_kernel(capacity, tag, parts == 1), schema), f"pack-{tag}")
        done.append(packed.where("not given").drop("part", "given"))
        rest = packed.where("given").select("doc_id", "piece", "start", "length", "ids_crc32")
        (n, tokens), most, tag = size(), max(1, parts // 2), tag + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Tokenise and pack all documents into as few sequences of ``capacity`` as best-fit finds.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and the
    partition's ``part_bins`` and ``part_bound``. A null or empty text is the end token alone; a null
    doc_id is kept; repeated rows are packed as often as they stand; other columns are ignored.
    """
    return pack(materialise(pieces(docs, path, capacity, end_id, text, id), "pieces"), capacity)
