"""SimHash near-duplicate detection with Golay-code fuzzy hashing.

A 64-bit fingerprint is read as three segments A, B (23 bits) and C (18 bits, padded with zeros).
Decoding a segment and each of its 23 one-bit neighbours with the perfect [23,12,7] Golay code
gives its set of *nearby codeword indices*, one or six of them. Two facts make them keys:

* segments that differ in at most two bits share a nearby index (a word between them, one bit from
  either, decodes to it);
* if segments differ in at most one bit, the index of the one is among the nearby ones of the other.

Pigeonhole over at most four differing bits: either some segment is equal, and then one of the other
two differs in at most two bits (keys ``exact segment + nearby index``, six kinds), or all three
differ, and then some two of them differ in exactly one bit each (keys ``index + index`` against
``nearby + nearby``, three kinds). So no link is missed; keys carry 35, 30 or 24 bits, and each
shared key is verified by the Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.operators.components import connected_components
from plait.runtime import lean, materialise, ship

RADIUS = 4
#: The generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 of the binary Golay code.
GOLAY = 0b110001110101
#: Runs of a key up to this length are compared by offsets, longer ones by growing their components.
SHORT_RUN = 48


@lru_cache(maxsize=1)
def golay_table() -> np.ndarray:
    """For each 23-bit word the index (0 to 4095) of the only codeword within three bits."""
    words = np.zeros(4096, dtype=np.int64)
    for bit in range(12):
        words ^= np.where(np.arange(4096) >> bit & 1, GOLAY << bit, 0)
    table = np.full(1 << 23, -1, dtype=np.int16)
    index = np.arange(4096, dtype=np.int16)
    one = [1 << i for i in range(23)]
    table[words] = index
    for i in range(23):
        table[words ^ one[i]] = index
        for j in range(i):
            table[words ^ (one[i] | one[j])] = index
            for k in range(j):
                table[words ^ (one[i] | one[j] | one[k])] = index
    return table


def nearby(segment: np.ndarray) -> np.ndarray:
    """(n, 6) nearby codeword indices of 23-bit segments, sorted, -1 where there are fewer."""
    table = golay_table()
    masks = np.array([0] + [1 << i for i in range(23)], dtype=np.int64)
    got = np.sort(table[segment[:, None] ^ masks[None, :]], axis=1).astype(np.int64)
    first = np.ones(got.shape, dtype=bool)
    first[:, 1:] = got[:, 1:] != got[:, :-1]
    out = np.full((len(got), 6), -1, dtype=np.int64)
    row, col = np.nonzero(first)
    out[row, (np.cumsum(first, axis=1) - 1)[row, col]] = got[row, col]
    return out


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of 64-bit fingerprints. The lowest bit of a key is 1 for the
    ``nearby + nearby`` rows, which need only meet ``index + index`` rows."""
    fp = fp.astype(np.uint64)
    low = lambda x, n: (x & np.uint64((1 << n) - 1)).astype(np.int64)
    seg = [low(fp, 23), low(fp >> np.uint64(23), 23), low(fp >> np.uint64(46), 18)]
    near, table = [nearby(s) for s in seg], golay_table()
    rows, keys = [], []
    kind = 0
    for fuzzy in range(3):
        for exact in range(3):
            if fuzzy != exact:
                r, c = np.nonzero(near[fuzzy] >= 0)
                rows.append(r)
                keys.append(kind << 59 | (near[fuzzy][r, c] << 23 | seg[exact][r]) << 1)
                kind += 1
    for x, y in ((0, 1), (0, 2), (1, 2)):
        tag = kind << 59
        rows.append(np.arange(len(fp)))
        keys.append(tag | (table[seg[x]].astype(np.int64) << 12 | table[seg[y]].astype(np.int64)) << 1)
        both = (near[x][:, :, None] >= 0) & (near[y][:, None, :] >= 0)
        r, i, j = np.nonzero(both)
        rows.append(r)
        keys.append(tag | (near[x][r, i] << 12 | near[y][r, j]) << 1 | 1)
        kind += 1
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of a whole text: words are split at ASCII white space, A-Z lower-cased, shingles
    joined by one space (a shorter text is one shingle), hashed by XXH64; a bit is 1 if set in over
    half of the hashes. No word gives 0."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_digest
    if len(parts) <= words:
        h = digest(b" ".join(parts), seed)
        return int.from_bytes(h, "big")
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(parts) - words] + 1))
    total, n = np.zeros(64, dtype=np.int64), len(starts)
    for at in range(0, n, 65536):
        spans = zip(starts[at : at + 65536].tolist(), ends[at + words - 1 : at + words - 1 + 65536].tolist())
        raw = b"".join([digest(joined[s:e], seed) for s, e in spans])
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (p := up.get(root, root)) != root:
            root = p
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _run_links(fp: np.ndarray, node: np.ndarray, radius: int, forest: Forest) -> None:
    """Link one long run: grow components by comparing with what no component holds yet."""
    left = np.arange(len(fp))
    while len(left):
        front, left = left[:1], left[1:]
        root = int(node[front[0]])
        while len(front) and len(left):
            hit = np.zeros(len(left), dtype=bool)
            for f in fp[front]:
                np.logical_or(hit, np.bitwise_count(fp[left] ^ f) <= radius, out=hit)
            front, left = left[hit], left[~hit]
            for x in node[front].tolist():
                forest.link(root, x)


def _link_batch(key: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int, forest: Forest) -> None:
    """Link the rows of whole runs (rows sorted by key; a run shares all but the lowest bit)."""
    run = key >> 1
    start = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    length = np.diff(np.concatenate((start, [len(run)])))
    for s, n in zip(start[length > SHORT_RUN].tolist(), length[length > SHORT_RUN].tolist()):
        _run_links(fp[s : s + n], node[s : s + n], radius, forest)
    size = np.repeat(length, length)
    keep = np.flatnonzero((size > 1) & (size <= SHORT_RUN))
    if not len(keep):
        return
    run, fp, node, probe = run[keep], fp[keep], node[keep], (key[keep] & 1).astype(bool)
    for step in range(1, SHORT_RUN):
        same = np.flatnonzero(run[step:] == run[:-step])
        if not len(same):
            break
        same = same[~(probe[same] & probe[same + step])]
        same = same[np.bitwise_count(fp[same] ^ fp[same + step]) <= radius]
        for a, b in zip(node[same].tolist(), node[same + step].tolist()):
            if a != b:
                forest.link(a, b)


def link_runs(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, node) sorted by key within the task → a spanning forest of the task's links."""
    forest, held = Forest(), []
    cols = lambda b: tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3))

    def done(parts: list) -> None:
        key, fp, node = (np.concatenate(x) for x in zip(*parts))
        _link_batch(key, fp.view(np.uint64), node, radius, forest)

    for b in batches:
        if not b.num_rows:
            continue
        key, fp, node = cols(b)
        cut = int(np.searchsorted(key >> 1, key[-1] >> 1))
        if cut or not held:  # the last run may go on in the next batch
            done([*held, (key[:cut], fp[:cut], node[:cut])])
            held = []
        held.append((key[cut:], fp[cut:], node[cut:]))
    if held:
        done(held)
    child = np.fromiter(forest.up, dtype=np.int64, count=len(forest.up))
    root = np.fromiter((forest.find(x) for x in child.tolist()), dtype=np.int64, count=len(child))
    for at in range(0, len(child), 10000):
        yield pa.RecordBatch.from_arrays([pa.array(child[at : at + 10000]), pa.array(root[at : at + 10000])], ["src", "dst"])


def with_fingerprints(docs: DataFrame, words: int = 4, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, fp) for every row; ``fp`` holds the unsigned 64 bits in a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, words) for t in b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(lean(run), "doc_id long, fp long")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp, node) → (src, dst) of nodes, a set of links with the components of
    *all* pairs of fingerprints at ``radius`` or fewer differing bits. No pair list is made: each
    task that holds whole key runs returns a spanning forest of the links it verified."""
    if radius > RADIUS:
        raise ValueError("the keys cover at most four differing bits")
    ship(fps.sparkSession)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, node = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at in range(0, len(fp), 2000):
                f, m = fp[at : at + 2000], node[at : at + 2000]
                row, key = keys_of(f.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(f[row]), pa.array(m[row])], ["key", "fp", "node"])

    keys = fps.select("fp", "node").mapInArrow(lean(expand), "key long, fp long, node long")
    dealt = keys.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    return dealt.mapInArrow(lambda it: link_runs(it, radius), "src long, dst long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = RADIUS, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Fingerprint and component of every document.

    Returns ``(doc_id, fingerprint, component_id)``, one row per input row: ``fingerprint`` in 16
    hexadecimal digits, ``component_id`` the smallest doc_id reachable over links of ``radius`` or
    fewer differing bits, the own one included. A null or blank text has fingerprint zero and is
    linked like any other. Rows with a null doc_id keep a null component unless a row with an id
    is reachable; repeated rows stay repeated; other columns are ignored; an empty table gives none.
    """
    prints = materialise(with_fingerprints(docs, words, text, id), "simhash-fp")
    return components_of(prints, radius)


def components_of(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp) → (doc_id, fingerprint, component_id)."""
    fps = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).select("fp", "rep", F.col("rep").alias("node")), "simhash-distinct")
    # nodes need ids of their own where a fingerprint has no doc_id or doc_ids repeat over texts
    shared = fps.groupBy("node").agg(F.count("*").alias("n")).where("n > 1 or node is null").limit(1).count()
    if shared:
        # order by fingerprint: any dense id serves, as labels are mapped back to the least doc_id
        fps = materialise(fps.select("fp", "rep", F.col("fp").alias("node")), "simhash-nodes")
    parts = connected_components(links(fps, radius))
    named = fps.join(parts, "node", "left").select("fp", "rep", F.coalesce("component", "node").alias("part"))
    if shared:
        named = materialise(named, "simhash-parts")
        least = named.groupBy("part").agg(F.min("rep").alias("component_id"))
        labels = named.join(materialise(least, "simhash-least"), "part").select("fp", "component_id")
    else:
        labels = named.select("fp", F.col("part").alias("component_id"))
    labels = materialise(labels, "simhash-labels")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(labels, "fp").select("doc_id", hexed, "component_id")
