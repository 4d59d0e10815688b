"""Groups of near copies for a corpus: SimHash candidates under Golay keys, verified by similarity.

The fingerprint operator links texts whose shingle fingerprints differ in at most four of 64 bits, far
closer copies than a Jaccard similarity of 0.8 over five-word shingles: at 0.8 about ten bits differ.
Here the same codes find the candidates on features that change less, and similarity decides:

1. texts equal up to case and white space are one class, kept by its first document;
2. a class has four fingerprints of 46 bits over its distinct words; both 23-bit segments are decoded
   to their nearby codewords, and pairs of these are the keys (about 28 a fingerprint). Classes that
   differ in at most two bits of either segment of some fingerprint share a key. Of every run of a key
   the member nearest to the run's majority is its centre, and of all centres that a class meets it
   asks the nearest one: a question a class, however large its group;
3. a question is answered by the sets of five-word shingles; what is linked is joined into parts;
4. exact prefix filtering finds every link between parts that are still apart: shingles are ordered from
   rare to common, and two sets at 0.8 share one among the first fifth of each, whatever was edited. In
   rounds, each class first asks the largest parts that it shares the most of these shingles with, so
   that groups grow together. Then a last pass leaves nothing out: a class asks the blocks of every
   other part in which a set stands that shares such a shingle, and is linked to the part by the first
   set at 0.8 that it meets there; members of one part never meet. So a group gives rows in proportion
   to its members;
5. of each component of links the document with the smallest id stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plait.llm.simhash import nearby
from plait.operators.components import ONE_GROUP, connected_components
from plait.runtime import lean, materialise, ship

WORDS, SIMILARITY = 5, 0.8
PRINTS = 4
SEEDS = -(-46 * PRINTS // 128)
#: Bits in which a class and the centre that it asks may differ.
DISTANCE = 6
#: A key that this share of a batch of classes holds is dealt over SALTS runs.
HOT, SALTS = 0.25, 256
BROADCAST_ROWS = 1_000_000
#: Members of a part and shingles of theirs in a block, and questions to a copy of a block.
BLOCK_SETS, BLOCK_SHINGLES, QUESTIONS = 256, 200_000, 2048
#: Rounds in which groups grow together, at most, and questions of a class in each.
ROUNDS, ASKED = 2, 3
#: Shingles are counted in 2^COUNT_BITS buckets, sent in rows of BLOCK; any counts give the same links.
COUNT_BITS, BLOCK = 20, 1 << 16
#: Runs of a shingle up to this length are compared by offsets; rows and questions that a task holds at a time.
SHORT_RUN, HELD_ROWS, HELD_QUESTIONS = 48, 50_000, 500_000


def word_prints(parts: list[bytes]) -> list[int]:
    """PRINTS fingerprints of 46 bits over the distinct words."""
    words = set(parts)
    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(w, k) for w in words for k in range(SEEDS)])
    bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 16 * SEEDS), axis=1)[:, : 46 * PRINTS]
    on = (bits.sum(axis=0, dtype=np.int64) * 2 > len(words)).reshape(PRINTS, 46)
    return (on.astype(np.int64) << np.arange(46, dtype=np.int64)).sum(axis=1).tolist()


def split(text: str | None) -> list[bytes]:
    """The lower-cased words of a text."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def class_of(parts: list[bytes]) -> tuple[int, int]:
    """The two hashes of a class of equal texts; their exclusive or is its node."""
    whole = xxhash.xxh3_128_intdigest(b" ".join(parts))
    return whole & (2**63 - 1), (whole >> 64) & (2**63 - 1)


def shingle_set(parts: list[bytes], words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the shingles; a shorter text is one shingle."""
    one = np.fromiter(map(xxhash.xxh64_intdigest, parts), dtype=np.uint64, count=len(parts))
    k = min(words, len(parts))
    n = len(parts) - k + 1
    h = np.full(n, k, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = (h ^ one[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
    return np.unique(h)


def overlap(m: np.ndarray, n: np.ndarray, least: float) -> np.ndarray:
    """How many shingles sets of sizes ``m`` and ``n`` share at least at a similarity of ``least``."""
    return np.ceil(least / (1 + least) * (m + n) - 1e-9).astype(np.int64)


def prefix(h: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """The rarest shingles of a set, in an order that all sets share, so many that two sets at ``least``
    have one of them in common."""
    n = len(h)
    order = np.lexsort((h, common[(h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]))
    return h[order[: n - int(np.ceil(least * n - 1e-9)) + 1]]


def runs(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[list[np.ndarray]]:
    """Columns of whole runs of the first one, which rows are sorted by; a run of more than ``most`` rows
    comes in parts."""
    held: list[list[np.ndarray]] = []
    n, limit = 0, HELD_ROWS

    def joined() -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*held)]

    for b in batches:
        if not b.num_rows:
            continue
        held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)])
        n += b.num_rows
        if n >= limit:
            cols = joined()
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if not cut and most is not None and n >= most:
                cut = n
            if cut:
                yield [c[:cut] for c in cols]
            held, limit = [[c[cut:] for c in cols]] if cut < n else [], HELD_ROWS if cut else 2 * n
            n -= cut
    if held:
        yield joined()


def centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, node) sorted by key within the task → (node, distance, centre): of the centres of its
    runs the one that each node is nearest to."""
    found: list[np.ndarray] = []

    def best() -> np.ndarray:
        node, d, hub = np.concatenate(found, axis=1)
        by = np.lexsort((hub, d, node))
        node, d, hub = node[by], d[by], hub[by]
        new = np.concatenate(([True], node[1:] != node[:-1]))
        return np.stack((node[new], d[new], hub[new]))

    for key, fp, node in runs(batches, HELD_ROWS):
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.diff(np.concatenate((start, [len(key)])))
        keep = np.repeat(n > 1, n)
        if not keep.any():
            continue
        fp, node, n = fp[keep].view(np.uint64), node[keep], n[n > 1]
        start = np.cumsum(n) - n
        run = np.repeat(np.arange(len(n)), n)
        bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1)
        centre = np.packbits(np.add.reduceat(bits.astype(np.int32), start, axis=0) * 2 > n[:, None], axis=1).view(np.uint64).ravel()
        hub = np.lexsort((node, np.bitwise_count(fp ^ centre[run]), run))[start][run]
        d = np.bitwise_count(fp ^ fp[hub])
        ok = (d <= DISTANCE) & (node != node[hub])
        found.append(np.stack((node[ok], d[ok].astype(np.int64), node[hub][ok])))
        if sum(x.shape[1] for x in found) > HELD_QUESTIONS:
            found = [best()]
            if found[0].shape[1] > HELD_QUESTIONS // 2:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.pop()], ["node", "distance", "centre"])
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best()], ["node", "distance", "centre"])


def shared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, size, place) sorted by key within the task → those of keys that several nodes have."""
    for key, node, size, place in runs(batches):
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.diff(np.concatenate((start, [len(key)])))
        several = np.repeat(np.logical_or.reduceat(node != np.repeat(node[start], n), start), n)
        cols = [c[several] for c in (key, node, size, place)]
        for at in range(0, len(cols[0]), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 20_000]) for c in cols], ["key", "node", "size", "place"])


def _may(m: np.ndarray, p: np.ndarray, n: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of sizes m and n that share their shingles at places p and q, and none before one of
    them, can be at ``least``."""
    return np.minimum(m - p, n - q) >= overlap(m, n, least)


def stars(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, members, part, block, node, size, place) sorted by key within the task → (node, part, block,
    n): how many runs' largest part, by one member's block, a node of another part could be linked to."""
    found: list[np.ndarray] = []

    def out() -> np.ndarray:
        cols = np.concatenate(found, axis=1)
        found.clear()
        by = np.lexsort(cols[:3])
        cols = cols[:, by]
        new = np.flatnonzero(np.concatenate(([True], (cols[:3, 1:] != cols[:3, :-1]).any(axis=0))))
        return np.concatenate((cols[:3, new], np.add.reduceat(cols[3], new)[None]))

    for key, members, part, block, node, size, place in runs(batches):
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.diff(np.concatenate((start, [len(key)])))
        top = np.repeat(np.lexsort((node, part, -members, np.repeat(np.arange(len(n)), n)))[start], n)
        ok = np.flatnonzero((part != part[top]) & _may(size, place, size[top], place[top], least))
        if len(ok):
            found.append(np.stack((node[ok], part[top[ok]], block[top[ok]].astype(np.int64), np.ones(len(ok), dtype=np.int64))))
        if sum(x.shape[1] for x in found) > HELD_QUESTIONS:
            found.append(out())
            if found[0].shape[1] > HELD_QUESTIONS // 2:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.pop()], ["node", "part", "block", "n"])
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out()], ["node", "part", "block", "n"])


def questions(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, members, part, block, node, size, place) sorted by key within the task → (node, part,
    block): a node, and a block of another part with a set whose prefix shares a shingle with its own and
    whose size and place allow a similarity of ``least``. The node's part has no more members than the
    other. No such pair is left out; at a first common shingle, places bound what can follow."""
    found: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        cols = np.concatenate(found, axis=1)
        found.clear()
        by = np.lexsort(cols)
        cols = cols[:, by]
        new = np.concatenate(([True], (cols[:, 1:] != cols[:, :-1]).any(axis=0)))
        return pa.RecordBatch.from_arrays([pa.array(c[new]) for c in cols], ["node", "part", "block"])

    for key, members, part, block, node, size, place in runs(batches):
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        length = np.diff(np.concatenate((start, [len(key)])))
        mixed = np.logical_or.reduceat(part != np.repeat(part[start], length), start)

        def ask(i: np.ndarray, j: np.ndarray) -> None:
            swap = (members[i] > members[j]) | (members[i] == members[j]) & (part[i] > part[j])  # noqa: B023
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            found.append(np.stack((node[i], part[j], block[j].astype(np.int64))))  # noqa: B023

        for s, n in zip(start[mixed & (length > SHORT_RUN)].tolist(), length[mixed & (length > SHORT_RUN)].tolist()):
            count = np.unique(part[s : s + n], return_inverse=True, return_counts=True)
            few = s + np.flatnonzero(count[1] != count[2].argmax())  # members of the largest part need not meet
            step = max(1, 1_000_000 // n)
            for at in range(0, len(few), step):
                f = few[at : at + step, None]
                i, j = np.nonzero(_may(size[f], place[f], size[None, s : s + n], place[None, s : s + n], least) & (part[f] != part[None, s : s + n]))
                ask(f[i, 0], j + s)
                if sum(x.shape[1] for x in found) > HELD_QUESTIONS:
                    yield out()
        short = np.repeat(mixed & (length <= SHORT_RUN), length)
        for step in range(1, SHORT_RUN):
            same = np.flatnonzero((key[step:] == key[:-step]) & short[step:])
            if not len(same):
                break
            same = same[part[same] != part[same + step]]
            same = same[_may(size[same], place[same], size[same + step], place[same + step], least)]
            if len(same):
                ask(same, same + step)
        if sum(x.shape[1] for x in found) > HELD_QUESTIONS:
            yield out()
    if found:
        yield out()


class Sets:
    """Sets of one block, with the members of each shingle."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.sets: list[np.ndarray] = []
        self.all: np.ndarray | None = None

    def add(self, node: int, h: np.ndarray) -> None:
        self.nodes.append(node)
        self.sets.append(h)

    def similar(self, h: np.ndarray, least: float) -> int | None:
        """A member whose set is at ``least`` or more to ``h``."""
        if self.all is None:
            self.sizes = np.array([len(x) for x in self.sets])
            every = np.concatenate(self.sets)
            by = np.argsort(every, kind="stable")
            self.all, self.own = every[by], np.repeat(np.arange(len(self.sets)), self.sizes)[by]
        low, high = np.searchsorted(self.all, h), np.searchsorted(self.all, h, side="right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(self.own[at], minlength=len(self.sizes))
        hit = both >= least * (self.sizes + len(h) - both) - 1e-9
        return self.nodes[int(hit.argmax())] if hit.any() else None


def answers(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (part, block, salt, asks, node, shingles) in this order within the task → (src, dst): each node
    that asks, with a member of the block at ``least`` or more."""
    at, sets = None, Sets()
    for b in batches:
        src, dst = [], []
        where = list(zip(*(b.column(i).to_pylist() for i in range(3))))
        asks, node = b.column(3).to_pylist(), b.column(4).to_pylist()
        for i, key in enumerate(where):
            h = b.column(5)[i].values.to_numpy().view(np.uint64)
            if key != at:
                at, sets = key, Sets()
            if not asks[i]:
                sets.add(node[i], h.copy())
            elif sets.nodes and (hit := sets.similar(h, least)) is not None:
                src.append(node[i])
                dst.append(hit)
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def groups(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """``(doc_id, t, part, stays)`` for every row of ``docs`` (doc_id, text and more): ``t`` is the hash of
    the text, ``part`` names the group, ``stays`` is true for the smallest doc_id of each group.

    Null, empty and blank texts are one group of exact copies each other; rows with a null id are
    compared like any other and come last in their group; of a group without any id, the text with the
    least hash stays. Rows that repeat an id and a text share their fate. Very short texts are
    compared as a single shingle. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, dtype=np.int64)
        names = ["doc_id", "e1", "e2", "fps", "size", "t", "block", "counts"]
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for text in b.column(1).to_pylist():
                parts = split(text)
                e1, e2 = class_of(parts)
                cols[0].append(e1)
                cols[1].append(e2)
                cols[2].append(word_prints(parts) if parts else None)
                h = shingle_set(parts, words) if parts else ()
                cols[3].append(len(h))
                if parts:
                    np.add.at(counts, (h >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
            none = pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.int64()), b.column(2), *none], names)
        # how common shingles are in this task: rows of their own
        blocks = [i for i in range(len(counts) // BLOCK) if counts[i * BLOCK : (i + 1) * BLOCK].any()]
        none = [pa.nulls(len(blocks), ty) for ty in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64())]
        sent = [np.minimum(counts[i * BLOCK : (i + 1) * BLOCK], 2**32 - 1).astype(np.uint32).tobytes() for i in blocks]
        yield pa.RecordBatch.from_arrays([*none, pa.array(blocks, pa.int32()), pa.array(sent, pa.binary())], names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("t"))
    read = materialise(source.mapInArrow(lean(prints), "doc_id long, e1 long, e2 long, fps array<long>, size long, t long, block int, counts binary"), "copies-prints")
    rows = read.where("block is null").drop("block", "counts")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(c, dtype=np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    common = np.zeros(1 << COUNT_BITS, dtype=np.int64)
    for r in read.where("block is not null").select("block", "counts").repartition("block").mapInArrow(lean(total), "block int, counts binary").collect():  # 8 MB
        common[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, dtype=np.int64)
    common = spark.sparkContext.broadcast(common)
    # e1 names a class of equal texts; e2 guards it
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("row")
    classes = rows.groupBy("e1", "e2").agg(row, F.first("fps").alias("fps"), F.max("size").alias("size"), F.min("t").alias("t"))
    classes = materialise(classes.select(F.col("e1").bitwiseXOR(F.col("e2")).alias("node"), "e1", "e2", F.col("row.doc_id").alias("first"), F.col("row.t").alias("first_t"), "fps", "size", "t"), "copies-classes")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fps = b.column(0).to_numpy(), np.array(b.column(1).to_pylist(), dtype=np.int64).reshape(-1, PRINTS)
            for at in range(0, len(node), 2000):
                for k in range(PRINTS):
                    f = fps[at : at + 2000, k]
                    x, y = nearby(f & (1 << 23) - 1), nearby(f >> 23)
                    r, i, j = np.nonzero((x[:, :, None] >= 0) & (y[:, None, :] >= 0))
                    key = k << 24 | x[r, i] << 12 | y[r, j]
                    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
                    key = np.where(count[which] > max(HOT * len(f), 2), key | 1 + (node[at : at + 2000][r] & SALTS - 1) << 32, key)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(f[r]), pa.array(node[at : at + 2000][r])], ["key", "fp", "node"])

    keys = classes.where("fps is not null").select("node", "fps").mapInArrow(lean(expand), "key long, fp long, node long")
    nearest = keys.repartition("key").sortWithinPartitions("key").mapInArrow(lean(centres), "node long, distance long, centre long")
    nearest = nearest.groupBy("node").agg(F.min(F.struct("distance", "centre")).alias("x")).select("node", F.col("x.centre").alias("part"), F.lit(0).cast("long").alias("block"))

    def lengthen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            got = []
            for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = split(text)
                e1, e2 = class_of(parts)
                if node == e1 ^ e2 and node not in seen:  # t may be shared by another text
                    seen.add(node)
                    got.append((node, shingle_set(parts, words).view(np.int64)))
            nodes, sets = zip(*got) if got else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    def confirmed(asked: DataFrame, members: DataFrame | None, tag: str) -> DataFrame:
        """(src, dst) of classes that ask a block of a part (node, part, block) and a member of it at
        ``least`` or more. Members of parts are (node, part, block); others are parts of their own."""
        asked = materialise(asked, f"copies-asked-{tag}")
        # a block that many ask is copied, and the questions are dealt to the copies
        blocks = asked.groupBy("part", "block").agg(F.ceil(F.count("*") / QUESTIONS).alias("copies"))
        if members is None:
            blocks = blocks.withColumn("node", F.col("part"))
        else:
            blocks = blocks.join(members.withColumnRenamed("node", "member"), ["part", "block"], "left").select("part", "block", "copies", F.coalesce("member", "part").alias("node"))
        blocks = materialise(blocks, f"copies-blocks-{tag}")
        # a class's text is that of its first row; where rows repeat it, so does the set
        wanted = asked.select("node").union(blocks.select("node")).distinct().join(classes, "node").select("node", F.col("first").alias("of"), F.col("first_t").alias("of_t"))
        wanted = materialise(wanted, f"copies-wanted-{tag}")
        side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        sets = source.where("text is not null").join(side, (F.col("t") == F.col("of_t")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("node", "text")
        sets = materialise(sets.mapInArrow(lean(lengthen), "node long, shingles array<long>"), f"copies-sets-{tag}")
        copies = blocks.select("part", "block", "copies").distinct()
        asking = asked.join(copies, ["part", "block"]).select("part", "block", F.pmod(F.xxhash64("node"), F.col("copies")).alias("salt"), F.lit(1).alias("asks"), "node")
        held = blocks.select("part", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("asks"), "node")
        rows = asking.union(held).join(sets, "node").select("part", "block", "salt", "asks", "node", "shingles")
        met = rows.repartition("part", "block", "salt").sortWithinPartitions("part", "block", "salt", "asks")
        return materialise(met.mapInArrow(lean(lambda it: answers(it, least)), "src long, dst long"), f"copies-links-{tag}")

    links = confirmed(nearest, None, "near")
    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = common.value, set()
        for b in batches:
            got = []
            for text in b.column(0).to_pylist():
                parts = split(text)
                e1, e2 = class_of(parts)
                if parts and e1 ^ e2 not in seen:
                    seen.add(e1 ^ e2)
                    h = shingle_set(parts, words)
                    got.append((e1 ^ e2, len(h), prefix(h, counts, least).view(np.int64)))
            if not got:
                continue
            nodes, sizes, keys = zip(*got)
            n = np.array([len(k) for k in keys])
            place = np.concatenate([np.arange(k, dtype=np.int32) for k in n])
            cols = [np.concatenate(keys), np.repeat(np.array(nodes, dtype=np.int64), n), np.repeat(np.array(sizes, dtype=np.int32), n), place]
            for at in range(0, len(place), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 20_000]) for c in cols], ["key", "node", "size", "place"])

    prefixes = source.where("text is not null").select("text").mapInArrow(lean(rare), "key long, node long, size int, place int")
    prefixes = prefixes.repartition("key").sortWithinPartitions("key").mapInArrow(lean(shared_runs), "key long, node long, size int, place int")
    prefixes = materialise(prefixes, "copies-runs")

    def joined(links: DataFrame) -> DataFrame:
        """(node, part, members, block) of the classes that have links."""
        held = connected_components(links, one_group=ONE_GROUP).select("node", F.col("component").alias("part")).join(classes.select("node", "size"), "node")
        held = materialise(held, "copies-held")
        parts = held.groupBy("part").agg(F.count("*").alias("members"), F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks"))
        return materialise(held.join(parts, "part").select("node", "part", "members", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")), "copies-grown")

    def in_runs(held: DataFrame) -> DataFrame:
        whole = [F.coalesce("members", F.lit(1).cast("long")).alias("members"), F.coalesce("part", "node").alias("part"), F.coalesce("block", F.lit(0).cast("long")).alias("block")]
        rows = prefixes.join(F.broadcast(held) if held.count() <= BROADCAST_ROWS else held, "node", "left").select("key", *whole, "node", "size", "place")
        return rows.repartition("key").sortWithinPartitions("key")

    held = joined(links)
    for i in range(ROUNDS):
        asked = in_runs(held).mapInArrow(lean(lambda it: stars(it, least)), "node long, part long, block long, n long")
        asked = asked.groupBy("node", "part", "block").agg(F.sum("n").alias("n"))
        asked = asked.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "part", "block"))).where(F.col("k") <= ASKED)
        more = confirmed(asked.select("node", "part", "block"), held.select("node", "part", "block"), f"round-{i}")
        if not more.limit(1).count():
            break
        links = links.union(more)
        held = joined(links)
    apart = in_runs(held).mapInArrow(lean(lambda it: questions(it, least)), "node long, part long, block long")
    links = links.union(confirmed(apart.distinct(), held.select("node", "part", "block"), "apart"))
    parts = connected_components(links, one_group=ONE_GROUP).select("node", F.col("component").alias("part"))
    labelled = materialise(classes.join(parts, "node", "left").select("e1", "e2", "first", "t", F.coalesce("part", "node").alias("part")), "copies-parts")
    least_id = materialise(labelled.groupBy("part").agg(F.min("first").alias("stay"), F.min("t").alias("stay_t")), "copies-stay")
    labelled = materialise(labelled.join(least_id, "part").select("e1", "e2", "part", "stay", "stay_t", "first"), "copies-labels")
    # the row that stays: the first of its class, in the class that is first in its group; without any id, by text
    stays = F.col("doc_id").eqNullSafe(F.col("stay")) & F.col("first").eqNullSafe(F.col("stay")) & (F.col("stay").isNotNull() | (F.col("t") == F.col("stay_t")))
    return rows.join(labelled, ["e1", "e2"]).select("doc_id", "t", "part", stays.alias("stays"))
