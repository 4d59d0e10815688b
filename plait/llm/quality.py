"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters.

The model is trained on all trusted documents, a model per language. Counts of the highest order are
gathered by task, combined and shuffled by gram; lower orders count, from these types, how many
different characters stand on the left; contexts sum their types' counts and discounts; counts of counts
give three discounts for each language and order. Joins of these sharded tables resolve every gram that
was seen to its interpolated probability, order by order, and give each context its back-off weight.

A document's perplexity takes, at each of its characters, the longest gram that was seen, and the
weights of the longer contexts before it. Trusted documents are dealt to folds by their text, and each
is scored by a model without its fold's counts, since a text that a model has seen scores far lower than
one that it has not. Thresholds are quantiles, per language, over all trusted documents, of this
perplexity shrunk towards the language's mean, so that a short text needs more evidence; they are wider
where a language has few trusted documents, and a language with too few has none. No document is cut,
and no count is pruned.

A model of up to ``BROADCAST_ENTRIES`` entries is sent to the tasks as sorted arrays. A larger one stays
sharded: documents are dealt to shards of bounded size, a shard's distinct grams meet the model in joins,
one row a gram, and come back to the shard's documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from plait.runtime import lean, materialise, ship

ORDER = 4
#: The quantile of trusted documents' shrunk log-perplexity above which a document is rejected, and a
#: margin on it in nats; the characters' worth of the language's mean that each document is given.
QUANTILE, MARGIN, SHRINK = 0.995, 0.05, 100
#: Folds of the trusted documents. Languages of fewer trusted documents than ENOUGH have a margin wider in
#: proportion (the quantile is their maximum), and those of fewer than FEWEST no threshold.
FOLDS, ENOUGH, FEWEST = 3, 200, 20
#: Between a language and the fold that its model leaves out.
SEP = "\x01"
#: Up to this many entries (20 bytes each) a model is broadcast; beyond, it is joined.
BROADCAST_ENTRIES = 4_000_000
#: Up to this many trusted ids, and languages, are broadcast; beyond, both sides are shuffled.
BROADCAST_IDS, BROADCAST_LANGS = 2_000_000, 100_000
#: Positions that a task takes at a time, types that it holds, and characters of a shard of a large model's documents.
CHUNK, TYPES, SHARD_CHARS = 100_000, 200_000, 64_000_000

_K = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)
#: Stands before and after a text; no character of text is assigned there.
BOUNDARY = chr(0x10FFFF)
#: Kinds of entries: a gram's surprisal, a context's weight, a language's uniform share.
GRAM, WEIGHT, UNIFORM = 0, 1, 2


def _mix(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hash of a gram from that of its shorter end and one more character on the left."""
    h = (h + (c + np.uint64(1)) * _K) * _M
    h ^= h >> np.uint64(29)
    return h


def _seed(label: str, kind: int) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(f"{kind}:{label}"))


def _start(label: str, kind: int, n: int) -> np.ndarray:
    return np.full(n, _seed(label, kind), dtype=np.uint64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def spans(rows: Iterator[tuple[int, str]], order: int, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, positions, row of each position) of texts, a bounded part at a time. Every character
    and the end of a text is a position, with ``order - 1`` points before it."""
    held: list[str] = []
    own: list[tuple[int, int]] = []
    size, lead = 0, order - 1

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([k for _, k in own], dtype=np.int64)
        at = np.arange(n.sum()) + lead * np.repeat(np.arange(1, len(n) + 1), n)
        return _points("".join(held)), at, np.repeat(np.array([i for i, _ in own], dtype=np.int64), n)

    for i, text in rows:
        text += BOUNDARY
        for at in range(0, len(text), chunk):
            part = text[at : at + chunk]
            held += [(BOUNDARY * lead + text[max(0, at - lead) : at])[-lead:] if lead else "", part]
            own.append((i, len(part)))
            size += len(part)
            if size >= chunk:
                yield out()
                held, own, size = [], [], 0
    if own:
        yield out()


def _of_order(points: np.ndarray, at: np.ndarray, label: str, order: int) -> np.ndarray:
    """Hashes of the grams of ``order`` that end at the positions."""
    h = _start(label, GRAM, len(at))
    with np.errstate(over="ignore"):
        for k in range(order):
            h = _mix(h, points[at - k].astype(np.uint64))
    return h


def count_types(docs: DataFrame, order: int = ORDER, text: str = "text", label: str = "lang") -> DataFrame:
    """(label, gram, n): the types of the highest order, as strings, with their counts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, grams, n = (np.concatenate(x) for x in zip(*parts))
            _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return h[first], grams[first], np.bincount(inverse, weights=n).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                _, grams, n = merged(parts)
                for at in range(0, len(n), 20_000):
                    g = grams[at : at + 20_000]
                    s = g.tobytes().decode("utf-32-le", "surrogatepass")
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array([s[i : i + order] for i in range(0, len(s), order)], pa.string()), pa.array(n[at : at + 20_000])], ["label", "gram", "n"])
            held.clear()

        for b in batches:
            rows: dict[str, list[tuple[int, str]]] = {}
            for t, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t and name is not None:
                    rows.setdefault(name, []).append((0, t))
            for name, own in rows.items():
                for points, at, _ in spans(iter(own), order):
                    h, first, n = np.unique(_of_order(points, at, name, order), return_index=True, return_counts=True)
                    held.setdefault(name, []).append((h, points[at[first][:, None] + np.arange(1 - order, 1)], n))
                    size += len(h)
                    if size > 2 * TYPES:
                        held.update({x: [merged(parts)] for x, parts in held.items()})
                        size = sum(len(parts[0][0]) for parts in held.values())
                        if size > TYPES:
                            yield from flush()
                            size = 0
        yield from flush()

    rows = docs.select(F.col(text), F.col(label)).mapInArrow(lean(run), "label string, gram string, n long")
    return rows.groupBy("label", "gram").agg(F.sum("n").alias("n"))


def _without_folds(types: DataFrame, folds: int) -> DataFrame:
    """Counts by language and fold → counts of each language, and of each without one of its folds."""
    split = types.select(F.expr("left(label, length(label) - 1 - length(substring_index(label, '\x01', -1)))").alias("lang"), F.substring_index("label", SEP, -1).cast("int").alias("fold"), "gram", "n")
    own = lambda k: F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0))
    whole = split.groupBy("lang", "gram").agg(F.sum("n").alias("n"), *(own(k).alias(f"n{k}") for k in range(folds)))
    models = F.array(F.struct(F.lit("").alias("model"), F.col("n").alias("n")), *(F.struct(F.lit(str(k)).alias("model"), (F.col("n") - F.col(f"n{k}")).alias("n")) for k in range(folds)))
    return whole.select("lang", "gram", F.explode(models).alias("x")).where("x.n > 0").select(F.concat("lang", F.lit(SEP), "x.model").alias("label"), "gram", "x.n")


def few(df: DataFrame, key: str, rows: int = BROADCAST_LANGS):
    """What marks tables of a row per ``key`` of ``df`` for broadcast, if these are few."""
    return F.broadcast if df.select(key).distinct().count() <= rows else lambda x: x


def train(trusted: DataFrame, order: int = ORDER, folds: int = 0) -> DataFrame:
    """(label, gram, kind, value) entries of the model over (text, lang): the surprisal in nats of each
    seen gram of each order, minus the logarithm of each context's back-off weight, and for each label
    that of the uniform share. With folds, ``lang`` is a language, SEP and a fold, and the labels are
    languages and SEP, with a fold that the model leaves out."""
    types = materialise(count_types(trusted, order), "types")
    types = materialise(_without_folds(types, folds), "types-folds") if folds else types
    side = few(types, "label")
    # types of all orders at once: those of an order are the ends of those of the next
    ends = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.substring("gram", order + 1 - k, k).alias("gram")) for k in range(1, order + 1))))
    held = types.select("label", "n", ends.alias("x")).groupBy("label", "x.k", "x.gram").agg(F.sum("n").alias("n"))
    top = F.when(F.col("k") == order, F.struct(F.col("k").alias("k"), F.col("gram").alias("gram"), F.col("n").alias("n")))
    below = F.when(F.col("k") > 1, F.struct((F.col("k") - 1).alias("k"), F.expr("substring(gram, 2)").alias("gram"), F.lit(1).cast("long").alias("n")))
    level = held.select("label", F.explode(F.array(top, below)).alias("x")).where("x is not null").select("label", "x.*").groupBy("label", "k", "gram").agg(F.sum("n").alias("n"))
    level = materialise(level.select("label", "k", "gram", F.left("gram", F.col("k") - 1).alias("context"), "n"), "orders")
    counts = level.groupBy("label", "k").agg(F.count("*").alias("size"), *(F.sum(F.when(F.col("n") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(1, 5)))
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    # too small a sample has no counts of counts: a constant discount serves
    d = lambda i: F.greatest(F.lit(0.1), F.least(F.coalesce(i - (i + 1) * y * F.col(f"n{i + 1}") / F.when(F.col(f"n{i}") > 0, F.col(f"n{i}")), F.lit(0.5 * i)), F.lit(0.95 * i)))
    discounts = side(counts.select("label", "k", d(1).alias("d1"), d(2).alias("d2"), d(3).alias("d3")))
    uniform = side(counts.where("k = 1").select("label", (1.0 / (F.col("size") + 1)).alias("p")))
    less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = level.join(discounts, ["label", "k"]).select("label", "k", "gram", "context", "n", less.alias("less"))
    contexts = materialise(rows.groupBy("label", "k", "context").agg(F.sum("n").alias("total"), F.sum("less").alias("mass")), "contexts")
    weight = F.col("mass") / F.col("total")
    rows = materialise(rows.join(contexts, ["label", "k", "context"]).select("label", "k", "gram", ((F.col("n") - F.col("less")) / F.col("total")).alias("share"), weight.alias("weight")), "shares")
    entries = uniform.select("label", F.lit("").alias("gram"), F.lit(UNIFORM).alias("kind"), (-F.log("p")).alias("value"))
    entries = entries.union(contexts.select("label", "context", F.lit(WEIGHT), -F.log(weight)))
    lower = None
    for k in range(1, order + 1):
        own = rows.where(F.col("k") == k)
        own = own.join(uniform, "label") if k == 1 else own.withColumn("end", F.substring("gram", 2, k)).join(lower, ["label", "end"])
        seen = own.select("label", "gram", (F.col("share") + F.col("weight") * F.col("p")).alias("p"))
        lower = seen.select("label", F.col("gram").alias("end"), "p")
        entries = entries.union(seen.select("label", "gram", F.lit(GRAM), -F.log("p")))
    return materialise(entries, "model")


def hashed(entries: DataFrame) -> DataFrame:
    """(hash, value) of a model's entries."""
    ship(entries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups: dict[tuple, tuple[list[str], list[int]]] = {}
            for i, (name, gram, kind) in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)))):
                grams, at = groups.setdefault((name, kind, len(gram)), ([], []))
                grams.append(gram)
                at.append(i)
            out = np.zeros(b.num_rows, dtype=np.uint64)
            for (name, kind, k), (grams, at) in groups.items():
                points, h = _points("".join(grams)).reshape(-1, k) if k else None, _start(name, kind, len(at))
                with np.errstate(over="ignore"):
                    for j in range(k - 1, -1, -1):
                        h = _mix(h, points[:, j].astype(np.uint64))
                out[at] = h
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), b.column(3)], ["hash", "value"])

    return entries.select("label", "gram", "kind", "value").mapInArrow(lean(run), "hash long, value double")


class Model:
    """A model's entries in arrays sorted by hash, with the start of each run of leading bits."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray, order: int) -> None:
        hashes = hashes.astype(np.int64, copy=False).view(np.uint64)
        by = np.argsort(hashes)
        # one more at the end, which no run holds
        self.hashes, self.values, self.order = np.append(hashes[by], np.uint64(0)), np.append(values[by], np.nan), order
        self.shift = np.uint64(63 - max(1, int(len(by)).bit_length()))
        runs = np.bincount((self.hashes[:-1] >> self.shift).astype(np.int64), minlength=1 << (64 - int(self.shift)))
        self.start = np.concatenate(([0], np.cumsum(runs))).astype(np.int32)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Values, NaN where there is none."""
        run = (h >> self.shift).astype(np.int64)
        at, end = self.start[run], self.start[run + 1]
        hit = (self.hashes[at] == h) & (at < end)
        out = np.where(hit, self.values[at], np.nan)
        todo = np.flatnonzero(~hit & (at + 1 < end))
        at, end = at[todo], end[todo]
        while len(todo):
            at = at + 1
            hit = self.hashes[at] == h[todo]
            out[todo[hit]] = self.values[at[hit]]
            left = ~hit & (at + 1 < end)
            todo, at, end = todo[left], at[left], end[left]
        return out

    def knows(self, label: str) -> bool:
        return not np.isnan(self.lookup(_start(label, UNIFORM, 1))[0])

    def surprisal(self, points: np.ndarray, at: np.ndarray, label: str) -> np.ndarray:
        """Nats at each position: those of the longest gram that was seen, and the weights of the contexts
        that were seen above it."""
        out = self.lookup(_of_order(points, at, label, self.order))
        todo = np.flatnonzero(np.isnan(out))
        if not len(todo):
            return out
        at, n = at[todo], len(todo)
        with np.errstate(over="ignore"):
            grams, contexts = [_start(label, GRAM, n)], [_start(label, WEIGHT, n)]
            for k in range(self.order - 1):
                grams.append(_mix(grams[-1], points[at - k].astype(np.uint64)))
                contexts.append(_mix(contexts[-1], points[at - 1 - k].astype(np.uint64)))
        total, left = np.zeros(n), np.arange(n)
        for k in range(self.order - 1, -1, -1):
            total[left] += np.nan_to_num(self.lookup(contexts[k][left]))
            found = self.lookup(grams[k][left] if k else _start(label, UNIFORM, len(left)))
            seen = ~np.isnan(found)
            total[left[seen]] += found[seen]
            left = left[~seen]
        out[todo] = total
        return out


def _nats(texts: list, labels: list, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nats, characters, whether the label has a model) of texts."""
    nats, n = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
    rows: dict[str, list[tuple[int, str]]] = {}
    for i, (t, label) in enumerate(zip(texts, labels)):
        if label is not None:
            rows.setdefault(label, []).append((i, t))
    known = {label for label in rows if model.knows(label)}
    for label in known:
        for points, at, own in spans((x for x in rows[label] if x[1]), model.order):
            nats += np.bincount(own, weights=model.surprisal(points, at, label), minlength=len(nats))
            n += np.bincount(own, minlength=len(n))
    return nats, n, np.array([label in known for label in labels], dtype=bool)


def nats_broadcast(docs: DataFrame, model: Model, text: str = "text", label: str = "lang", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (text, label, …) without ``drop`` and with ``nats`` and ``n``: minus the log-probability
    and the number of characters, the end included. Texts of labels without a model have null; empty ones zero."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # BROADCAST_ENTRIES at most
    names = docs.columns
    back = [c for c in names if c not in drop]
    schema = StructType([*(docs.schema[c] for c in back), StructField("nats", DoubleType()), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nats, n, known = _nats(b.column(names.index(text)).to_pylist(), b.column(names.index(label)).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(c)) for c in back), pa.array(nats, mask=~known), pa.array(n, mask=~known)], [*back, "nats", "n"])

    return docs.mapInArrow(lean(run), schema)


def nats_joined(docs: DataFrame, entries: DataFrame, order: int = ORDER, text: str = "text", label: str = "lang", drop: tuple[str, ...] = (), shard_chars: int = SHARD_CHARS) -> DataFrame:
    """The same for models too large to broadcast. Documents are dealt by row to shards of about
    ``shard_chars`` characters; the distinct grams of a shard, one row each, meet the sharded entries of
    every order, and their surprisals go to the shard's documents."""
    spark = docs.sparkSession
    ship(spark)
    names = docs.columns
    back = [c for c in names if c not in drop]
    chars = docs.agg(F.coalesce(F.sum(F.length(text).cast("long")), F.lit(0))).first()[0]
    rows = docs.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chars // shard_chars + 1)).alias("_shard"), "*")
    rows = materialise(rows.repartition("_shard"), "shards")
    need = rows.select("_shard", F.col(text).alias("text"), F.col(label).alias("label"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[int, str], list[tuple[int, str]]] = {}
            for shard, t, name in zip(*(b.column(i).to_pylist() for i in range(3))):
                if t and name is not None:
                    found.setdefault((shard, name), []).append((0, t))
            for (shard, name), own in found.items():
                for points, at, _ in spans(iter(own), order):
                    first = np.unique(_of_order(points, at, name, order), return_index=True)[1]
                    s = points[at[first][:, None] + np.arange(1 - order, 1)].tobytes().decode("utf-32-le", "surrogatepass")
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * len(first), pa.int64()), pa.array([name] * len(first), pa.string()), pa.array([s[i : i + order] for i in range(0, len(s), order)], pa.string())], ["shard", "label", "gram"])

    found = need.mapInArrow(lean(grams), "shard long, label string, gram string").distinct()
    of = lambda kind, k, name: entries.where((F.col("kind") == kind) & (F.length("gram") == k)).select("label", F.col("gram").alias(f"key_{name}"), F.col("value").alias(name))
    uniform = of(UNIFORM, 0, "u").drop("key_u")
    uniform = few(uniform, "label")(uniform)
    value = F.col("u")
    for k in range(1, order + 1):
        end = F.substring("gram", order - k + 1, k)
        found = found.withColumns({f"key_g{k}": end, f"key_c{k}": F.left(end, F.lit(k - 1))})
        found = found.join(of(GRAM, k, f"g{k}"), ["label", f"key_g{k}"], "left").join(of(WEIGHT, k - 1, f"c{k}"), ["label", f"key_c{k}"], "left")
        value = F.coalesce(F.col(f"g{k}"), F.coalesce(F.col(f"c{k}"), F.lit(0.0)) + value)
    resolved = found.join(uniform, "label").select("shard", "label", "gram", F.lit(GRAM).alias("kind"), value.alias("value"))
    # a label's own row marks it as known in each shard that asks for it
    marks = need.select(F.col("_shard").alias("shard"), "label").distinct().join(uniform, "label").select("shard", "label", F.lit(""), F.lit(UNIFORM), "u")
    resolved = materialise(resolved.union(marks), "surprisals")
    keyed = resolved.select("shard", "label", "gram", "kind", "value")
    schema = StructType([*(docs.schema[c] for c in back), StructField("nats", DoubleType()), StructField("n", LongType())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:  # SHARD_CHARS characters, about, and no more grams
        cols = right.combine_chunks().to_batches()
        h, v = [], []
        for b in cols:
            by: dict[tuple, list[int]] = {}
            labels, strings, kinds = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("label", "gram", "kind"))
            for i, (name, kind) in enumerate(zip(labels, kinds)):
                by.setdefault((name, kind), []).append(i)
            values = b.column(b.schema.get_field_index("value")).to_numpy(zero_copy_only=False)
            for (name, kind), at in by.items():
                got = _start(name, kind, len(at))
                if kind == GRAM:
                    points = _points("".join([strings[i] for i in at])).reshape(-1, order)
                    with np.errstate(over="ignore"):
                        for j in range(order - 1, -1, -1):
                            got = _mix(got, points[:, j].astype(np.uint64))
                h.append(got.view(np.int64))
                v.append(values[at])
        model = Model(np.concatenate(h) if h else np.empty(0, dtype=np.int64), np.concatenate(v) if v else np.empty(0), order)
        nats, n, known = _nats(left.column(text).to_pylist(), left.column(label).to_pylist(), model)
        return pa.table([*(left.column(c) for c in back), pa.array(nats, mask=~known), pa.array(n, mask=~known)], names=[*back, "nats", "n"])

    return rows.groupBy("_shard").cogroup(keyed.withColumnRenamed("shard", "_shard").groupBy("_shard")).applyInArrow(score, schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, trusted): ids that labels call good, and none calls bad."""
    return labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id", F.lit(True).alias("trusted"))


#: Columns that the results add, in the place of columns of these names.
ADDED = ("nats", "n", "trusted", "score", "threshold", "keep")


def _scored(docs: DataFrame, labels: DataFrame, id: str, text: str, lang: str, order: int, broadcast_entries: int, with_text: bool, folds: int) -> DataFrame:
    """``docs`` (columns of any names but those that begin with _ and those of ADDED) with ``trusted``,
    ``nats`` and ``n``."""
    ids = trusted_ids(labels).withColumnsRenamed({"doc_id": "_id", "trusted": "_trusted"})
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    marked = docs.join(ids, F.col(id) == F.col("_id"), "left").select(*docs.columns, F.coalesce("_trusted", F.lit(False)).alias("trusted"))
    good = marked.where(F.col("trusted") & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    by = lang
    if folds:
        by, fold = "_model", lambda c: F.pmod(F.xxhash64(c), F.lit(folds)).cast("string")  # equal texts share a fold
        good = good.withColumn("lang", F.concat("lang", F.lit(SEP), fold("text")))
        marked = marked.withColumn(by, F.concat(lang, F.lit(SEP), F.when(F.col("trusted") & F.col(text).isNotNull(), fold(text)).otherwise("")))
    entries = train(good, order, folds)
    drop = (*((by,) if folds else ()), *(() if with_text else (text,)))
    if entries.count() > broadcast_entries:
        return nats_joined(marked, entries, order, text, by, drop)
    got = hashed(entries).toArrow()  # broadcast_entries at most
    return nats_broadcast(marked, Model(got.column("hash").to_numpy(), got.column("value").to_numpy(), order), text, by, drop)


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` without columns of ADDED, under names that clash with none, and these names."""
    names = {c: f"in{i}" for i, c in enumerate(c for c in docs.columns if c not in ADDED)}
    return docs.select(*(F.col(f"`{c}`").alias(x) for c, x in names.items())), names


def perplexities(docs: DataFrame, labels: DataFrame, order: int = ORDER, broadcast_entries: int = BROADCAST_ENTRIES, with_text: bool = True, folds: int = 0) -> DataFrame:
    """``docs`` with ``trusted``, ``nats`` and ``n`` (in the place of columns of ADDED), and without the
    texts if told so. With folds, a trusted document's are those of the model that leaves its fold out;
    null if that is no model."""
    inner, name = _plain(docs)
    found = _scored(inner, labels, name["doc_id"], name["text"], name["lang"], order, broadcast_entries, with_text, folds)
    return found.select(*(F.col(x).alias(c) for c, x in name.items() if with_text or c != "text"), "trusted", "nats", "n")


def judge(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN, shrink: float = SHRINK, with_text: bool = True, folds: int = FOLDS) -> DataFrame:
    """``docs`` (doc_id, text, lang and more) with ``nats``, ``n``, ``score``, ``threshold`` and ``keep``, in
    the place of columns of ADDED; other columns stay, whatever their names.

    ``score`` is the shrunk log-perplexity in nats a character, ``threshold`` that of the document's
    language; ``keep`` is false above it. Trusted documents are scored by a model without their fold.
    Documents of a null language or one with fewer than FEWEST trusted texts, and null or empty texts,
    have nothing against them and are kept. Rows with a null id are scored but never trusted; repeated
    rows stay repeated. Without trusted documents all are kept, and an empty table gives no rows. Texts
    of any length are scored whole. Scores are written once, with the texts unless ``with_text`` is false.
    """
    inner, name = _plain(docs)
    scored = materialise(_scored(inner, labels, name["doc_id"], name["text"], name["lang"], order, BROADCAST_ENTRIES, with_text, folds), "perplexity")
    evidence = scored.where("trusted and n > 0")
    side, lang = few(evidence, name["lang"]), F.col(name["lang"])
    means = side(evidence.groupBy(lang.alias("_of")).agg((F.sum("nats") / F.sum("n")).alias("_mean")))
    score = (F.col("nats") + shrink * F.col("_mean")) / (F.col("n") + shrink)
    limits = evidence.join(means, lang == F.col("_of")).groupBy("_of").agg(F.first("_mean").alias("_mean"), F.percentile_approx(score, quantile, 10_000).alias("_top"), F.count("*").alias("_texts"))
    limit = F.when(F.col("_texts") >= FEWEST, F.col("_top") + margin * F.greatest(F.lit(1.0), ENOUGH / F.col("_texts")))
    found = scored.join(side(limits.select("_of", "_mean", limit.alias("threshold"))), lang == F.col("_of"), "left").withColumn("score", score)
    return found.select(*(F.col(x).alias(c) for c, x in name.items() if with_text or c != "text"), "nats", "n", "score", "threshold", F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True)).alias("keep"))
