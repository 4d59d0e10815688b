"""Minimal rare matches between two sets of paths, and what masks and budgets do to them.

No suffix array is built. Substrings of one length are counted by grouping; a match of length k is
minimal if neither its prefix nor its suffix of length k - 1 has the same pair of counts, as counts
only fall when a string grows. Lengths go up while some string still occurs on both sides more often
than minimality allows to stop, so the loop ends by itself. Two sets of up to ``ONE_GROUP`` bases are one
bounded group, which an array kernel takes; larger ones are grouped by Spark, a length a round, under
names of 128 bits made from the prefix's name and one more letter, so that keys do not grow with the match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plait.functions.sequence import anchor_weight
from plait.kernels.matches import minimal_rare
from plait.runtime import shared_dir, ship

#: Bases of both sides up to which they are one group.
ONE_GROUP = 2_000_000


def start_positions(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path_id, step, node_id, label) of every base on every path."""
    return steps.join(nodes.select("node_id", "label"), "node_id").select("path_id", "step", "node_id", "label")


def minimal_rare_matches(one: DataFrame, two: DataFrame, max_count: int, longest: int | None = None) -> DataFrame:
    """(match, count1, count2) for two tables of bases (path_id, step, node_id, label).

    Counts are of distinct start nodes a side; a match occurs on both sides, ``count1 * count2`` is at
    most ``max_count``, and no proper substring has the same counts. ``longest`` bounds the length; by
    default the loop runs until no string that is still too frequent occurs on both sides.
    """
    both = one.withColumn("side", F.lit(1)).unionByName(two.withColumn("side", F.lit(2)))
    if both.limit(ONE_GROUP + 1).count() <= ONE_GROUP:
        return _in_one_group(both, max_count, longest)
    shared_dir(one.sparkSession)
    name = lambda *c: F.struct(F.xxhash64(*c).alias("x"), F.xxhash64(F.lit(1), *c).alias("y"))
    none = F.lit(None).cast("struct<x:bigint,y:bigint>")
    at = both.select("side", "path_id", "step", "node_id", "label", name(F.col("label")).alias("s"), none.alias("prefix"), none.alias("suffix")).checkpoint()
    counts = lambda df: df.groupBy("s").agg(F.count_distinct(F.when(F.col("side") == 1, F.col("node_id"))).alias("c1"), F.count_distinct(F.when(F.col("side") == 2, F.col("node_id"))).alias("c2"), F.min(F.struct("side", "path_id", "step")).alias("place"))
    known = counts(at).where("c1 > 0 and c2 > 0").checkpoint()
    rare = lambda df, k: df.where(F.col("c1") * F.col("c2") <= max_count).select("place", F.lit(k).alias("k"), "c1", "c2")
    found = rare(known, 1)
    k = 1
    ahead = Window.partitionBy("side", "path_id").orderBy("step")
    while (longest is None or k < longest) and known.where("c1 * c2 > 1").limit(1).count():
        k += 1
        # a longer match starts with a string that is on both sides with more than one pair of places
        grown = at.select("side", "path_id", "step", "node_id", "label", F.col("s").alias("prefix"), F.lead("s").over(ahead).alias("suffix"), F.lead("step").over(ahead).alias("next"))
        open_ = known.where("c1 * c2 > 1").select(F.col("s").alias("prefix"))
        last = both.select("side", "path_id", (F.col("step") - (k - 1)).alias("step"), F.col("label").alias("last"))
        grown = grown.where("suffix is not null and next = step + 1").join(last, ["side", "path_id", "step"]).withColumn("s", name(F.col("prefix.x"), F.col("prefix.y"), F.col("last")))
        at = grown.join(open_, "prefix", "left_semi").select("side", "path_id", "step", "node_id", "label", "s", "prefix", "suffix").checkpoint()
        now = counts(at).where("c1 > 0 and c2 > 0")
        halves = at.groupBy("s").agg(F.min("prefix").alias("prefix"), F.min("suffix").alias("suffix"))
        seen = lambda a: known.select(F.col("s").alias(a), F.col("c1").alias(f"{a}1"), F.col("c2").alias(f"{a}2"))
        judged = now.join(halves, "s").join(seen("prefix"), "prefix", "left").join(seen("suffix"), "suffix", "left")
        same = lambda a: F.coalesce((F.col("c1") == F.col(f"{a}1")) & (F.col("c2") == F.col(f"{a}2")), F.lit(False))
        judged = judged.select("s", "c1", "c2", "place", (~same("prefix") & ~same("suffix")).alias("minimal")).checkpoint()
        found = found.union(rare(judged.where("minimal"), k))
        known = judged.select("s", "c1", "c2")
    # the letters of one place of each match
    letters = found.select("place.side", "place.path_id", F.col("place.step").alias("begin"), "k", "c1", "c2", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    letters = letters.withColumn("step", F.col("begin") + F.col("i")).join(both.select("side", "path_id", "step", "label"), ["side", "path_id", "step"])
    spelled = letters.groupBy("side", "path_id", "begin", "k", "c1", "c2").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "label"))), lambda x: x["label"]), "").alias("match"))
    return spelled.select("match", F.col("c1").alias("count1"), F.col("c2").alias("count2"))


def _in_one_group(both: DataFrame, max_count: int, longest: int | None) -> DataFrame:
    ship(both.sparkSession)
    rows = both.select(F.col("side").cast("long").alias("side"), F.dense_rank().over(Window.partitionBy("side").orderBy("path_id")).cast("long").alias("path"), F.col("step").cast("long"), F.col("node_id").cast("long"), "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        side, path, step, node = (t.column(i).to_numpy() for i in range(4))
        label = np.array(t.column(4).to_pylist())
        by = np.lexsort((step, path, side))
        side, path, step, node, label = side[by], path[by], step[by], node[by], label[by]
        # a path's steps follow one another without gaps inside a run
        new = np.concatenate(([True], (side[1:] != side[:-1]) | (path[1:] != path[:-1]) | (step[1:] != step[:-1] + 1)))
        end = np.append(np.flatnonzero(new)[1:], len(new))[np.cumsum(new) - 1]
        found = minimal_rare(side - 1, node, label, end - np.arange(len(new)), max_count, longest)
        cols = (["".join(label[i : i + k]) for i, k, _, _ in found], [c for _, _, c, _ in found], [c for *_, c in found])
        for at in range(0, len(found), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 10_000], ty) for c, ty in zip(cols, (pa.string(), pa.int64(), pa.int64()))], ["match", "count1", "count2"])

    return rows.repartition(1).mapInArrow(run, "match string, count1 long, count2 long")


def query_index(matches: DataFrame, function: int = 2, **scores) -> DataFrame:
    """``matches`` (match, count1, count2) of positive weight, with full_length and weight."""
    n = F.length("match").cast("long")
    return matches.withColumn("full_length", n).withColumn("weight", anchor_weight(function, n, F.col("count1"), F.col("count2"), **scores)).where("weight > 0")


def match_walks(matches: DataFrame, bases: DataFrame) -> DataFrame:
    """(match, path_id, step, node_id): every place of every match; of places that begin at one node, the
    first by path and step. Lengths are handled one at a time, as there are few."""
    shared_dir(bases.sparkSession)
    out = None
    for (k,) in matches.select(F.length("match").alias("k")).distinct().orderBy("k").collect():
        w = Window.partitionBy("path_id").orderBy("step").rowsBetween(0, k - 1)
        here = bases.select("path_id", "step", "node_id", F.array_join(F.collect_list("label").over(w), "").alias("match"))
        got = here.join(matches.where(F.length("match") == k).select("match"), "match", "left_semi")
        out = got if out is None else out.union(got)
    if out is None:
        return bases.sparkSession.createDataFrame([], "match string, path_id string, step long, node_id long")
    first = Window.partitionBy("match", "node_id").orderBy("path_id", "step")
    return out.select("match", "path_id", "step", "node_id", F.row_number().over(first).alias("k")).where("k = 1").drop("k")


def diagonal_mask(walks: DataFrame) -> DataFrame:
    """(match, node_id) pairs of a self-comparison that lie on the main diagonal: a walk met with itself."""
    other = walks.select("match", F.col("node_id").alias("n2"))
    return walks.select("match", F.col("node_id").alias("n1")).join(other, "match").where("n1 = n2").select("match", F.col("n1").alias("node_id"))


def chain_mask(pairs: DataFrame, chain: DataFrame) -> DataFrame:
    """Of match pairs (pair_id, nodes1, nodes2), the ids of those that share a pair of nodes at one offset
    with a pair of ``chain``."""
    spread = lambda df: df.select("pair_id", F.posexplode(F.arrays_zip("nodes1", "nodes2")).alias("off", "n")).select("pair_id", "off", "n.nodes1", "n.nodes2")
    return spread(pairs).join(spread(chain).select("nodes1", "nodes2").distinct(), ["nodes1", "nodes2"]).select("pair_id").distinct()


def within_budget(sets: DataFrame, budget: int) -> DataFrame:
    """Match sets (set_id, weight, pairs) in order of weight as long as their pairs fit; a set that does not
    fit is passed over. The greedy scan is sequential, so only (weight, pairs) levels reach it: of sets of
    one size at one weight the first that fit are taken, by id."""
    levels = sets.groupBy("weight", "pairs").agg(F.count("*").alias("n"))

    def scan(rows):
        import pandas as pd

        left, took = budget, []
        for r in rows.sort_values(["weight", "pairs"], ascending=[False, True]).itertuples():
            m = min(int(r.n), left // int(r.pairs)) if r.pairs else int(r.n)
            left -= m * int(r.pairs)
            took.append((r.weight, r.pairs, m))
        return pd.DataFrame(took, columns=["weight", "pairs", "m"])

    taken = levels.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(scan, "weight double, pairs long, m long")
    rank = F.row_number().over(Window.partitionBy("weight", "pairs").orderBy("set_id"))
    return sets.withColumn("k", rank).join(taken, ["weight", "pairs"]).where("k <= m").select(*sets.columns)


def overlapping(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Range join of intervals: rows of ``a`` (path, begin, end, …) with rows of ``b`` (path, begin2, end2, …)
    that overlap, ends exclusive. Intervals are dealt to bins of ``width``; a pair is kept in the first bin
    that both touch, so the join is an equality and no pair is doubled."""
    bins = lambda s, e: F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))
    left = a.where("end > begin").withColumn("bin", F.explode(bins("begin", "end")))
    right = b.where("end2 > begin2").withColumn("bin", F.explode(bins("begin2", "end2")))
    first = F.floor(F.greatest("begin", "begin2") / width)
    return left.join(right, ["path", "bin"]).where((F.col("begin") < F.col("end2")) & (F.col("begin2") < F.col("end")) & (F.col("bin") == first)).drop("bin")


def induced_matches(places: DataFrame, regions: DataFrame, width: int = 1000) -> DataFrame:
    """(region, set_id, side, count, length): global match places (set_id, side, path, begin, end) projected
    into regions (region, path, begin2, end2): the stretches inside, counted, and the longest of them."""
    met = overlapping(places, regions, width)
    inside = F.least("end", "end2") - F.greatest("begin", "begin2")
    return met.groupBy("region", "set_id", "side").agg(F.count("*").alias("count"), F.max(inside).alias("length"))
