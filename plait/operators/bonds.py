"""Bonds, which join copies within one path, and bubbles of equal alleles.

A bond table has (bond_id, path_id, part, offset1, offset2, length): the parts of a bond align ``length`` bases
of its path from ``offset1`` with those from ``offset2``, in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plait.model import PathGraph
from plait.operators import alignment, graph

BOND = "bond_id long, path_id string, part int, offset1 long, offset2 long, length long"
_COLUMNS = [c.split()[0] for c in BOND.split(", ")]


def write(bonds: DataFrame, path: str) -> None:
    """The table that a restart reads."""
    bonds.select(*_COLUMNS).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*_COLUMNS)


def bonded_nodes(steps: DataFrame, bonds: DataFrame) -> DataFrame:
    """(n1, n2): the nodes that bonds align."""
    places = bonds.select("path_id", "offset1", "offset2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("i")).where("i >= 0")
    places = places.select("path_id", (F.col("offset1") + F.col("i")).alias("s1"), (F.col("offset2") + F.col("i")).alias("s2"))
    at = lambda i: steps.select("path_id", F.col("step").alias(f"s{i}"), F.col("node_id").alias(f"n{i}"))
    return places.join(at(1), ["path_id", "s1"]).join(at(2), ["path_id", "s2"]).select("n1", "n2")


def applied(g: PathGraph, bonds: DataFrame) -> PathGraph:
    """The graph in which nodes that bonds align are merged, by label, so that copies share a cycle."""
    return graph.internal_fuse(g, bonded_nodes(g.steps, bonds))


def cigars(bonds: DataFrame, lengths: DataFrame) -> DataFrame:
    """(bond_id, cigar) of each bond as an alignment of its path with itself: what lies before the bond on
    either side, the parts and what lies between them, and what lies behind, as gaps. ``lengths`` is
    (path_id, n)."""
    w = Window.partitionBy("bond_id").orderBy("part")
    end = lambda i: F.col(f"offset{i}") + F.col("length")
    before = lambda i: F.col(f"offset{i}") - F.coalesce(F.lag(end(i)).over(w), F.lit(0))
    rows = bonds.join(lengths, "path_id").select("bond_id", "part", "length", before(1).alias("d"), before(2).alias("i"), (F.col("n") - end(1)).alias("d2"), (F.col("n") - end(2)).alias("i2"), F.lead("part").over(w).isNull().alias("last"))
    ops = [("d", "D"), ("i", "I"), ("length", "M"), ("d2", "D"), ("i2", "I")]
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(op).alias("op"), F.when(F.col("last") | F.lit(k < 3), F.col(c)).alias("n")) for k, (c, op) in enumerate(ops)))
    runs = rows.select("bond_id", "part", F.explode(each).alias("x")).where("x.n > 0").select("bond_id", (F.col("part") * 8 + F.col("x.k")).alias("run"), "x.op", "x.n")
    return alignment.join_runs(runs, "bond_id")


def without_equal_alleles(g: PathGraph, bubbles: DataFrame) -> PathGraph:
    """The graph in which walks of one spelling through a bubble (start, end; flat and without cycles) are the
    first of them, by path and step; nodes that no path then covers go."""
    first = g.steps.join(bubbles.select(F.col("start").alias("node_id"), F.col("end").alias("to")), "node_id").select("path_id", F.col("step").alias("begin"), F.col("node_id").alias("start"), "to")
    ends = g.steps.select("path_id", F.col("step").alias("close"), F.col("node_id").alias("to"))
    visits = first.join(ends, ["path_id", "to"]).where("close > begin").groupBy("path_id", "begin", "start", "to").agg(F.min("close").alias("close"))
    inner = visits.join(g.steps, "path_id").where("step > begin and step < close").join(g.nodes, "node_id")
    inner = inner.select("path_id", "begin", "start", "to", "step", (F.col("step") - F.col("begin")).alias("place"), "node_id", "label")
    spelled = inner.groupBy("path_id", "begin", "start", "to").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]), "").alias("allele"))
    kept = spelled.groupBy("start", "to", "allele").agg(F.min(F.struct("path_id", "begin")).alias("one"))
    to = spelled.join(kept, ["start", "to", "allele"]).select("path_id", "begin", "start", "to", F.col("one.path_id").alias("p"), F.col("one.begin").alias("b"))
    walk = inner.select(F.col("path_id").alias("p"), F.col("begin").alias("b"), "start", "to", "place", F.col("node_id").alias("new"))
    moved = inner.join(to, ["path_id", "begin", "start", "to"]).join(walk, ["p", "b", "start", "to", "place"]).select("path_id", "step", F.col("new").alias("node_id"))
    steps = graph.reassigned(g.steps, moved)
    edges = graph.make_simple(g.edges.union(graph.path_edges(steps)))
    return graph.purge_uncovered(PathGraph(g.nodes, edges, steps))


def shown(g: PathGraph) -> DataFrame:
    """(node_id, text): a line a node, its label and the nodes that follow it."""
    after = graph.make_simple(g.edges).groupBy(F.col("src").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("next"))
    return g.nodes.join(after, "node_id", "left").select("node_id", F.concat(F.col("node_id").cast("string"), F.lit(":"), "label", F.lit(" -> "), F.coalesce("next", F.lit(""))).alias("text"))
