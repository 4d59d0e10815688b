"""GFA 1.0: segments, links and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plait.model import PathGraph
from plait.operators import graph


def _checked(ok, what: str, value):
    return F.when(ok, value).otherwise(F.raise_error(F.lit(what)))


def read(spark: SparkSession, path: str) -> PathGraph:
    """Base graph of a GFA file. Records other than H, S, L and P, overlaps other than ``*`` or ``0M``,
    reversing links and reverse steps are errors; a link between two reverse ends is turned round. Bases
    are numbered by segment name and place."""
    rows = spark.read.text(path).where("value != ''").select(F.split("value", "\t").alias("f")).select(F.col("f")[0].alias("kind"), "f", F.size("f").alias("n"))
    other = rows.where("kind not in ('H', 'S', 'L', 'P')").limit(1).count()
    if other:
        raise ValueError("GFA record of an unknown kind")
    s = rows.where("kind = 'S'").select(_checked(F.col("n") >= 3, "short S record", F.col("f")[1]).alias("name"), F.col("f")[2].alias("seq"))
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("len", F.length("seq").cast("long")).withColumn("first", F.coalesce(F.sum("len").over(before), F.lit(0)))  # a row per segment
    at = s.select("name", "first", (F.col("first") + F.col("len") - 1).alias("last"))
    nodes = s.select("first", F.posexplode(F.split("seq", "")).alias("i", "label")).where("label != ''").select((F.col("first") + F.col("i")).alias("node_id"), "label")
    inner = s.where("len > 1").select("first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("len") - 1)).alias("i")).select((F.col("first") + F.col("i") - 1).alias("src"), (F.col("first") + F.col("i")).alias("dst"))
    l = rows.where("kind = 'L'").select(_checked(F.col("n") >= 6, "short L record", F.col("f")[1]).alias("a"), F.col("f")[2].alias("oa"), F.col("f")[3].alias("b"), F.col("f")[4].alias("ob"), F.col("f")[5].alias("o"))
    l = l.select(_checked(F.col("o").isin("*", "0M"), "GFA link with an overlap", F.col("a")).alias("a"), "b", "oa", "ob").select(_checked(F.col("oa") == F.col("ob"), "reversing GFA link", F.col("a")).alias("a"), "b", "oa")
    l = l.select(F.when(F.col("oa") == "+", F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("oa") == "+", F.col("b")).otherwise(F.col("a")).alias("b"))
    links = l.join(at.select(F.col("name").alias("a"), F.col("last").alias("src")), "a").join(at.select(F.col("name").alias("b"), F.col("first").alias("dst")), "b").select("src", "dst")
    p = rows.where("kind = 'P'").select(_checked(F.col("n") >= 4, "short P record", F.col("f")[1]).alias("path_id"), F.posexplode(F.split(F.col("f")[2], ",")).alias("k", "s"))
    p = p.select("path_id", "k", _checked(F.col("s").endswith("+"), "reverse step in a GFA path", F.expr("left(s, length(s) - 1)")).alias("name")).join(at, "name")
    w = Window.partitionBy("path_id").orderBy("k", "node_id")
    steps = p.select("path_id", "k", F.explode(F.sequence("first", "last")).alias("node_id")).select("path_id", (F.row_number().over(w) - 1).cast("long").alias("step"), "node_id")
    return PathGraph(nodes, inner.union(links), steps)


def lines(g: PathGraph) -> DataFrame:
    """(ord, value): the records of a graph with non-branching runs as segments, numbered from 1."""
    u = graph.unipaths(g.nodes, g.edges, g.steps).checkpoint()
    order = Window.orderBy("unipath")
    names = u.select("unipath").distinct().select("unipath", F.row_number().over(order).alias("name"))  # a row per segment
    u = u.join(names, "unipath")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]), "")
    s = u.join(g.nodes, "node_id").groupBy("name").agg(text.alias("seq")).select(F.lit(1).alias("ord"), F.concat_ws("\t", F.lit("S"), "name", "seq").alias("value"))
    ends = u.groupBy("name").agg(F.max_by("node_id", "place").alias("src"), F.min_by("node_id", "place").alias("dst"))
    e = graph.make_simple(g.edges).join(ends.select("src", F.col("name").alias("a")), "src").join(ends.select("dst", F.col("name").alias("b")), "dst")
    l = e.select(F.lit(2).alias("ord"), F.concat_ws("\t", F.lit("L"), "a", F.lit("+"), "b", F.lit("+"), F.lit("*")).alias("value"))
    first = g.steps.join(u.where("place = 0").select("node_id", "name"), "node_id")
    walk = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "name"))), lambda x: F.concat(x["name"].cast("string"), F.lit("+"))), ",")
    p = first.groupBy("path_id").agg(walk.alias("walk")).select(F.lit(3).alias("ord"), F.concat_ws("\t", F.lit("P"), "path_id", "walk", F.lit("*")).alias("value"))
    head = g.nodes.sparkSession.createDataFrame([(0, "H\tVN:Z:1.0")], "ord int, value string")
    return head.union(s).union(l).union(p)


def write(g: PathGraph, path: str) -> None:
    lines(g).orderBy("ord", "value").select("value").write.text(path)
