"""Sequences, graphs, trees and matches from the relational tables, by rules that SQL can repeat.

* documents give sequences over acgt, letter by letter, whole;
* events give a cyclic path graph (a path a user, a node an event type) and short sequences over ACGTN;
* lineitem gives a layered graph: a path an order, a node a (step, part modulo 8);
* region, nation and supplier give a tree with integer lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plait.functions.sequence import letters_to_bases
from plait.model import PathGraph
from plait.operators.graph import path_edges
from plait.runtime import table

#: Node width of the layered graph.
LANES = 8
# fixed values: event types as bases
EVENT_BASES = {"click": "A", "error": "C", "purchase": "G", "signup": "T", "view": "N"}


def document_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, seq)"""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), letters_to_bases(F.col("text")).alias("seq"))


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path_id, step, node): a user's event types in order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("path_id"), (F.row_number().over(w) - 1).cast("long").alias("step"), F.col("event_type").alias("node"))


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, seq): a base for each event, in order of time."""
    base = F.create_map(*[F.lit(x) for kv in EVENT_BASES.items() for x in kv])[F.col("event_type")]
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("name")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", base.alias("b")))).alias("x"))
    return rows.select("name", F.array_join(F.transform("x", lambda r: r["b"]), "").alias("seq"))


def neighbours(sequences: DataFrame) -> DataFrame:
    """(name1, name2, seq1, seq2) of sequences with successive whole-number names."""
    two = sequences.select((F.col("name") - 1).alias("name1"), F.col("name").alias("name2"), F.col("seq").alias("seq2"))
    return sequences.select(F.col("name").alias("name1"), F.col("seq").alias("seq1")).join(two, "name1").select("name1", "name2", "seq1", "seq2")


#: A total order of an order's lines.
LINE_ORDER = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")


def layered_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path_id, step, node_id, flag)"""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    step = (F.row_number().over(w) - 1).cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path_id"), step.alias("step"), (step * LANES + F.col("l_partkey") % LANES).alias("node_id"), F.col("l_returnflag").alias("flag"))


def layered_graph(spark: SparkSession, sf_dir: str) -> PathGraph:
    steps = layered_steps(spark, sf_dir).select("path_id", "step", "node_id")
    nodes = steps.select("node_id").distinct().select("node_id", F.element_at(F.split(F.lit("A,C,G,T,N"), ","), (F.col("node_id") % 5 + 1).cast("int")).alias("label"))
    return PathGraph(nodes, path_edges(steps), steps)


def layered_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, dst, flag): the distinct steps of the layered paths, with the next node (null at a path's end).
    One shuffle of the lines gives nodes, edges and flags; the rows are as few as edges times flags."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    step, lane = (F.row_number().over(w) - 1).cast("long"), F.col("l_partkey") % LANES
    return table(spark, sf_dir, "lineitem").select((step * LANES + lane).alias("node_id"), ((step + 1) * LANES + F.lead(lane).over(w)).alias("dst"), F.col("l_returnflag").alias("flag")).distinct()


def supply_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, parent_id, label, distance): root, regions, nations, suppliers."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    row = lambda df, i, p, label, d: df.select(i.cast("long").alias("node_id"), p.cast("long").alias("parent_id"), label.alias("label"), d.cast("double").alias("distance"))
    root = row(spark.range(1), F.lit(0), F.lit(None), F.lit("root"), F.lit(None))
    regions = row(region, F.col("r_regionkey") + 1, F.lit(0), F.col("r_name"), F.col("r_regionkey") + 1)
    nations = row(nation, F.col("n_nationkey") + 100, F.col("n_regionkey") + 1, F.col("n_name"), F.col("n_nationkey") % 7 + 1)
    suppliers = row(supplier, F.col("s_suppkey") + 1000, F.col("s_nationkey") + 100, F.col("s_name"), F.col("s_suppkey") % 11 + 1)
    return root.union(regions).union(nations).union(suppliers)


# The same adapters in SQL, as common table expressions.
SQL_DOCS = """seqs as (select doc_id as name, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtac') as seq from documents)"""
SQL_EVENTS = """esteps as (select user_id as path_id, row_number() over (partition by user_id order by ts, event_id) - 1 as step, event_type as node from events)"""
_CASE = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in EVENT_BASES.items()) + " end"
SQL_EVENT_SEQS = f"""eseqs as (select user_id as name, string_agg({_CASE}, '' order by ts, event_id) as seq from events group by user_id)"""
SQL_LAYERED = f"""lsteps as (
  select path_id, step, step * {LANES} + part % {LANES} as node_id, flag from (
    select l_orderkey as path_id, l_partkey as part, l_returnflag as flag,
           row_number() over (partition by l_orderkey order by {", ".join(LINE_ORDER)}) - 1 as step from lineitem)),
lnodes as (select distinct node_id, substr('ACGTN', (node_id % 5 + 1)::int, 1) as label from lsteps),
ledges as (select distinct a.node_id as src, b.node_id as dst from lsteps a join lsteps b on b.path_id = a.path_id and b.step = a.step + 1)"""
SQL_TREE = """tree as (
  select 0::bigint as node_id, null::bigint as parent_id, 'root' as label, null::double as distance
  union all select r_regionkey + 1, 0, r_name, r_regionkey + 1 from region
  union all select n_nationkey + 100, n_regionkey + 1, n_name, n_nationkey % 7 + 1 from nation
  union all select s_suppkey + 1000, s_nationkey + 100, s_name, s_suppkey % 11 + 1 from supplier)"""
