"""Registered queries of functions on text, numbers and arrays, of joins and set operations, and of sources
and sinks, each with its SQL. Sinks are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plait import adapters as A
from plait.functions import sequence as S
from plait.operators import alignment, graph, trees
from plait.queries import query
from plait.runtime import shared_dir, table, unique
from plait.sources import fasta, gfa, newick, text


def _folder(spark, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/plait/{kind}-{unique()}"


# --- text and numbers ------------------------------------------------------------------------------


@query("select p_partkey as name, len(t)::int as tokens, t[1] as first, array_to_string(t, '_') as joined from (select p_partkey, string_split(p_type, ' ') as t from part)")
def text_tokens(spark, d):
    """Words of a type with a separator at the end, which adds no token."""
    t = table(spark, d, "part").select("p_partkey", S.tokenize(F.concat("p_type", F.lit(" ")), " ").alias("t"))
    return t.select(F.col("p_partkey").alias("name"), F.size("t").alias("tokens"), F.col("t")[0].alias("first"), S.join("t", "_").alias("joined"))


_WORDS = S.TRUE_WORDS + S.FALSE_WORDS


@query(f"select p_partkey as name, p_size::bigint as whole, p_retailprice::double as number, p_partkey % 12 < {len(S.TRUE_WORDS)} as truth, printf('%x', p_partkey) as hexed from part")
def parsed_values(spark, d):
    word = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("p_partkey") % 12 + 1).cast("int"))
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("i"), F.col("p_retailprice").cast("string").alias("x"), word.alias("b"))
    return p.select(F.col("p_partkey").alias("name"), S.parse_int("i").alias("whole"), S.parse_double("x").alias("number"), S.parse_truth("b").alias("truth"), S.to_hex("p_partkey").alias("hexed"))


@query("select n_regionkey as job, substr(sha256(string_agg(n_name, chr(0) order by n_name)), 1, 16) as digest, count(*)::bigint as n from nation group by 1")
def subproblem_digests(spark, d):
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("job")).agg(S.names_digest(F.collect_list("n_name")).alias("digest"), F.count("*").alias("n"))


_LISTS = "x as (select l_orderkey as name, list(l_quantity::bigint order by " + ", ".join(A.LINE_ORDER) + ") as q, list(l_partkey order by " + ", ".join(A.LINE_ORDER) + ") as p from lineitem group by 1)"


def _lists(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(F.array_sort(F.collect_list(F.struct(*A.LINE_ORDER))).alias("x"))
    return rows.select("name", F.transform("x", lambda r: r["l_quantity"].cast("long")).alias("q"), F.transform("x", lambda r: r["l_partkey"]).alias("p"))


@query(f"""with {_LISTS} select name, list_min(q) as least, list_max(q) as most, len(q)::bigint as n, array_to_string(list_reverse(q), ',') as turned,
  array_to_string([v for v, i in q if i % 2 = 0], ',') as kept, floor(log2(list_max(q)))::int as bit from x""")
def array_utilities(spark, d):
    """Extremes, a reversing permutation inverted and applied, even places left out, and the highest bit."""
    x = _lists(spark, d).withColumn("all", S.number_range(F.size("q"))).withColumn("back", F.reverse("all"))
    odd = F.filter("all", lambda i: i % 2 == 0)
    return x.select("name", F.array_min("q").alias("least"), F.array_max("q").alias("most"), F.size("all").cast("long").alias("n"), F.array_join(S.reordered(F.col("q"), S.inverted(F.col("back"))), ",").alias("turned"), F.array_join(S.without_indices(F.col("q"), odd), ",").alias("kept"), S.high_bit(F.array_max("q")).alias("bit"))


@query(f"""with {_LISTS}, r as (select name, q, p, len(q) // 2 as b, len(q) as e from x) select name, (b + list_position(q[b + 1:e], list_min(q[b + 1:e])) - 1)::bigint as at,
  len(list_distinct([v % 4 for v in p[b + 1:e]]))::int as kinds from r""")
def range_queries(spark, d):
    """Where the least quantity in the second half of an order stands, and how many kinds of parts are there."""
    x = _lists(spark, d).withColumns({"b": F.floor(F.size("q") / 2).cast("int"), "e": F.size("q")})
    kinds = F.transform("p", lambda v: v % 4)
    return x.select("name", S.range_minimum(F.col("q"), F.col("b"), F.col("e")).cast("long").alias("at"), S.range_distinct(kinds, F.col("b"), F.col("e")).alias("kinds"))


@query("select o_custkey as name, o_orderkey as item, (row_number() over (partition by o_custkey order by o_orderkey % 97, o_orderkey))::bigint as place from orders")
def integer_order(spark, d):
    """Orders sorted by a small whole number, within customers."""
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderkey") % 97, "o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("item"), F.row_number().over(w).cast("long").alias("place"))


# --- joins, sets and windows -----------------------------------------------------------------------


@query("""with a as (select l_orderkey as name, l_partkey % 97 as b1, l_partkey % 97 + l_quantity::bigint as e1, l_suppkey % 89 as b2, l_suppkey % 89 + l_quantity::bigint as e2 from lineitem)
  select x.name, count(*)::bigint as pairs, min(y.b1 - x.e1 - (y.b2 - x.e2))::bigint as low, max(y.b1 - x.e1 - (y.b2 - x.e2))::bigint as high from a x join a y on y.name = x.name and y.b1 >= x.e1 and y.b2 >= x.e2 group by 1""")
def colinear_pairs(spark, d):
    """Theta join of anchors: pairs that can follow one another on both sides, with their gaps."""
    b1, b2, n = F.col("l_partkey") % 97, F.col("l_suppkey") % 89, F.col("l_quantity").cast("long")
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("name"), b1.alias("b1"), (b1 + n).alias("e1"), b2.alias("b2"), (b2 + n).alias("e2"))
    y = a.select("name", F.col("b1").alias("c1"), F.col("b2").alias("c2"))
    on = a.join(y, "name").where("c1 >= e1 and c2 >= e2").withColumn("gap", F.expr("c1 - e1 - (c2 - e2)"))
    return on.groupBy("name").agg(F.count("*").alias("pairs"), F.min("gap").alias("low"), F.max("gap").alias("high"))


@query("select s.s_suppkey as one, t.s_suppkey as two, s.s_nationkey as nation from supplier s join supplier t on t.s_nationkey = s.s_nationkey and s.s_suppkey < t.s_suppkey")
def path_pairs(spark, d):
    """All pairs of paths of one graph."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("one"), F.col("s_nationkey").alias("nation"))
    return s.join(s.withColumnRenamed("one", "two"), "nation").where("one < two")


@query("select l_suppkey as name, round(avg(l_quantity), 6) as mean, round(stddev_samp(l_quantity), 6) as deviation, round(var_pop(l_quantity), 6) as spread from lineitem group by 1")
def mean_and_deviation(spark, d):
    q = "l_quantity"
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("name")).agg(F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_samp(q), 6).alias("deviation"), F.round(F.var_pop(q), 6).alias("spread"))


@query("""select o_custkey as name, o_orderkey as item, k::int as rank from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders) where k <= 3""")
def best_of_each(spark, d):
    """The three heaviest orders of each customer."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("item"), "rank")


@query("select o_orderkey as item, o_totalprice as weight from orders order by o_totalprice desc, o_orderkey limit 100")
def best_of_all(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("weight")).orderBy(F.desc("weight"), "item").limit(100)


@query(f"""with {A.SQL_LAYERED}, a as (select distinct node_id from lsteps where flag = 'A'), b as (select distinct node_id from lsteps where flag = 'N')
  select 'both' as kind, node_id from (select * from a intersect select * from b) union all select 'one', node_id from (select * from a except select * from b) union all select 'any', node_id from (select * from a union select * from b)""")
def node_sets(spark, d):
    s = A.layered_steps(spark, d)
    a, b = (s.where(F.col("flag") == f).select("node_id") for f in "AN")
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "node_id")
    return named(a.intersect(b), "both").union(named(a.subtract(b), "one")).union(named(a.union(b).distinct(), "any"))


# --- sources and sinks -----------------------------------------------------------------------------


@query(f"with {A.SQL_EVENT_SEQS} select name::varchar as name, seq from eseqs")
def fasta_round_trip(spark, d):
    path = _folder(spark, "fasta")
    fasta.write(A.event_sequences(spark, d).select(F.col("name").cast("string").alias("name"), "seq"), path, width=60)
    return fasta.read(spark, path)


@query(f"with {A.SQL_TREE}, p as (select a.label, b.label as parent, a.distance from tree a left join tree b on b.node_id = a.parent_id) select replace(label, '#', '/') as label, replace(parent, '#', '/') as parent, distance from p")
def newick_round_trip(spark, d):
    """The supply tree written as Newick text, read again, and its edges by label."""
    rows = A.supply_tree(spark, d).withColumn("label", F.replace("label", F.lit("#"), F.lit("/"))).orderBy("node_id").collect()  # a guide tree: a row a name
    tree, at = trees.Tree(), {}
    for r in rows:
        at[r.node_id] = tree.add(at.get(r.parent_id), r.label, r.distance)
    path = _folder(spark, "newick")
    spark.createDataFrame([(newick.write(tree),)], "value string").coalesce(1).write.text(path)
    again = newick.parse("".join(r.value for r in spark.read.text(path).collect()))
    t = again.to_table(spark)
    up = t.select(F.col("node_id").alias("parent_id"), F.col("label").alias("parent"))
    return t.join(up, "parent_id", "left").select("label", "parent", "distance")


_GFA = f"""{A.SQL_EVENT_SEQS}, g as (select name, seq from eseqs where name % 3 = 0)"""


@query(f"with {_GFA} select name::varchar as path_id, seq, length(seq)::bigint as nodes from g")
def gfa_round_trip(spark, d):
    """Sequences of every third user as a graph, written as GFA, read again, and spelled."""
    g = graph.leaf_graph(A.event_sequences(spark, d).where("name % 3 = 0").select(F.col("name").cast("string").alias("name"), "seq"))
    path = _folder(spark, "gfa")
    gfa.write(g, path)
    again = gfa.read(spark, path)
    return graph.spelled(again.steps, again.nodes).withColumn("nodes", F.length("seq").cast("long"))


@query("select o_orderstatus as chrom, count(*)::bigint as n, sum(o_custkey)::bigint as begins, sum(o_custkey + o_orderkey % 50 + 1)::bigint as ends, count(distinct o_orderpriority)::bigint as names from orders group by 1")
def bed_round_trip(spark, d):
    o = table(spark, d, "orders")
    path = _folder(spark, "bed")
    o.select(F.concat_ws("\t", "o_orderstatus", F.col("o_custkey").cast("string"), (F.col("o_custkey") + F.col("o_orderkey") % 50 + 1).cast("string"), "o_orderpriority").alias("value")).write.text(path)
    return text.read_bed(spark, path).groupBy("chrom").agg(F.count("*").alias("n"), F.sum("begin").alias("begins"), F.sum("end").alias("ends"), F.count_distinct("name").alias("names"))


@query("select l_quantity::bigint as value, count(*)::bigint as n from lineitem group by 1")
def identity_round_trip(spark, d):
    path = _folder(spark, "identity")
    table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").cast("string").alias("value")).write.text(path)
    return text.read_identity(spark, path).groupBy("value").agg(F.count("*").alias("n"))


@query("select n_name as name, n_nationkey::varchar as value from nation")
def config_round_trip(spark, d):
    """Names and numbers written as a configuration and parsed again."""
    rows = table(spark, d, "nation").select("n_name", "n_nationkey").collect()  # a configuration: a row a setting
    path = _folder(spark, "config")
    spark.createDataFrame([(text.write_config({r.n_name: r.n_nationkey for r in rows}),)], "value string").coalesce(1).write.text(path)
    got = text.parse_config(spark.read.text(path, wholetext=True).first().value)
    return spark.createDataFrame(list(got.items()), "name string, value string")


@query(f"with {A.SQL_EVENT_SEQS}, p as (select a.name as block, a.seq as s1, b.seq as s2 from eseqs a join eseqs b on b.name = a.name + 1), n as (select *, greatest(length(s1), length(s2)) as n from p)\n" + """
  select block, 'a' || chr(10) || 's' || chr(9) || block || chr(9) || 0 || chr(9) || length(s1) || chr(9) || '+' || chr(9) || length(s1) || chr(9) || rpad(s1, n::int, '-') || chr(10)
    || 's' || chr(9) || block + 1 || chr(9) || 0 || chr(9) || length(s2) || chr(9) || '+' || chr(9) || length(s2) || chr(9) || rpad(s2, n::int, '-') || chr(10) as text from n""")
def maf_blocks(spark, d):
    """Neighbouring sequences column by column as MAF blocks."""
    p = A.neighbours(A.event_sequences(spark, d)).withColumn("n", F.greatest(F.length("seq1"), F.length("seq2")))
    side = lambda i: [F.col(f"name{i}").cast("string").alias(f"name{i}"), F.when(F.col("pos") <= F.length(f"seq{i}"), F.col("pos") - 1).cast("long").alias(f"at{i}"), F.when(F.col("pos") <= F.length(f"seq{i}"), F.substring(f"seq{i}", F.col("pos"), F.lit(1))).alias(f"base{i}"), F.length(f"seq{i}").cast("long").alias(f"size{i}")]
    cols = p.withColumn("pos", F.explode(F.sequence(F.lit(1), F.col("n")))).select(F.col("name1").alias("block"), "pos", *side(1), *side(2))
    return text.maf_lines(cols)


@query(f"""with {A.SQL_EVENT_SEQS}, pairs as (select a.name as aln_id, a.seq as s1, b.seq as s2 from eseqs a join eseqs b on b.name = a.name + 1),
  cols as (select aln_id, i as pos, s1, s2 from (select *, unnest(range(1, greatest(length(s1), length(s2)) + 1)) as i from pairs))
  select aln_id, pos::bigint as pos, (case when pos <= length(s1) then aln_id || chr(9) || (pos - 1) || chr(9) || substr(s1, pos::int, 1) else '-' || chr(9) || '-' || chr(9) || '-' end) || chr(9)
    || (case when pos <= length(s2) then (aln_id + 1) || chr(9) || (pos - 1) || chr(9) || substr(s2, pos::int, 1) else '-' || chr(9) || '-' || chr(9) || '-' end) as text from cols""")
def subalignment_table(spark, d):
    """Six columns a pair of the column-by-column alignments of neighbours."""
    s = A.event_sequences(spark, d)
    p = A.neighbours(s).withColumn("n", F.greatest(F.length("seq1"), F.length("seq2")))
    cols = p.select(F.col("name1").alias("aln_id"), "seq1", "seq2", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("pos"))
    node = lambda i: F.when(F.col("pos") <= F.length(f"seq{i}"), (F.col("aln_id") + (i - 1)) * 100_000 + F.col("pos") - 1).alias(f"n{i}")
    places = s.select(F.col("name").alias("path_id"), F.posexplode(F.split("seq", "")).alias("step", "label")).where("label != ''")
    places = places.select((F.col("path_id") * 100_000 + F.col("step")).alias("node_id"), "path_id", F.col("step").cast("long").alias("step"), "label")
    return text.subalignment_lines(cols.select("aln_id", "pos", node(1), node(2)), places, places)


@query(f"with {A.SQL_EVENT_SEQS} select a.name as name1, b.name as name2, least(length(a.seq), length(b.seq))::bigint as columns from eseqs a join eseqs b on b.name = a.name + 1")
def cigar_columns(spark, d):
    """Columns on both sides in the plain CIGARs of neighbours."""
    from plait.queries import _ungapped

    runs = alignment.explode_cigar(alignment.cigar(_ungapped(spark, d)[0])).where("op = 'M'")
    return runs.groupBy(F.col("aln_id").alias("name1")).agg(F.sum("n").alias("columns")).withColumn("name2", F.col("name1") + 1)
