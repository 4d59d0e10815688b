"""Registered queries of the sequence-graph operators, each with the SQL that gives the same rows where
SQL can say it. All run over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plait import adapters as A
from plait.functions import sequence as S
from plait.operators import alignment, graph, matching, trees
from plait.runtime import table

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from plait import graph_queries, kernel_queries, table_queries  # noqa: F401  register their own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_oracles)


# --- sequences -----------------------------------------------------------------------------------


@query(f"with {A.SQL_DOCS} select name, translate(upper(seq), 'ACGTN', '01234') as code, length(seq)::bigint as n from seqs")
def seq_encode(spark, d):
    return A.document_sequences(spark, d).select("name", S.encode_bases("seq").alias("code"), F.length("seq").cast("long").alias("n"))


@query(f"with {A.SQL_DOCS} select name, translate(translate(upper(seq), 'ACGTN', '01234'), '01234', 'ACGTN') = upper(seq) as same from seqs")
def seq_decode(spark, d):
    s = A.document_sequences(spark, d)
    return s.select("name", (S.decode_bases(S.encode_bases("seq")) == F.upper("seq")).alias("same"))


@query(f"""with {A.SQL_DOCS} select base, sum(length(seq) - length(replace(seq, base, '')))::bigint as n,
  count(*) filter (where contains(seq, base))::bigint as docs from seqs cross join (values ('a'), ('c'), ('g'), ('t')) b(base) group by base""")
def seq_base_counts(spark, d):
    per = [F.struct(F.lit(b).alias("base"), (F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))).cast("long").alias("k")) for b in "acgt"]
    one = A.document_sequences(spark, d).select(F.explode(F.array(*per)).alias("x")).select("x.*")
    return one.groupBy("base").agg(F.sum("k").alias("n"), F.sum((F.col("k") > 0).cast("long")).alias("docs"))


@query(f"""with {A.SQL_EVENT_SEQS} select kmer, count(*)::bigint as n, count(distinct name)::bigint as seqs from (
  select name, substr(seq, i::int, 5) as kmer from (select name, seq, unnest(range(1, length(seq) - 3)) as i from eseqs)) group by kmer""")
def kmer_counts(spark, d):
    k = A.event_sequences(spark, d).select("name", F.explode(S.kmers("seq", 5)).alias("kmer"))
    per = k.groupBy("kmer", "name").agg(F.count("*").alias("n"))
    return per.groupBy("kmer").agg(F.sum("n").alias("n"), F.count("*").alias("seqs"))


@query(f"""with {A.SQL_DOCS}, k as (select name, substr(seq, i::int, 12) as kmer from (select name, seq, unnest(range(1, length(seq) - 10)) as i from seqs))
  select c as times, count(*)::bigint as kmers from (select kmer, count(*) as c from k group by kmer) group by c""")
def kmer_spectrum(spark, d):
    k = A.document_sequences(spark, d).select(F.explode(S.kmers("seq", 12)).alias("kmer"))
    return k.groupBy("kmer").agg(F.count("*").alias("times")).groupBy("times").agg(F.count("*").alias("kmers"))


_UNIQUE = f"""{A.SQL_EVENT_SEQS}, k as (select name, i - 1 as pos, substr(seq, i::int, 6) as kmer from (select name, seq, unnest(range(1, length(seq) - 4)) as i from eseqs)),
u as (select name, kmer, min(pos) as pos from k group by name, kmer having count(*) = 1)"""


def unique_kmers(seqs: DataFrame, k: int) -> DataFrame:
    """(name, kmer, at): k-mers that a sequence holds once."""
    rows = seqs.select("name", F.posexplode(S.kmers("seq", k)).alias("at", "kmer"))
    return rows.groupBy("name", "kmer").agg(F.count("*").alias("c"), F.min("at").cast("long").alias("at")).where("c = 1").drop("c")


@query(f"with {_UNIQUE} select a.name as name1, b.name as name2, a.kmer, a.pos as at1, b.pos as at2 from u a join u b on b.name = a.name + 1 and b.kmer = a.kmer")
def shared_unique_kmers(spark, d):
    u = unique_kmers(A.event_sequences(spark, d), 6)
    two = u.select((F.col("name") - 1).alias("name1"), F.col("name").alias("name2"), "kmer", F.col("at").alias("at2"))
    return u.select(F.col("name").alias("name1"), "kmer", F.col("at").alias("at1")).join(two, ["name1", "kmer"]).select("name1", "name2", "kmer", "at1", "at2")


# --- scores --------------------------------------------------------------------------------------

_ANCHORS = "anchors as (select l_orderkey as a, l_linenumber as b, l_partkey as id, (l_quantity * 10 + 1)::bigint as len, (l_partkey % 5 + 1)::bigint as c1, (l_suppkey % 7 + 1)::bigint as c2, (l_quantity * 10 + 1)::bigint + l_partkey % 13 as fl from lineitem)"


def _anchors(spark, d) -> DataFrame:
    n = (F.col("l_quantity") * 10 + 1).cast("long")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), n.alias("len"), (F.col("l_partkey") % 5 + 1).alias("c1"), (F.col("l_suppkey") % 7 + 1).alias("c2"), (n + F.col("l_partkey") % 13).alias("fl"))


@query(f"""with {_ANCHORS} select f as function, id, round(sum(w), 4) as weight, count(*)::bigint as n from (
  select id, f, case f when 0 then len / fl / sqrt(c1 * c2) when 1 then len / fl * len / sqrt(c1 * c2)
    when 2 then len / fl * (len / sqrt(c1 * c2) - pow(len / 2250.0, 2) * 2250.0) else len / fl * (len - c1 * c2 * pow(len / 2250.0, 2) * 2250.0) end as w
  from (select id, len::double as len, c1, c2, fl::double as fl from anchors) cross join (values (0), (1), (2), (3)) t(f)) where w > 0 group by f, id""")
def match_score_filter(spark, d):
    a = _anchors(spark, d)
    each = F.array(*[F.struct(F.lit(f).alias("function"), S.anchor_weight(f, F.col("len"), F.col("c1"), F.col("c2"), F.col("fl")).alias("w")) for f in range(4)])
    rows = a.select("id", F.explode(each).alias("x")).select("id", "x.*").where("w > 0")
    return rows.groupBy("function", "id").agg(F.round(F.sum("w"), 4).alias("weight"), F.count("*").alias("n"))


@query("""select l_orderkey as name, round(sum(case when g = 0 then 0.0 else greatest(-(1.25 + 2.5 * abs(g)), -(50 + 0.1 * abs(g)), -(5000 + 0.0015 * abs(g))) end), 4) as score
  from (select l_orderkey, l_partkey % 401 - l_suppkey % 97 as g from lineitem) group by l_orderkey""")
def anchor_gap_scores(spark, d):
    g = F.col("l_partkey") % 401 - F.col("l_suppkey") % 97
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(F.round(F.sum(S.gap_score(g, [1.25, 50, 5000], [2.5, 0.1, 0.0015])), 4).alias("score"))


@query("""select l_suppkey as name, round(pow(avg(pow(l_quantity, -0.5)), -2.0), 6) as half, round(exp(avg(ln(l_quantity))), 6) as geometric, max(l_quantity) as top from lineitem group by l_suppkey""")
def hoelder_means(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("name")).agg(F.round(S.hoelder_mean(q, -0.5), 6).alias("half"), F.round(S.hoelder_mean(q, 0), 6).alias("geometric"), S.hoelder_mean(q, float("inf")).alias("top"))


@query("""with s as (select l_orderkey as name, (l_quantity)::bigint as v, row_number() over (partition by l_orderkey order by l_quantity::bigint) as r, count(*) over (partition by l_orderkey) as n from lineitem)
  select name, ((sum(v) filter (where r = (n + 1) // 2) + sum(v) filter (where r = n // 2 + 1))::bigint // 2)::bigint as median from s group by name""")
def integer_medians(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(S.integer_median(F.col("l_quantity").cast("long")).alias("median"))


@query("""select o_custkey as name, round(max(lo + ln(1 + exp(-abs(x - y)))), 6) as total from (
  select o_custkey, o_totalprice / 1e5 as x, o_orderkey % 9 as y, greatest(o_totalprice / 1e5, o_orderkey % 9) as lo from orders) group by o_custkey""")
def add_logs(spark, d):
    x, y = F.col("o_totalprice") / 1e5, (F.col("o_orderkey") % 9).cast("double")
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("name")).agg(F.round(F.max(S.add_log(x, y)), 6).alias("total"))


@query("""select l_orderkey as name, least(sum(a::hugeint + b), 9223372036854775807)::bigint as total, max(least(a::hugeint * b, 9223372036854775807))::bigint as product
  from (select l_orderkey, l_partkey * 4000000000000000 % 9000000000000000001 as a, l_suppkey * 70000000000000000 % 9000000000000000001 as b from lineitem) group by l_orderkey""")
def saturating_sums(spark, d):
    a, b = (F.expr(f"cast(cast({c} as decimal(38,0)) * {m} % 9000000000000000001 as bigint)") for c, m in (("l_partkey", 4000000000000000), ("l_suppkey", 70000000000000000)))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("name"), a.alias("a"), b.alias("b"))
    top = F.lit(S.SATURATED).cast("decimal(38,0)")
    total = F.least(F.sum(F.col("a").cast("decimal(38,0)") + F.col("b")), top).cast("long")
    return rows.groupBy("name").agg(total.alias("total"), F.max(S.saturating_multiply(F.col("a"), F.col("b"))).alias("product"))


@query("""select part, count(*)::bigint as n, sum(e - b)::bigint as bases from (
  select regexp_extract(s, '^(.*):([0-9]+)-([0-9]+)$', 1) as part, regexp_extract(s, '^(.*):([0-9]+)-([0-9]+)$', 2)::bigint as b, regexp_extract(s, '^(.*):([0-9]+)-([0-9]+)$', 3)::bigint as e
  from (select p_brand || ':' || p_type || ':' || p_size || '-' || (p_size + p_partkey % 100) as s from part)) group by part""")
def subpath_names(spark, d):
    name = F.concat("p_brand", F.lit(":"), "p_type", F.lit(":"), F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + F.col("p_partkey") % 100).cast("string"))
    part, b, e = S.subpath(F.col("s"))
    return table(spark, d, "part").select(name.alias("s")).select(part.alias("part"), b.alias("b"), e.alias("e")).groupBy("part").agg(F.count("*").alias("n"), F.sum(F.col("e") - F.col("b")).alias("bases"))


# --- graphs --------------------------------------------------------------------------------------


@query(f"with {A.SQL_EVENTS} select a.node as src, b.node as dst, count(*)::bigint as walks from esteps a join esteps b on b.path_id = a.path_id and b.step = a.step + 1 group by all")
def path_transitions(spark, d):
    return graph.path_edges(A.event_steps(spark, d).withColumnRenamed("node", "node_id"), multiplicity=True)


@query(f"with {A.SQL_EVENTS} select node as node_id, path_id, count(*)::bigint as visits, min(step) as first, max(step) as last from esteps group by all")
def step_index(spark, d):
    i = graph.step_index(A.event_steps(spark, d).withColumnRenamed("node", "node_id"))
    return i.groupBy("node_id", "path_id").agg(F.max("visit").cast("long").alias("visits"), F.min("step").alias("first"), F.max("step").alias("last"))


@query(f"""with {A.SQL_EVENT_SEQS}, placed as (select name, length(seq) as n, coalesce(sum(length(seq)) over (order by name rows between unbounded preceding and 1 preceding), 0) as first from eseqs)
  select name as path_id, n::bigint as n, first::bigint as first_node, (first + n - 1)::bigint as last_node, (n - 1)::bigint as edges from placed""")
def leaf_graph_build(spark, d):
    g = graph.leaf_graph(A.event_sequences(spark, d))
    per = g.steps.groupBy("path_id").agg(F.count("*").alias("n"), F.min("node_id").alias("first_node"), F.max("node_id").alias("last_node"))
    ends = g.steps.join(g.edges.select(F.col("src").alias("node_id")), "node_id").groupBy("path_id").agg(F.count("*").alias("edges"))
    return per.join(ends, "path_id").select("path_id", "n", "first_node", "last_node", "edges")


@query(f"""with {A.SQL_LAYERED} select n.node_id, (select count(*) from ledges e where e.dst = n.node_id)::bigint as in_degree, (select count(*) from ledges e where e.src = n.node_id)::bigint as out_degree from lnodes n""")
def graph_degrees(spark, d):
    g = A.layered_graph(spark, d)
    return graph.degrees(g.nodes, g.edges)


@query(f"""with {A.SQL_LAYERED}, ends as (select path_id, min(step) as a, max(step) as b from lsteps group by 1)
  select distinct * from (
    select -1::bigint as src, node_id as dst from lnodes where node_id not in (select dst from ledges) union all
    select -1, node_id from lsteps s join ends e on e.path_id = s.path_id and s.step = e.a union all
    select node_id, -2 from lnodes where node_id not in (select src from ledges) union all
    select node_id, -2 from lsteps s join ends e on e.path_id = s.path_id and s.step = e.b)""")
def graph_sentinels(spark, d):
    g = A.layered_graph(spark, d)
    return graph.sentinel_edges(g.nodes, g.edges, g.steps)


@query("select distinct l_partkey as src, l_suppkey as dst from lineitem")
def graph_simple_edges(spark, d):
    return graph.make_simple(table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query(f"""with {A.SQL_LAYERED}, kept as (select distinct node_id from lsteps where flag = 'R'), e as (select src, dst from ledges where src in (select node_id from kept) and dst in (select node_id from kept))
  select k.node_id, (select count(*) from e where e.src = k.node_id)::bigint as edges from kept k""")
def graph_purge_uncovered(spark, d):
    g = A.layered_graph(spark, d)
    g = graph.purge_uncovered(graph.PathGraph(g.nodes, g.edges, A.layered_steps(spark, d).where("flag = 'R'").select("path_id", "step", "node_id")))
    return g.nodes.select("node_id").join(g.edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("e")), "node_id", "left").select("node_id", F.coalesce("e", F.lit(0)).alias("edges"))


@query(f"""with {A.SQL_LAYERED}, d as (select node_id, (select count(*) from ledges e where e.dst = n.node_id) as i, (select count(*) from ledges e where e.src = n.node_id) as o from lnodes n),
  ends as (select path_id, min(step) as a, max(step) as b from lsteps group by 1),
  st as (select distinct node_id from lsteps s join ends e on e.path_id = s.path_id and s.step = e.a), en as (select distinct node_id from lsteps s join ends e on e.path_id = s.path_id and s.step = e.b),
  inner_ as (select src, dst from ledges where src in (select node_id from d where o = 1) and dst in (select node_id from d where i = 1) and dst not in (select node_id from st) and src not in (select node_id from en))
  , recursive_ as (with recursive r(node_id, up, far) as (select node_id, node_id, 0::bigint from lnodes where node_id not in (select dst from inner_) union all select i.dst, r.up, r.far + 1 from r join inner_ i on i.src = r.node_id) select * from r)
  select node_id, up as unipath, far as place from recursive_""")
def graph_compact_unipaths(spark, d):
    g = A.layered_graph(spark, d)
    return graph.unipaths(g.nodes, g.edges, g.steps)


_LAYERS = f"""{A.SQL_LAYERED}, down as (with recursive r(node_id, k) as (
  select node_id, 0 from lnodes where node_id not in (select dst from ledges) union select e.dst, r.k + 1 from r join ledges e on e.src = r.node_id) select node_id, min(k) as lo, max(k) as hi from r group by 1)"""


@query(f"with {_LAYERS} select node_id, hi::int as layer from down")
def dag_layers(spark, d):
    g = A.layered_graph(spark, d)
    return graph.layers(g.nodes, g.edges).select("node_id", F.col("layer").cast("int").alias("layer"))


@query(f"with {_LAYERS} select hi::int as layer, count(*)::bigint as nodes from down group by hi")
def dag_antichains(spark, d):
    """Antichains: nodes of one longest-walk layer cannot reach one another."""
    g = A.layered_graph(spark, d)
    return graph.layers(g.nodes, g.edges).groupBy(F.col("layer").cast("int").alias("layer")).agg(F.count("*").alias("nodes"))


@query(f"with {_LAYERS} select node_id, lo::int as min_distance, hi::int as max_distance from down")
def dag_minmax_distance(spark, d):
    g = A.layered_graph(spark, d)
    return graph.minmax_distance(g.nodes, g.edges).select("node_id", F.col("min_distance").cast("int").alias("min_distance"), F.col("max_distance").cast("int").alias("max_distance"))


def _walk_sql(depth: int = 24) -> str:
    """One expression per layer: sources count 1, and a node sums what its predecessors one layer up have;
    edges of this graph always join successive layers."""
    parts = ["w0 as (select node_id, 1::hugeint as walks from lnodes where node_id not in (select dst from ledges))"]
    for k in range(1, depth):
        parts.append(f"w{k} as materialized (select e.dst as node_id, sum(w.walks)::hugeint as walks from w{k - 1} w join ledges e on e.src = w.node_id group by e.dst)")
    union = " union all ".join(f"select * from w{k}" for k in range(depth))
    return f"with {A.SQL_LAYERED}, {', '.join(parts)} select node_id, least(sum(walks), 9223372036854775807)::bigint as walks from ({union}) group by node_id"


@query(_walk_sql())
def dag_walk_counts(spark, d):
    g = A.layered_graph(spark, d)
    return graph.count_walks(g.nodes, g.edges)


@query(f"with {A.SQL_LAYERED} select distinct a.src, b.dst from ledges a join ledges b on b.src = a.dst")
def dag_two_hop(spark, d):
    e = A.layered_graph(spark, d).edges
    return e.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()


_FLAG_PATHS = f"""{A.SQL_LAYERED}, fsteps as (select flag as path_id, row_number() over (partition by flag order by node_id) - 1 as step, node_id from (select distinct flag, node_id from lsteps)),
  closure as (with recursive r(src, dst) as (select node_id, node_id from lnodes union select r.src, e.dst from r join ledges e on e.src = r.dst) select * from r)"""


@query(f"with {_FLAG_PATHS} select c.dst as node_id, s.path_id, max(s.step)::bigint as last_step from closure c join fsteps s on s.node_id = c.src group by all")
def dag_reachability(spark, d):
    g = A.layered_graph(spark, d)
    flags = A.layered_steps(spark, d).select(F.col("flag").alias("path_id"), "node_id").distinct()
    w = Window.partitionBy("path_id").orderBy("node_id")
    steps = flags.select("path_id", (F.row_number().over(w) - 1).cast("long").alias("step"), "node_id")
    return graph.reach(steps, g.edges)


@query(f"with {A.SQL_LAYERED}, r as (with recursive r(node_id, hops) as (select 0::bigint, 0 union select e.dst, r.hops + 1 from r join ledges e on e.src = r.node_id) select * from r) select node_id, min(hops)::int as hops from r group by 1")
def dag_shortest_paths(spark, d):
    g = A.layered_graph(spark, d)
    return graph.shortest_paths(g.edges, spark.range(1).select(F.col("id").alias("node_id"))).select("node_id", F.col("hops").cast("int").alias("hops"))


@query(f"""with {A.SQL_LAYERED}, t as (select max(node_id) as node_id from lnodes), r as (with recursive r(node_id, hops) as (select node_id, 0 from t union select e.src, r.hops + 1 from r join ledges e on e.dst = r.node_id) select * from r)
  select node_id, min(hops)::int as hops from r group by 1""")
def dag_target_reachability(spark, d):
    g = A.layered_graph(spark, d)
    return graph.target_reachability(g.edges, g.nodes.agg(F.max("node_id").alias("node_id"))).select("node_id", F.col("hops").cast("int").alias("hops"))


@query(f"""with {A.SQL_LAYERED}, ahead as (with recursive r(n) as (select 1::bigint union select e.dst from r join ledges e on e.src = r.n) select * from r),
  t as (select max(node_id) as n from lnodes), back as (with recursive r(n) as (select n from t union select e.src from r join ledges e on e.dst = r.n) select * from r)
  select n as node_id from ahead where n in (select n from back) and n <> 1 and n not in (select n from t)""")
def graph_extract_connecting(spark, d):
    g = A.layered_graph(spark, d)
    return graph.connecting_nodes(g.edges, spark.range(1, 2).select(F.col("id").alias("node_id")), g.nodes.agg(F.max("node_id").alias("node_id")))


@query("""with e as (select distinct o_custkey as a, 1000000000 + o_orderkey % 3001 as b from orders), r as (with recursive r(n, m) as (
    select n, n from (select a as n from e union select b from e) union
    select x.n, r.m from r join (select a as m, b as n from e union select b, a from e) x on x.m = r.n where r.m < x.n) select * from r)
  select n as node_id, min(m) as component from r group by n""")
def graph_components(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.lit(1000000000) + F.col("o_orderkey") % 3001).alias("dst"))
    nodes = o.select(F.col("src").alias("node_id")).union(o.select("dst")).distinct()
    return graph.components(nodes, o)


del _oracles["graph_components"]  # the closure in SQL grows with the square of a component; tested on a small one


_TWO = f"""{A.SQL_LAYERED}, a as (select distinct node_id from lsteps where flag = 'A'), b as (select distinct node_id from lsteps where flag = 'N'), m as (select max(node_id) + 1 as m from a),
  ea as (select distinct x.node_id as src, y.node_id as dst from lsteps x join lsteps y on y.path_id = x.path_id and y.step = x.step + 1 where x.flag = 'A' and y.flag = 'A'),
  eb as (select distinct x.node_id as src, y.node_id as dst from lsteps x join lsteps y on y.path_id = x.path_id and y.step = x.step + 1 where x.flag = 'N' and y.flag = 'N')"""


def _two_graphs(spark, d) -> list:
    out = []
    label = F.element_at(F.split(F.lit("A,C,G,T,N"), ","), (F.col("node_id") % 5 + 1).cast("int")).alias("label")
    for flag in ("A", "N"):
        s = A.layered_steps(spark, d).where(F.col("flag") == flag).select("path_id", "step", "node_id")
        two = s.select("path_id", (F.col("step") - 1).alias("step"), F.col("node_id").alias("dst"))
        e = s.select("path_id", "step", F.col("node_id").alias("src")).join(two, ["path_id", "step"]).select("src", "dst").distinct()
        out.append(graph.PathGraph(s.select("node_id").distinct().select("node_id", label), e, s))
    return out


@query(f"with {_TWO} select src, dst from ea union all select src + m, dst + m from eb, m")
def graph_append(spark, d):
    a, b = _two_graphs(spark, d)
    return graph.append(a, b).edges.select("src", "dst")


@query(f"""with {_TWO}, pairs as (select b.node_id as n2, b.node_id - b.node_id % 2 as n1 from b where b.node_id - b.node_id % 2 in (select node_id from a)),
  t as (select b.node_id as o, coalesce((select n1 from pairs p where p.n2 = b.node_id and n1 % 5 = n2 % 5), b.node_id + (select m from m)) as t from b)
  select src, dst from ea union select x.t, y.t from eb join t x on x.o = eb.src join t y on y.o = eb.dst""")
def graph_fuse_edges(spark, d):
    a, b = _two_graphs(spark, d)
    pairs = b.nodes.select((F.col("node_id") - F.col("node_id") % 2).alias("n1"), F.col("node_id").alias("n2")).join(a.nodes.select(F.col("node_id").alias("n1")), "n1", "left_semi")
    return graph.fuse(a, b, pairs).edges.select("src", "dst")


@query(f"""with {A.SQL_LAYERED}, t as (select node_id, min(node_id) over (partition by node_id // 40, label) as t from lnodes)
  select distinct x.t as src, y.t as dst from ledges e join t x on x.node_id = e.src join t y on y.node_id = e.dst""")
def graph_internal_fuse(spark, d):
    """Nodes of each forty successive ids are aligned in a row; equal labels among them merge."""
    g = A.layered_graph(spark, d)
    w = Window.partitionBy(F.expr("node_id div 40")).orderBy("node_id")
    pairs = g.nodes.select(F.lag("node_id").over(w).alias("n1"), F.col("node_id").alias("n2"))
    return graph.internal_fuse(g, pairs).edges.select("src", "dst")


# --- matches -------------------------------------------------------------------------------------


@query(f"""with {A.SQL_LAYERED}, w as (select node_id % 5 as match, path_id, node_id from lsteps)
  select distinct match, node_id from w""")
def diagonal_mask(spark, d):
    s = A.layered_steps(spark, d).select((F.col("node_id") % 5).alias("match"), "node_id").distinct()
    return matching.diagonal_mask(s)


@query("""with x as (select l_orderkey as pair_id, l_partkey as n1, l_suppkey as n2, l_returnflag as f from lineitem)
  select distinct pair_id from x where f = 'N' and (n1, n2) in (select (n1, n2) from x where f = 'A')""")
def chain_mask(spark, d):
    """Pairs of one return flag that overlap a chain, the pairs of another."""
    at = F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber")))
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pair_id"), "l_returnflag").agg(at.alias("x"))
    p = p.select("pair_id", "l_returnflag", F.transform("x", lambda r: r["l_partkey"]).alias("nodes1"), F.transform("x", lambda r: r["l_suppkey"]).alias("nodes2"))
    return matching.chain_mask(p.where("l_returnflag = 'N'"), p.where("l_returnflag = 'A'"))


# --- alignments ----------------------------------------------------------------------------------


@query(f"""with {A.SQL_EVENTS}, r as (select *, step - row_number() over (partition by path_id, node order by step) as g from esteps), runs as (select path_id, node, g, count(*) as n, min(step) as head from r group by all)
  select path_id, string_agg(n || upper(substr(node, 1, 1)), '' order by head) as cigar from runs group by path_id""")
def cigar_run_lengths(spark, d):
    s = A.event_steps(spark, d).select("path_id", "step", F.upper(F.substring("node", 1, 1)).alias("op"))
    return alignment.join_runs(alignment.run_lengths(s, "path_id", "step", "op"), "path_id")


_COLUMNS = f"""{A.SQL_EVENT_SEQS}, pairs as (select a.name as aln_id, a.seq as s1, b.seq as s2 from eseqs a join eseqs b on b.name = a.name + 1),
  cols as (select aln_id, i as pos, case when i <= length(s1) then substr(s1, i::int, 1) end as l1, case when i <= length(s2) then substr(s2, i::int, 1) end as l2 from (select *, unnest(range(1, greatest(length(s1), length(s2)) + 1)) as i from pairs)),
  ops as (select aln_id, pos, case when l1 is null then 'I' when l2 is null then 'D' when l1 = l2 then '=' else 'X' end as op from cols),
  runs as (select aln_id, op, g, count(*) as n, min(pos) as head from (select *, pos - row_number() over (partition by aln_id, op order by pos) as g from ops) group by all),
  cigars as (select aln_id, string_agg(n || op, '' order by head) as cigar from runs group by aln_id)"""


def _ungapped(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Neighbouring sequences column by column, the longer one's rest against a gap, with labels."""
    p = A.neighbours(A.event_sequences(spark, d)).withColumn("n", F.greatest(F.length("seq1"), F.length("seq2")))
    cols = p.select(F.col("name1").alias("aln_id"), "seq1", "seq2", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("pos"))
    at = lambda s, side: F.when(F.col("pos") <= F.length(s), F.col("aln_id") * 10000 + F.lit(side * 5000) + F.col("pos"))
    cols = cols.select("aln_id", F.col("pos").cast("long").alias("pos"), at("seq1", 0).alias("n1"), at("seq2", 1).alias("n2"), F.substring("seq1", F.col("pos"), F.lit(1)).alias("l1"), F.substring("seq2", F.col("pos"), F.lit(1)).alias("l2"))
    labels = lambda n, b: cols.where(f"{n} is not null").select(F.col(n).alias("node_id"), F.col(b).alias("label"))
    return cols.select("aln_id", "pos", "n1", "n2"), labels("n1", "l1"), labels("n2", "l2")


@query(f"with {_COLUMNS} select aln_id, cigar from cigars")
def explicit_cigars(spark, d):
    return alignment.cigar(*_ungapped(spark, d))


@query(f"""with {_COLUMNS} select aln_id, string_agg(n || o, '' order by head) as cigar from (
  select aln_id, o, g, count(*) as n, min(pos) as head from (select aln_id, pos, o, pos - row_number() over (partition by aln_id, o order by pos) as g from (select aln_id, pos, case op when '=' then 'M' when 'X' then 'M' else op end as o from ops)) group by all) group by aln_id""")
def cigars(spark, d):
    return alignment.cigar(_ungapped(spark, d)[0])


@query(f"with {_COLUMNS} select aln_id, op, sum(n)::bigint as n, min(head - 1)::bigint as first from runs group by all")
def cigar_explode(spark, d):
    runs = alignment.explode_cigar(alignment.cigar(*_ungapped(spark, d)))
    at = F.greatest("begin1", "begin2")
    return runs.groupBy("aln_id", "op").agg(F.sum("n").alias("n"), F.min(at).alias("first"))


@query(f"with {_COLUMNS} select aln_id, sum(case op when '=' then 20 * n when 'X' then -80 * n else greatest(-(60 + 30 * n), -(800 + 5 * n), -(2500 + n)) end)::bigint as score from runs group by aln_id")
def score_alignments(spark, d):
    runs = alignment.explode_cigar(alignment.cigar(*_ungapped(spark, d)))
    return alignment.score(runs, "aln_id", 20, 80, [60, 800, 2500], [30, 5, 1])


_PATHS = f"""{A.SQL_LAYERED}, j as (select coalesce(a.p, b.p) as path1, a.step as s1, b.step as s2 from
   (select path_id as p, node_id, step from lsteps where path_id + 1 in (select path_id from lsteps)) a full join
   (select path_id - 1 as p, node_id, step from lsteps where path_id - 1 in (select path_id from lsteps)) b on b.p = a.p and b.node_id = a.node_id)"""


def _induced(spark, d) -> DataFrame:
    s = A.layered_steps(spark, d).select("path_id", "step", "node_id")
    ids = s.select("path_id").distinct()
    pairs = ids.join(ids.select((F.col("path_id") - 1).alias("path_id")), "path_id", "left_semi").select(F.col("path_id").alias("path1"), (F.col("path_id") + 1).alias("path2"))
    return alignment.induced(s, pairs)


@query(f"with {_PATHS} select path1, path1 + 1 as path2, s1 as step1, s2 as step2 from j")
def induced_pairwise(spark, d):
    return _induced(spark, d)


@query(f"with {_PATHS} select path1, path1 + 1 as path2, count(*) filter (where s1 is not null and s2 is not null)::bigint as shared, count(*) filter (where s2 is null)::bigint as only1, count(*) filter (where s1 is null)::bigint as only2 from j group by 1")
def induced_identity(spark, d):
    return alignment.induced_summary(_induced(spark, d))


@query(f"with {A.SQL_EVENT_SEQS} select a.name as name1, b.name as name2, levenshtein(a.seq, b.seq)::int as distance from eseqs a join eseqs b on b.name = a.name + 1")
def edit_distance(spark, d):
    return A.neighbours(A.event_sequences(spark, d)).select("name1", "name2", F.levenshtein("seq1", "seq2").alias("distance"))


@query(f"""with {_COLUMNS}, m as (select aln_id, count(*) filter (where l1 is not null) as n1, count(*) filter (where l2 is not null) as n2, count(*) filter (where l1 = l2) as m, count(*) filter (where l1 <> l2) as x from cols group by 1)
  select aln_id % 10 as name, round(2.0 * sum(m) / sum(n1 + n2), 6) as match_rate, round(sum(m + x) / sum(least(n1, n2)), 6) as completeness, round(sum(m) / sum(m + x), 6) as accuracy from m group by 1""")
def truth_metrics(spark, d):
    runs = alignment.explode_cigar(alignment.cigar(*_ungapped(spark, d)))
    on = lambda ops: F.sum(F.when(F.col("op").isin(ops), F.col("n")).otherwise(0))
    per = runs.groupBy("aln_id").agg(on(["=", "X", "D"]).alias("n1"), on(["=", "X", "I"]).alias("n2"), on(["="]).alias("matches"), on(["X"]).alias("mismatches"))
    per = per.select((F.col("aln_id") % 10).alias("name"), "n1", "n2", "matches", "mismatches", (F.col("matches") + F.col("mismatches")).alias("aligned"), F.least("n1", "n2").alias("truth"))
    return alignment.truth_metrics(per, "name").select("name", *[F.round(c, 6).alias(c) for c in ("match_rate", "completeness", "accuracy")])


# --- trees ---------------------------------------------------------------------------------------

_CLOSURE = f"{A.SQL_TREE}, up as (with recursive r(node_id, ancestor, edges, distance) as (select node_id, node_id, 0, 0.0::double from tree union all select r.node_id, t.parent_id, r.edges + 1, r.distance + t.distance from r join tree t on t.node_id = r.ancestor where t.parent_id is not null) select * from r), leaf as (select node_id from tree where node_id not in (select parent_id from tree where parent_id is not null))"


@query(f"with {_CLOSURE} select node_id, max(edges)::int as edges, max(distance) as depth from up group by 1")
def tree_depths(spark, d):
    return trees.ancestors(A.supply_tree(spark, d)).groupBy("node_id").agg(F.max("edges").alias("edges"), F.max("distance").alias("depth"))


@query(f"with {_CLOSURE} select ancestor, node_id as leaf from up where node_id in (select node_id from leaf)")
def tree_leaf_sets(spark, d):
    t = A.supply_tree(spark, d)
    return trees.leaf_sets(t, trees.ancestors(t))


@query(f"""with {_CLOSURE}, l as (select * from up where node_id in (select node_id from leaf)) select a, b, distance from (
  select x.node_id as a, y.node_id as b, x.distance + y.distance as distance, row_number() over (partition by x.node_id, y.node_id order by x.edges) as k from l x join l y on y.ancestor = x.ancestor and x.node_id < y.node_id) where k = 1""")
def tree_leaf_pair_distance(spark, d):
    t = A.supply_tree(spark, d)
    return trees.leaf_pair_distances(t, trees.ancestors(t))


@query("""with l as (select s_suppkey as leaf, s_nationkey as one, s_nationkey % 9 as two from supplier), a as (select one, list(leaf order by leaf) as s from l group by 1), b as (select two, list(leaf order by leaf) as s from l group by 1)
  select a.one as node, len(a.s)::int as leaves, least(len(a.s), (select count(*) from l) - len(a.s))::bigint as minor, exists (select 1 from b where b.s = a.s) as found from a""")
def tree_bipartition_compare(spark, d):
    """Splits by nation against splits by nation modulo nine."""
    s = table(spark, d, "supplier")
    sides = lambda c: s.groupBy(c.alias("node")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("s"))
    one, two, n = sides(F.col("s_nationkey")), sides(F.col("s_nationkey") % 9), s.agg(F.count("*").alias("n"))
    found = two.select("s", F.lit(True).alias("found"))
    return one.join(found, "s", "left").crossJoin(F.broadcast(n)).select("node", F.size("s").alias("leaves"), F.least(F.size("s").cast("long"), F.col("n") - F.size("s")).alias("minor"), F.coalesce("found", F.lit(False)).alias("found"))
