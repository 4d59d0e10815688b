"""Registered queries of graph edits, orders, walks and reachability indexes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait import adapters as A
from plait.operators import graph
from plait.queries import _LAYERS, query
from plait.runtime import materialise, table

_CLOSED = f"""{A.SQL_LAYERED}, closure as (with recursive r(src, dst) as (select node_id, node_id from lnodes union select r.src, e.dst from r join ledges e on e.src = r.dst) select * from r)"""
_FLAGS = f"""{_CLOSED}, fsteps as (select flag as path_id, row_number() over (partition by flag order by node_id) - 1 as step, node_id from (select distinct flag, node_id from lsteps))"""


def _flag_steps(spark, d) -> DataFrame:
    """(path_id, step, node_id): the nodes of each return flag in order, as three paths that overlap."""
    return _in_order(A.layered_steps(spark, d))


def _in_order(steps: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    flags = steps.select(F.col("flag").alias("path_id"), "node_id").distinct()
    w = Window.partitionBy("path_id").orderBy("node_id")
    return flags.select("path_id", (F.row_number().over(w) - 1).cast("long").alias("step"), "node_id")


@query(f"""with {A.SQL_LAYERED}, n as (select node_id, case when node_id % 5 = 1 then 'N' else label end as label from lnodes where node_id % 7 <> 0 union all select node_id + 100000, 'A' from lnodes where node_id % 9 = 0),
  e as (select src, dst from ledges where src % 7 <> 0 and dst % 7 <> 0 and (src + dst) % 11 <> 0 union all select node_id + 100000, node_id + 100009 from lnodes where node_id % 9 = 0)
  select n.node_id, n.label, (select count(*) from e where e.src = n.node_id)::bigint as out_edges from n""")
def graph_edits(spark, d):
    """Nodes added, removed and relabelled, edges added and removed."""
    g = A.layered_graph(spark, d)
    ninth = g.nodes.where("node_id % 9 = 0").select((F.col("node_id") + 100_000).alias("node_id"), F.lit("A").alias("label"))
    out = graph.without_nodes(g, g.nodes.where("node_id % 7 = 0"))
    out = graph.relabelled(out, out.nodes.where("node_id % 5 = 1").select("node_id", F.lit("N").alias("label")))
    out = graph.without_edges(out, out.edges.where("(src + dst) % 11 = 0"))
    out = graph.with_edges(graph.with_nodes(out, ninth), ninth.select(F.col("node_id").alias("src"), (F.col("node_id") + 9).alias("dst")))
    n = out.edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("out_edges"))
    return out.nodes.join(n, "node_id", "left").select("node_id", "label", F.coalesce("out_edges", F.lit(0)).alias("out_edges"))


@query(f"""with {A.SQL_LAYERED}, n as (select path_id, count(*) as n from lsteps group by 1),
  a as (select path_id, step + 1 as step, case when step = 1 then node_id + 100000 else node_id end as node_id from lsteps union all select path_id, 0, 900000 from n union all select path_id, n + 1, 900001 from n)
  select path_id, step::bigint as step, node_id::bigint as node_id from a""")
def path_edits(spark, d):
    """Each path with another second node, one step in front and one behind."""
    s = A.layered_steps(spark, d).select("path_id", "step", "node_id")
    s = graph.reassigned(s, s.where("step = 1").select("path_id", "step", (F.col("node_id") + 100_000).alias("node_id")))
    one = lambda node: s.select("path_id").distinct().select("path_id", F.lit(0).cast("long").alias("step"), F.lit(node).cast("long").alias("node_id"))
    return graph.extended(graph.extended(s, one(900_000), front=True), one(900_001))


@query(f"""with {A.SQL_LAYERED}, d as (select node_id, row_number() over (order by node_id) - 1 as k from lnodes) select x.k::bigint as src, y.k::bigint as dst from ledges e join d x on x.node_id = e.src join d y on y.node_id = e.dst""")
def graph_densified(spark, d):
    return graph.densified(A.layered_graph(spark, d)).edges


@query(f"""with {A.SQL_LAYERED}, e as (select src, dst from ledges where (src + dst) % 3 <> 0), ends as (select path_id, min(step) as a, max(step) as b from lsteps group by 1)
  select distinct * from (
    select -1::bigint as src, node_id as dst from lnodes where node_id not in (select dst from e) union all
    select -1, node_id from lsteps s join ends e on e.path_id = s.path_id and s.step = e.a union all
    select node_id, -2 from lnodes where node_id not in (select src from e) union all
    select node_id, -2 from lsteps s join ends e on e.path_id = s.path_id and s.step = e.b union all select -2, -1)""")
def graph_sentinels_again(spark, d):
    """Sentinels of a graph that has lost edges, with the edge that closes the cycle."""
    g = A.layered_graph(spark, d)
    old = g.edges.union(graph.sentinel_edges(g.nodes, g.edges, g.steps)).where("(src + dst) % 3 != 0 or src < 0 or dst < 0")
    kept = graph.without_sentinels(old)
    return graph.cycle_closed(graph.reassigned_sentinels(g.nodes, kept, g.steps))


@query(f"with {_LAYERS} select node_id, (row_number() over (order by hi, node_id) - 1)::bigint as place from down")
def dag_topological_order(spark, d):
    g = A.layered_graph(spark, d)
    return graph.topological_order(g.nodes, g.edges)


_HOPS = f"""{A.SQL_LAYERED}, h as (select node_id, min(hops) as hops from (with recursive r(node_id, hops) as (select 0::bigint, 0 union select e.dst, r.hops + 1 from r join ledges e on e.src = r.node_id) select * from r) group by 1)"""


@query(f"""with {_HOPS}, back as (select e.dst as node_id, min(e.src) as before from ledges e join h x on x.node_id = e.src join h y on y.node_id = e.dst where y.hops = x.hops + 1 group by 1),
  w as (with recursive r(step, node_id) as (select hops, node_id from h where node_id = (select max(node_id) from lnodes) union all select r.step - 1, b.before from r join back b on b.node_id = r.node_id) select * from r)
  select step::bigint as step, node_id from w""")
def dag_shortest_walk(spark, d):
    """The nodes of a shortest walk from the first node to the last."""
    g = A.layered_graph(spark, d)
    return graph.shortest_walk(g.edges, spark.range(1).select(F.col("id").alias("node_id")), g.nodes.agg(F.max("node_id").alias("node_id")))


@query(f"""with {_CLOSED}, t as (select max(node_id) as n from lnodes), k as (select c.dst as n from closure c, t where c.src = 1 and c.dst <> 1 and c.dst <> t.n and exists (select 1 from closure b where b.src = c.dst and b.dst = t.n))
  select src, dst from ledges where src in (select n from k) and dst in (select n from k)""")
def graph_connecting_edges(spark, d):
    g = A.layered_graph(spark, d)
    return graph.connecting_graph(g, spark.range(1, 2).select(F.col("id").alias("node_id")), g.nodes.agg(F.max("node_id").alias("node_id"))).edges


@query(f"with {_CLOSED} select 'ahead' as side, dst as node_id from closure where src = 9 and dst <> 9 union all select 'behind', src from closure where dst = 9 and src <> 9")
def graph_extending(spark, d):
    """What one node reaches, and what reaches it."""
    e, start = A.layered_graph(spark, d).edges, spark.range(9, 10).select(F.col("id").alias("node_id"))
    side = lambda forward, name: graph.extending_nodes(e, start, forward).select(F.lit(name).alias("side"), "node_id")
    return side(True, "ahead").union(side(False, "behind"))


@query(f"with {_FLAGS}, on_path as (select distinct node_id from fsteps), p as (select a.node_id as a, b.node_id as b from lnodes a join lnodes b on b.node_id between a.node_id - 20 and a.node_id + 20)\n"
       "  select a, b, exists (select 1 from fsteps s join closure c on c.dst = p.b join fsteps t on t.path_id = s.path_id and t.node_id = c.src where s.node_id = p.a and s.step <= t.step) as reachable from p")
def dag_reachable_pairs(spark, d):
    """Whether some path leads from one of two near nodes to a step from which the other is reached."""
    g = A.layered_graph(spark, d)
    n = g.nodes.select("node_id")
    pairs = n.select(F.col("node_id").alias("a"), F.explode(F.sequence(F.col("node_id") - 20, F.col("node_id") + 20)).alias("b")).join(n.withColumnRenamed("node_id", "b"), "b", "left_semi")
    steps = _flag_steps(spark, d)
    return graph.reachable(pairs, graph.reach(steps, g.edges), steps)


@query(f"with {_FLAGS}, last as (select c.dst as node_id, s.path_id, max(s.step) as k from closure c join fsteps s on s.node_id = c.src group by all)\n"
       "  select l.node_id, l.path_id, s.node_id as from_node from last l join fsteps s on s.path_id = l.path_id and s.step = l.k")
def dag_forward_edges(spark, d):
    g, steps = A.layered_graph(spark, d), _flag_steps(spark, d)
    return graph.forward_edges(graph.reach(steps, g.edges), steps)


@query(f"with {_FLAGS}, last as (select c.dst as node_id, s.path_id, max(s.step) as k from closure c join fsteps s on s.node_id = c.src group by all)\n"
       "  select l.node_id, l.path_id, s.node_id as from_node from last l join fsteps s on s.path_id = l.path_id and s.step = l.k where l.node_id % 3 = 0 and s.node_id % 2 = 0")
def dag_masked_forward_edges(spark, d):
    """Forward edges from ends to starts of matches."""
    g, steps = A.layered_graph(spark, d), _flag_steps(spark, d)
    forward = graph.forward_edges(graph.reach(steps, g.edges), steps)
    return graph.masked_forward_edges(forward, g.nodes.where("node_id % 3 = 0"), g.nodes.where("node_id % 2 = 0"))


_CHAINS = f"""{_CLOSED}, d as (select node_id, (select count(*) from ledges e where e.dst = n.node_id) as i, (select count(*) from ledges e where e.src = n.node_id) as o from lnodes n),
  ends as (select path_id, min(step) as a, max(step) as b from lsteps group by 1),
  st as (select distinct node_id from lsteps s join ends e on e.path_id = s.path_id and s.step = e.a), en as (select distinct node_id from lsteps s join ends e on e.path_id = s.path_id and s.step = e.b),
  inner_ as (select src, dst from ledges where src in (select node_id from d where o = 1) and dst in (select node_id from d where i = 1) and dst not in (select node_id from st) and src not in (select node_id from en)),
  chain as (with recursive r(node_id, up, far) as (select node_id, node_id, 0::bigint from lnodes where node_id not in (select dst from inner_) union all select i.dst, r.up, r.far + 1 from r join inner_ i on i.src = r.node_id) select * from r)"""


@query(f"with {_CHAINS} select c.dst as node_id, s.up as path_id, max(s.far)::bigint as last_step from closure c join chain s on s.node_id = c.src group by all")
def dag_chain_merge(spark, d):
    """Reachability over a cover by chains without common nodes."""
    g = A.layered_graph(spark, d)
    return graph.reach(graph.chain_cover(g.nodes, g.edges, g.steps), g.edges)


@query(f"""with {_FLAGS}, far as (with recursive r(src, dst, hops) as (select node_id, node_id, 0 from lnodes union select r.src, e.dst, r.hops + 1 from r join ledges e on e.src = r.dst) select src, dst, min(hops) as hops from r group by 1, 2),
  last as (select c.dst as node_id, s.path_id, max(s.step) as k from closure c join fsteps s on s.node_id = c.src group by all)
  select l.node_id, l.path_id, l.k::bigint as last_step, f.hops::bigint as distance from last l join fsteps s on s.path_id = l.path_id and s.step = l.k join far f on f.src = s.node_id and f.dst = l.node_id""")
def dag_post_switch_distances(spark, d):
    moves = materialise(A.layered_moves(spark, d), "moves")  # the lines are sorted once
    edges = moves.where("dst is not null").select(F.col("node_id").alias("src"), "dst").distinct()
    return graph.post_switch_distances(_in_order(moves), edges)


@query("""with e as (select p_partkey as a, p_partkey + p_size % 13 as b from part where p_size % 3 = 0), n as (select p_partkey as x from part union select b from e),
  r as (with recursive r(n, m) as (select x, x from n union select x.n, r.m from r join (select a as m, b as n from e union select b, a from e) x on x.m = r.n) select * from r)
  select n as node_id, min(m) as component from r group by n""")
def part_components(spark, d):
    """Connected components of many small parts."""
    p = table(spark, d, "part")
    e = p.where("p_size % 3 = 0").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + F.col("p_size") % 13).alias("dst"))
    nodes = p.select(F.col("p_partkey").alias("node_id")).union(e.select("dst")).distinct()
    return graph.components(nodes, e)


@query(f"""with {A.SQL_LAYERED}, e as (select src * 2 + 1 as a, dst * 2 as b from ledges where (src + dst) % 5 = 0), n as (select node_id * 2 as x from lnodes union select node_id * 2 + 1 from lnodes),
  r as (with recursive r(n, m) as (select x, x from n union select x.n, r.m from r join (select a as m, b as n from e union select b, a from e) x on x.m = r.n) select * from r)
  select (n // 2)::bigint as node_id, (n % 2)::int as side, min(m)::bigint as component from r group by n""")
def graph_side_components(spark, d):
    """Adjacency components of node sides, over a fifth of the edges."""
    g = A.layered_graph(spark, d)
    return graph.side_components(g.nodes, g.edges.where("(src + dst) % 5 = 0"))


@query(f"with {_LAYERS} select (select count(*) from lnodes where node_id not in (select node_id from down)) = 0 as acyclic, false as closed")
def graph_is_acyclic(spark, d):
    """The layered graph, and the same with an edge back."""
    g = A.layered_graph(spark, d)
    back = g.edges.agg(F.max("dst").alias("src"), F.min("src").alias("dst"))
    return spark.createDataFrame([(graph.is_acyclic(g.nodes, g.edges), graph.is_acyclic(g.nodes, g.edges.union(back)))], "acyclic boolean, closed boolean")


def _bonds(spark, d) -> tuple:
    """The leaf graph of event sequences, and a bond of its first three bases with the next three on each."""
    from plait.operators.bonds import BOND

    s = A.event_sequences(spark, d)
    g = graph.leaf_graph(s)
    at = s.where("length(seq) >= 8").select(F.col("name").alias("bond_id"), F.col("name").alias("path_id"), F.explode(F.array(*(F.struct(F.lit(k).alias("part"), F.lit(a).alias("offset1"), F.lit(b).alias("offset2"), F.lit(n).alias("length")) for k, (a, b, n) in enumerate([(0, 4, 2), (3, 6, 1)])))).alias("x"))
    at = at.select("bond_id", "path_id", "x.*").select(*(F.col(c.split()[0]).cast("long" if c.split()[0] == "path_id" else c.split()[1]) for c in BOND.split(", ")))
    return g, at, s.select(F.col("name").alias("path_id"), F.length("seq").cast("long").alias("n"))


@query(f"""with {A.SQL_EVENT_SEQS} select name as path_id, (length(seq) - case when length(seq) >= 8 then (substr(seq, 1, 1) = substr(seq, 5, 1))::int + (substr(seq, 2, 1) = substr(seq, 6, 1))::int + (substr(seq, 4, 1) = substr(seq, 7, 1))::int else 0 end)::bigint as nodes from eseqs""")
def bonds_applied(spark, d):
    """Nodes of each path after its bonds have merged those of equal label."""
    from plait.operators import bonds

    g, b, _ = _bonds(spark, d)
    return bonds.applied(g, b).steps.groupBy("path_id").agg(F.count_distinct("node_id").alias("nodes"))


@query(f"""with {A.SQL_EVENT_SEQS} select name as bond_id, '4I2M1D1M' || case when length(seq) > 4 then (length(seq) - 4) || 'D' else '' end || case when length(seq) > 7 then (length(seq) - 7) || 'I' else '' end as cigar from eseqs where length(seq) >= 8""")
def bond_cigars(spark, d):
    """Bonds written, read again, and padded to alignments of their path with itself."""
    from plait.operators import bonds
    from plait.runtime import shared_dir, unique

    _, b, n = _bonds(spark, d)
    path = f"{shared_dir(spark).rstrip('/')}/plait/bonds-{unique()}"
    bonds.write(b, path)
    return bonds.cigars(bonds.read(spark, path), n)


@query(f"""with {A.SQL_LAYERED}, v as (select a.path_id, m.node_id, n.label from lsteps a join lsteps b on b.path_id = a.path_id and b.step = 3 and b.node_id % 2 = 0 join lsteps m on m.path_id = a.path_id and m.step = 2 join lnodes n on n.node_id = m.node_id where a.step = 1 and a.node_id % 2 = 0),
  w as (select v.path_id, (select x.node_id from v x join lsteps xa on xa.path_id = x.path_id and xa.step = 1 join lsteps xb on xb.path_id = x.path_id and xb.step = 3 where x.label = v.label and xa.node_id = a.node_id and xb.node_id = b.node_id order by x.path_id limit 1) as new
    from v join lsteps a on a.path_id = v.path_id and a.step = 1 join lsteps b on b.path_id = v.path_id and b.step = 3)
  select s.path_id, s.step::bigint as step, case when s.step = 2 and w.new is not null then w.new else s.node_id end as node_id from lsteps s left join w on w.path_id = s.path_id""")
def bubbles_simplified(spark, d):
    """Walks of one spelling between even nodes of the second and the fourth layer are the first of them."""
    from plait.operators import bonds

    g = A.layered_graph(spark, d)
    even = lambda k, c: g.nodes.where(f"node_id div {A.LANES} = {k} and node_id % 2 = 0").select(F.col("node_id").alias(c))
    return bonds.without_equal_alleles(g, even(1, "start").join(even(3, "end"))).steps


@query(f"with {A.SQL_LAYERED} select n.node_id, n.node_id || ':' || n.label || ' -> ' || coalesce((select string_agg(e.dst, ',' order by e.dst) from ledges e where e.src = n.node_id), '') as text from lnodes n")
def graph_lines(spark, d):
    from plait.operators import bonds

    return bonds.shown(A.layered_graph(spark, d))
