"""Registered queries that run array kernels, a bounded group at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plait import adapters as A
from plait.kernels import align as K
from plait.kernels import chain as C
from plait.kernels import partition as P
from plait.kernels import structure as T
from plait.operators import graph, matching
from plait.plans import progressive
from plait.queries import query
from plait.runtime import shared_dir, ship, table, unique


@query()
def pairwise_align_cigar(spark, d):
    """Neighbouring event sequences, whole: anchors, chain, gaps, CIGAR."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n1, n2, a, c in zip(*(b.column(i).to_pylist() for i in range(4))):
                aln, anchors, score = progressive.pairwise(a, c)
                rows.append((n1, n2, K.cigar(aln, a, c), K.rescore(aln, a, c, K.Scoring()), anchors, score, len(a), len(c)))
            cols = list(zip(*rows)) or [()] * 8
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["name1", "name2", "cigar", "score", "anchors", "chain_score", "n1", "n2"])

    pairs = A.neighbours(A.event_sequences(spark, d))
    return pairs.mapInArrow(run, "name1 long, name2 long, cigar string, score long, anchors long, chain_score double, n1 long, n2 long")


def _kernel_distance(spark, d, kernel) -> DataFrame:
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n1, n2, x, y = (b.column(i).to_pylist() for i in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(n1, pa.int64()), pa.array(n2, pa.int64()), pa.array([kernel(a, c) for a, c in zip(x, y)], pa.int64())], ["name1", "name2", "value"])

    return A.neighbours(A.event_sequences(spark, d)).mapInArrow(run, "name1 long, name2 long, value long")


@query(f"with {A.SQL_EVENT_SEQS} select a.name as name1, b.name as name2, -levenshtein(a.seq, b.seq)::bigint as value from eseqs a join eseqs b on b.name = a.name + 1")
def align_needleman_wunsch(spark, d):
    """With no gain for matches and unit costs the score is minus the edit distance."""
    return _kernel_distance(spark, d, lambda a, b: K.needleman_wunsch(a, b, K.Scoring(0, 1, (0,), (1,)))[0])


@query()
def align_edit_script(spark, d):
    return _kernel_distance(spark, d, lambda a, b: K.edit_script(a, b)[0])


@query()
def align_common_subsequence(spark, d):
    return _kernel_distance(spark, d, lambda a, b: sum(x is not None and y is not None for x, y in K.longest_common_subsequence(a, b)))


@query()
def align_wavefront(spark, d):
    return _kernel_distance(spark, d, lambda a, b: K.wavefront(K.chain(a), K.chain(b), K.Scoring(2, 3, (4,), (1,)), prune=50)[0])


@query()
def align_greedy_partial(spark, d):
    return _kernel_distance(spark, d, lambda a, b: K.greedy_partial(K.chain(a), K.chain(b), K.Scoring())[0])


_CHAIN = "a as (select l_orderkey as name, row_number() over (partition by l_orderkey order by " + ", ".join(A.LINE_ORDER) + """) as id,
  (l_partkey % 97)::bigint as b1, (l_partkey % 97 + l_quantity)::bigint as e1, (l_suppkey % 89)::bigint as b2, (l_suppkey % 89 + l_quantity)::bigint as e2, l_quantity::bigint as w from lineitem)"""


def _chain_sql(gap: str) -> str:
    return f"""with {_CHAIN}, c as (with recursive r(name, e1, e2, score) as (select name, e1, e2, w from a union all
    select r.name, a.e1, a.e2, r.score + a.w + {gap} from r join a on a.name = r.name and a.b1 >= r.e1 and a.b2 >= r.e2) select * from r)
  select name, max(score)::bigint as score from c group by name"""


def _chains(spark, d, kernel) -> DataFrame:
    """Anchors of each order's lines, as intervals on two sides, chained by ``kernel``."""
    ship(spark)
    b1, b2, n = F.col("l_partkey") % 97, F.col("l_suppkey") % 89, F.col("l_quantity").cast("long")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("name"), F.array(b1, b1 + n, b2, b2 + n, n).alias("a")).groupBy("name").agg(F.array_sort(F.collect_list("a")).alias("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [round(kernel([(x[0], x[1], x[2], x[3], float(x[4])) for x in a])[0]) for a in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.int64())], ["name", "score"])

    return rows.mapInArrow(run, "name long, score long")


@query(_chain_sql("0"))
def anchor_chain_exhaustive(spark, d):
    return _chains(spark, d, C.exhaustive)


@query(_chain_sql("0"))
def anchor_chain_sparse(spark, d):
    return _chains(spark, d, C.sparse)


@query(_chain_sql("case when a.b1 - r.e1 = a.b2 - r.e2 then 0 else greatest(-(2 + abs(a.b1 - r.e1 - a.b2 + r.e2)), -(20 + abs(a.b1 - r.e1 - a.b2 + r.e2) // 1000000)) end"))
def anchor_chain_affine(spark, d):
    return _chains(spark, d, lambda a: C.sparse_affine(a, (2, 20), (1, 0)))


_ITEMS = "x as (select l_orderkey as name, row_number() over (partition by l_orderkey order by " + ", ".join(A.LINE_ORDER) + ") as i, l_quantity::bigint as s, (l_partkey % 30)::bigint as gap from lineitem)"


def _partitions(spark, d, kernel) -> DataFrame:
    """Each order's lines as items that score their quantity, with losses between them."""
    ship(spark)
    row = F.struct(*A.LINE_ORDER)
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(F.array_sort(F.collect_list(row)).alias("x"))
    rows = rows.select("name", F.transform("x", lambda r: r["l_quantity"]).alias("s"), F.transform("x", lambda r: (r["l_partkey"] % 30).cast("double")).alias("gap"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            worth, parts = [], []
            for s, gap in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                items, between = [(float(int(v)), 10.0) for v in s], [(-g, 5.0) for g in gap[1:]]
                got = kernel(items, between)
                parts.append(len(got))
                worth.append(round(P.value(items, between, got, 20.0)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(worth, pa.int64()), pa.array(parts, pa.int64())], ["name", "score", "segments"])

    return rows.mapInArrow(run, "name long, score long, segments long")


@query(f"""with {_ITEMS}, dp as (with recursive r(name, i, closed, open) as (select name, 0::bigint, 0::bigint, -1000000::bigint from (select distinct name from x) union all
    select x.name, x.i, greatest(r.closed, greatest(r.open - case when x.i > 1 then x.gap else 0 end, r.closed) + x.s - 20), greatest(r.open - case when x.i > 1 then x.gap else 0 end, r.closed) + x.s
    from r join x on x.name = r.name and x.i = r.i + 1) select * from r)
  select name, max(closed)::bigint as score from dp group by name""")
def partition_max_weight(spark, d):
    return _partitions(spark, d, lambda x, y: P.maximum_weight(x, y, 20.0)).select("name", "score")


@query()
def partition_average(spark, d):
    return _partitions(spark, d, lambda x, y: P.average_constrained(x, y, 20.0, 1.0))


@query()
def partition_window(spark, d):
    return _partitions(spark, d, lambda x, y: P.window_average(x, y, 20.0, 1.0, 40.0))


def _mrm_sql(longest: int = 14) -> str:
    return f"""with {A.SQL_EVENT_SEQS}, s as (select name % 2 as side, name, substr(seq, i::int, k::int) as s, i from eseqs, unnest(range(1, {longest + 1})) t(k), unnest(range(1, length(seq) - k + 2)) u(i)),
  c as (select s, count(*) filter (where side = 0) as c1, count(*) filter (where side = 1) as c2 from s group by s having c1 > 0 and c2 > 0)
  select s as match, c1::bigint as count1, c2::bigint as count2 from c where c1 * c2 <= 6
    and not exists (select 1 from c p where p.s = substr(c.s, 1, length(c.s) - 1) and p.c1 = c.c1 and p.c2 = c.c2)
    and not exists (select 1 from c p where p.s = substr(c.s, 2) and p.c1 = c.c1 and p.c2 = c.c2)"""


@query(_mrm_sql())
def minimal_rare_matches(spark, d):
    """Between the event sequences of users of even and of odd number."""
    ship(spark)
    rows = A.event_steps(spark, d).select("path_id", "step", F.create_map(*[F.lit(x) for kv in A.EVENT_BASES.items() for x in kv])[F.col("node")].alias("label"))
    rows = rows.select("path_id", "step", (F.col("path_id") * 100000 + F.col("step")).alias("node_id"), "label")
    return matching.minimal_rare_matches(rows.where("path_id % 2 = 0"), rows.where("path_id % 2 = 1"), 6)


@query("""with s as (select l_partkey as set_id, round(sum(l_quantity), 2) as weight, (count(*) * count(distinct l_suppkey))::bigint as pairs from lineitem group by 1),
  o as (select *, row_number() over (order by weight desc, pairs, set_id) as k from s),
  r as (with recursive r(k, rest, set_id, took) as (select 0::bigint, 5000::bigint, null::bigint, false union all
    select o.k, case when o.pairs <= r.rest then r.rest - o.pairs else r.rest end, o.set_id, o.pairs <= r.rest from r join o on o.k = r.k + 1) select * from r)
  select o.set_id, o.weight, o.pairs from o join r on r.set_id = o.set_id where r.took""")
def match_budget_topk(spark, d):
    """Match sets in order of weight as long as their pairs fit a budget."""
    ship(spark)
    rows = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("set_id")).agg(F.round(F.sum("l_quantity"), 2).alias("weight"), (F.count("*") * F.count_distinct("l_suppkey")).alias("pairs"))
    return matching.within_budget(rows, 5000)


def _layered_arrays(spark, d) -> DataFrame:
    """The layered graph as one group of edges; its nodes are bounded by layers times lanes."""
    return A.layered_graph(spark, d).edges.withColumn("component", F.lit(0).cast("long"))


@query()
def dag_superbubbles(spark, d):
    """Superbubbles between a virtual source and sink, with the lengths of walks through them."""
    ship(spark)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*rows["src"], *rows["dst"]})
        at = {v: i + 1 for i, v in enumerate(names)}
        n = len(names)
        succ: list[list[int]] = [[] for _ in range(n + 2)]
        for a, b in zip(rows["src"], rows["dst"]):
            succ[at[a]].append(at[b])
        heads = {x for s in succ for x in s}
        succ[0] = [i for i in range(1, n + 1) if i not in heads]
        succ = [s or [n + 1] if 0 < i <= n else s for i, s in enumerate(succ)]
        pairs = T.superbubbles(succ)
        back = [-1, *names, -2]
        size = T.lengths(succ, pairs)
        return pd.DataFrame([(back[s], back[t], lo, hi, T.variant_class(lo, hi)) for (s, t), (lo, hi) in zip(pairs, size)], columns=["entrance", "exit", "shortest", "longest", "kind"])

    return _layered_arrays(spark, d).groupBy("component").applyInPandas(run, "entrance long, exit long, shortest long, longest long, kind string")


@query()
def edge_connectivity(spark, d):
    """Two- and three-edge-connected components of the trade graph of nations, and its bridges."""
    ship(spark)
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").select("o_orderkey", "c_nationkey")
    l = table(spark, d, "lineitem").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").select(F.col("l_orderkey").alias("o_orderkey"), "s_nationkey")
    e = o.join(l, "o_orderkey").groupBy(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).agg(F.count("*").alias("n")).withColumn("all", F.lit(1))

    def run(rows: pd.DataFrame) -> pd.DataFrame:  # nations squared, at most
        names = sorted({*rows["a"], *rows["b"]})
        at = {v: i for i, v in enumerate(names)}
        edges = [(at[a], at[b]) for a, b in zip(rows["a"], rows["b"])]
        cut = T.bridges(len(names), edges)
        bridge = {x for i in cut for x in edges[i]}
        two, three = T.two_edge_components(len(names), edges), T.three_edge_components(len(names), edges)
        return pd.DataFrame({"nation": names, "two": [names[x] for x in two], "three": [names[x] for x in three], "at_bridge": [i in bridge for i in range(len(names))]})

    return e.groupBy("all").applyInPandas(run, "nation long, two long, three long, at_bridge boolean")


_LINKS = "e as (select distinct least(a, b)::bigint as a, greatest(a, b)::bigint as b from (select n_nationkey as a, 100 + n_regionkey as b from nation where n_nationkey % 4 <> 1 union all select n_nationkey, n_nationkey * 7 % 25 from nation where n_nationkey % 3 = 1) where a <> b), n as (select a as x from e union select b from e)"


def _links(spark, d, kernel, schema: str) -> DataFrame:
    """``kernel(names, edges)`` over a small graph of nations and regions, in one task."""
    ship(spark)
    n = table(spark, d, "nation")
    key, region = F.col("n_nationkey").cast("long"), (F.lit(100) + F.col("n_regionkey")).cast("long")
    e = n.where("n_nationkey % 4 != 1").select(key.alias("a"), region.alias("b")).union(n.where("n_nationkey % 3 = 1").select(key, (F.col("n_nationkey") * 7 % 25).cast("long")))
    e = e.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("all", F.lit(1))
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:  # two edges a nation, at most
        names = sorted({*rows["a"], *rows["b"]})
        at = {v: i for i, v in enumerate(names)}
        return pd.DataFrame(kernel(names, [(at[a], at[b]) for a, b in sorted(zip(rows["a"], rows["b"]))]), columns=columns)

    return e.groupBy("all").applyInPandas(run, schema)


_CUT = f"""{_LINKS}, met as (with recursive r(a, b, x) as (select a, b, a from e union select r.a, r.b, case when f.a = r.x then f.b else f.a end from r join e f on (f.a = r.x or f.b = r.x) and not (f.a = r.a and f.b = r.b)) select * from r),
  cut as (select a, b from e where not exists (select 1 from met where met.a = e.a and met.b = e.b and met.x = e.b))"""


@query(f"with {_CUT} select a, b from cut")
def nation_bridges(spark, d):
    """Edges without which their ends are apart."""
    return _links(spark, d, lambda names, edges: [(names[edges[i][0]], names[edges[i][1]]) for i in T.bridges(len(names), edges)], "a long, b long")


@query(f"with {_CUT}, k as (select a, b from e except select a, b from cut), r as (with recursive r(n, m) as (select x, x from n union select case when k.a = r.n then k.b else k.a end, r.m from r join k on k.a = r.n or k.b = r.n) select * from r) select n as node_id, min(m) as component from r group by 1")
def nation_bridge_components(spark, d):
    """Two-edge-connected components."""
    return _links(spark, d, lambda names, edges: [(names[i], names[c]) for i, c in enumerate(T.two_edge_components(len(names), edges))], "node_id long, component long")


_APART = f"""{_LINKS}, two as (select x.a as a1, x.b as b1, y.a as a2, y.b as b2 from e x join e y on (x.a, x.b) <= (y.a, y.b)),
  met as (with recursive r(a1, b1, a2, b2, s, x) as (select two.*, n.x, n.x from two, n union select r.a1, r.b1, r.a2, r.b2, r.s, case when f.a = r.x then f.b else f.a end
    from r join e f on (f.a = r.x or f.b = r.x) and not (f.a = r.a1 and f.b = r.b1) and not (f.a = r.a2 and f.b = r.b2)) select * from r),
  k as (select s, x from met group by s, x having count(*) = (select count(*) from two))"""


@query(f"with {_APART} select s as node_id, min(x) as component from k group by 1")
def nation_three_edge_components(spark, d):
    """Nodes that no cut of one or two edges parts."""
    return _links(spark, d, lambda names, edges: [(names[i], names[c]) for i, c in enumerate(T.three_edge_components(len(names), edges))], "node_id long, component long")


@query()
def msa_progressive(spark, d):
    """Event sequences of each ten users, joined into one graph along an in-order tree."""
    ship(spark)
    s = A.event_sequences(spark, d).withColumn("grp", F.expr("name div 10"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:  # ten sequences
        seqs = {str(n): s for n, s in sorted(zip(rows["name"], rows["seq"]))}
        g = progressive.align(seqs)
        ok = all(g.spelled(n) == s for n, s in seqs.items())
        return pd.DataFrame([(int(rows["grp"].iloc[0]), len(seqs), sum(map(len, seqs.values())), len(g.labels), len(g.edges), ok)], columns=["grp", "sequences", "bases", "nodes", "edges", "spelled"])

    return s.groupBy("grp").applyInPandas(run, "grp long, sequences long, bases long, nodes long, edges long, spelled boolean")


@query(f"with {A.SQL_EVENT_SEQS} select name // 10 as grp, count(*)::bigint as sequences, sum(length(seq))::bigint as bases, true as spelled from eseqs group by 1")
def msa_spells_sequences(spark, d):
    """Every path of every graph of :func:`msa_progressive` spells its sequence."""
    return msa_progressive(spark, d).select("grp", "sequences", "bases", "spelled")


def _per_ten(spark, d, kernel, schema: str) -> DataFrame:
    """``kernel(group, {name: sequence})`` → rows, over the event sequences of each ten users."""
    ship(spark)
    s = A.event_sequences(spark, d).withColumn("grp", F.expr("name div 10"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:  # ten sequences
        return pd.DataFrame(kernel(int(rows["grp"].iloc[0]), {str(n): s for n, s in sorted(zip(rows["name"], rows["seq"]))}), columns=names)

    return s.groupBy("grp").applyInPandas(run, schema)


@query()
def variant_matrix(spark, d):
    """Alleles of every path at the innermost superbubbles of each group's alignment."""
    from plait.tools.variants import variant_matrix as matrix

    def kernel(grp, seqs):
        return [(grp, s, t, kind, name, allele) for s, t, kind, by in matrix(progressive.align(seqs)) for name, allele in by.items()]

    return _per_ten(spark, d, kernel, "grp long, entrance long, exit long, kind string, path string, allele string")


@query()
def universal_bridges(spark, d):
    from plait.tools.variants import universal_bridges as bridges

    def kernel(grp, seqs):
        return [(grp, a, b, name, lo, hi) for a, b, at in bridges(progressive.align(seqs)) for name, (lo, hi) in at.items()]

    return _per_ten(spark, d, kernel, "grp long, src long, dst long, path string, first long, last long")


@query(f"with {A.SQL_EVENT_SEQS} select name // 10 as grp, count(*)::bigint as kept, sum(length(seq))::bigint as bases from eseqs where substr(seq, 1, 1) <> 'C' group by 1")
def remove_samples(spark, d):
    """Each group's graph without the paths that begin with an error; the others spell what they did."""
    from plait.operators.trees import in_order
    from plait.sources import newick
    from plait.tools.variants import without_samples

    def kernel(grp, seqs):
        g, _ = without_samples(progressive.align(seqs), newick.parse(in_order(list(seqs))), {n for n, s in seqs.items() if s[0] == "C"})
        return [(grp, len(g.paths), sum(len(g.spelled(n)) if g.spelled(n) == seqs[n] else 0 for n in g.paths))]

    return _per_ten(spark, d, kernel, "grp long, kept long, bases long")


@query()
def simulate_and_compare(spark, d):
    """Repeat arrays evolved down the tree of each nation's suppliers, neighbours aligned and held against
    the truth."""
    from plait.operators.trees import in_order
    from plait.sources import newick
    from plait.tools import simulate as sim

    ship(spark)
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("name"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:  # a nation's suppliers share one root
        import numpy as np

        nation, names = int(rows["nation"].iloc[0]), sorted(map(str, rows["name"]))
        root = sim.repeat_array(np.random.default_rng(nation), 12, 2, 5)
        leaves = sim.simulate(newick.parse(in_order(names)), root, monomer=12, monomers=2, seed=nation)
        out = []
        for a, b in zip(names, names[1:]):
            (x, ox), (y, oy) = leaves[a], leaves[b]
            m = sim.compare(progressive.pairwise(x, y)[0], ox, oy)
            out.append((nation, a, b, m["match_rate"], m["completeness"], m["accuracy"]))
        return pd.DataFrame(out, columns=["nation", "a", "b", "match_rate", "completeness", "accuracy"])

    return s.groupBy("nation").applyInPandas(run, "nation long, a string, b string, match_rate double, completeness double, accuracy double")


@query()
def induced_cyclic_pairwise(spark, d):
    """Colinear blocks of neighbouring users' walks through the cyclic graph of event types and days."""
    from plait.kernels.cyclic import blocks

    ship(spark)
    node = F.concat_ws("@", "event_type", F.date_format("ts", "yyyy-MM-dd-HH"))
    walk = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", node.alias("n")))), lambda x: x["n"])
    w = table(spark, d, "events").groupBy(F.col("user_id").alias("name")).agg(walk.alias("seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(x, y, k, blk[0][0], blk[0][1], len(blk)) for x, y, p, q in zip(*(b.column(i).to_pylist() for i in range(4))) for k, blk in enumerate(blocks(p, q))]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["name1", "name2", "block", "begin1", "begin2", "columns"])

    return A.neighbours(w).mapInArrow(run, "name1 long, name2 long, block long, begin1 long, begin2 long, columns long")


@query(f"with {A.SQL_EVENT_SEQS}, s as (select name, i - 1 as pos, substr(seq, i::int) as suffix from (select name, seq, unnest(range(1, length(seq) + 1)) as i from eseqs)) select name, pos as start, row_number() over (partition by name order by suffix) - 1 as rank from s")
def suffix_arrays(spark, d):
    from plait.kernels.strings import suffix_array

    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(n, int(i), r) for n, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r, i in enumerate(suffix_array([ord(c) for c in s]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), ()))], ["name", "start", "rank"])

    return A.event_sequences(spark, d).mapInArrow(run, "name long, start long, rank long")


@query(f"with {A.SQL_EVENT_SEQS} select (name // 10)::varchar as job, count(*)::int as sequences, sum(length(seq))::bigint as bases from eseqs group by 1")
def executor_run(spark, d):
    """The executor over jobs of ten users, every other one first, and then a restart with all."""
    from plait.plans import executor

    jobs = executor.jobs_of(A.event_sequences(spark, d).select(F.expr("name div 10").alias("job"), F.col("name").cast("string").alias("name"), "seq"))
    path = f"{shared_dir(spark).rstrip('/')}/plait/subproblems-{unique()}"
    executor.run_to(jobs.where("job % 2 = 0"), path)
    done = executor.run_to(jobs, path)
    return done.select("job", F.size("names").alias("sequences"), F.aggregate("paths", F.lit(0).cast("long"), lambda a, p: a + F.size(p)).alias("bases"))


@query()
def graph_snarls(spark, d):
    """Chains of snarls of each group's alignment, with the lengths of walks through them."""

    def kernel(grp, seqs):
        g = progressive.align(seqs)
        edges = sorted(g.edges)
        return [(grp, c, k, s, t, *T.snarl_lengths(len(g.labels), edges, (s, t))) for c, chain in enumerate(T.snarls(len(g.labels), edges)) for k, (s, t) in enumerate(chain)]

    return _per_ten(spark, d, kernel, "grp long, chain long, place long, start long, end long, shortest long, longest long")


@query(f"""with {A.SQL_EVENT_SEQS} select a.name // 10 as grp, a.name::varchar as path1, b.name::varchar as path2, length(a.seq)::bigint as n1, length(b.seq)::bigint as n2
  from eseqs a join eseqs b on b.name // 10 = a.name // 10 and a.name < b.name""")
def all_pairs_consumed(spark, d):
    """What the CIGAR of every pair of paths in each group's graph consumes on either side."""
    return all_pairs_cigar(spark, d).select("grp", "path1", "path2", "n1", "n2")


@query()
def all_pairs_cigar(spark, d):
    """Alignments that shared nodes imply for all pairs of paths of each group's graph."""
    from plait.kernels.cyclic import close_short_gaps

    def kernel(grp, seqs):
        g, out = progressive.align(seqs), []
        names = list(g.paths)
        for i, a in enumerate(names):
            at = {v: k for k, v in enumerate(g.paths[a])}
            for b in names[i + 1 :]:
                shared = [(at[v], k) for k, v in enumerate(g.paths[b]) if v in at]
                aln = close_short_gaps(K.with_gaps(shared, len(g.paths[a]), len(g.paths[b])))
                out.append((grp, a, b, K.cigar(aln, seqs[a], seqs[b]), sum(x is not None for x, _ in aln), sum(y is not None for _, y in aln)))
        return out

    return _per_ten(spark, d, kernel, "grp long, path1 string, path2 string, cigar string, n1 long, n2 long")


_PLACES = """places as (select l_partkey as set_id, l_linenumber % 2 as side, l_returnflag as path, l_suppkey * 10 as b, l_suppkey * 10 + l_quantity::bigint as e from lineitem),
  regions as (select n_nationkey as region, f as path, n_nationkey * 37 as b2, n_nationkey * 37 + 25 as e2 from nation cross join (values ('A'), ('N'), ('R')) t(f))"""


@query(f"with {_PLACES} select region, set_id, side, count(*)::bigint as count, max(least(e, e2) - greatest(b, b2))::bigint as length from places join regions on regions.path = places.path and b < e2 and b2 < e group by all")
def induced_matches(spark, d):
    l = table(spark, d, "lineitem")
    begin = F.col("l_suppkey") * 10
    places = l.select(F.col("l_partkey").alias("set_id"), (F.col("l_linenumber") % 2).alias("side"), F.col("l_returnflag").alias("path"), begin.alias("begin"), (begin + F.col("l_quantity").cast("long")).alias("end"))
    at = F.col("n_nationkey").cast("long") * 37
    regions = table(spark, d, "nation").select(F.col("n_nationkey").alias("region"), F.explode(F.array(*map(F.lit, "ANR"))).alias("path"), at.alias("begin2"), (at + 25).alias("end2"))
    return matching.induced_matches(places, regions, 64)
