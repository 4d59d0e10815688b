"""Graph operators on node, edge and step tables, in DataFrame operations.

``nodes`` is (node_id, label), ``edges`` (src, dst), ``steps`` (path_id, step, node_id). A graph of up to
``ONE_GROUP`` rows is one bounded group for what goes layer by layer: an array kernel does it in one
task. A larger one is gone through on the driver, a layer a round; a round writes its own layer only and
reads the earlier layers that have edges into it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plait.kernels import dag
from plait.model import PathGraph
from plait.operators.components import connected_components
from plait.runtime import shared_dir, ship

#: Rows of nodes, edges and steps up to which a graph is one group.
ONE_GROUP = 2_000_000


class CycleError(ValueError):
    """A graph that should have no cycle has one."""


def _fits(*tables: DataFrame) -> bool:
    left = ONE_GROUP
    for t in tables:
        left -= t.limit(left + 1).count()
        if left < 0:
            return False
    return True


def _in_one_task(parts: list[DataFrame], kernel: Callable, schema: str) -> DataFrame:
    """``kernel`` of one array of shape (rows, columns) of longs for each part (-1 for null), whose rows it
    is given whole in one task; its columns as a table."""
    spark = parts[0].sparkSession
    ship(spark)
    width = max(len(p.columns) for p in parts)
    names = [c.split()[0] for c in schema.split(", ")]
    rows = None
    for i, p in enumerate(parts):
        one = p.select(F.lit(i).cast("long").alias("part"), *(F.coalesce(F.col(c).cast("long"), F.lit(-1).cast("long")).alias(f"c{k}") for k, c in enumerate(p.columns)), *(F.lit(-1).cast("long").alias(f"c{k}") for k in range(len(p.columns), width)))
        rows = one if rows is None else rows.union(one)
    sizes = [len(p.columns) for p in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1) for b in batches if b.num_rows]
        every = np.concatenate(held) if held else np.empty((0, width + 1), dtype=np.int64)
        cols = kernel(*(every[every[:, 0] == i][:, 1 : 1 + n] for i, n in enumerate(sizes)))
        for at in range(0, len(cols[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000], pa.int64()) for c in cols], names)

    return rows.repartition(1).mapInArrow(run, schema)


def _indexed(nodes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, src, dst): edges by place in the sorted names."""
    names = np.unique(np.concatenate((nodes.ravel(), edges.ravel())))
    return names, np.searchsorted(names, edges[:, 0]), np.searchsorted(names, edges[:, 1])


def leaf_graph(sequences: DataFrame, name: str = "name", seq: str = "seq") -> PathGraph:
    """One node per base and one path per sequence; node ids number the bases of all sequences in
    order of name, by prefix sums over the sequences' lengths."""
    w = Window.orderBy("path_id").rowsBetween(Window.unboundedPreceding, -1)
    # a row per sequence is all that the single-partition window sees
    starts = sequences.select(F.col(name).alias("path_id"), F.length(seq).cast("long").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0)))
    bases = sequences.select(F.col(name).alias("path_id"), F.posexplode(F.split(F.upper(seq), "")).alias("step", "label")).where("label != ''")
    placed = bases.join(starts, "path_id").select("path_id", F.col("step").cast("long").alias("step"), (F.col("first") + F.col("step")).alias("node_id"), "label")
    edges = placed.where("step > 0").select((F.col("node_id") - 1).alias("src"), F.col("node_id").alias("dst"))
    return PathGraph(placed.select("node_id", "label"), edges, placed.select("path_id", "step", "node_id"))


def path_edges(steps: DataFrame, multiplicity: bool = False) -> DataFrame:
    """(src, dst) between successive steps; with ``multiplicity``, how often each is walked."""
    w = Window.partitionBy("path_id").orderBy("step")
    e = steps.select(F.col("node_id").alias("src"), F.lead("node_id").over(w).alias("dst")).where("dst is not null")
    return e.groupBy("src", "dst").agg(F.count("*").alias("walks")) if multiplicity else e.distinct()


def make_simple(edges: DataFrame) -> DataFrame:
    """Edges without repeats."""
    return edges.select("src", "dst").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, in_degree, out_degree) of every node, in one shuffle of the edge ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    own = nodes.select("node_id", F.lit(0).alias("i"), F.lit(0).alias("o"))
    return own.union(ends.select("x.*")).groupBy("node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def sentinel_edges(nodes: DataFrame, edges: DataFrame, steps: DataFrame, source: int = -1, sink: int = -2) -> DataFrame:
    """(src, dst) edges of a virtual source to all path starts and nodes without predecessor, and from
    all path ends and nodes without successor to a virtual sink."""
    d = degrees(nodes, edges)
    ends = steps.groupBy("path_id").agg(F.min_by("node_id", "step").alias("first"), F.max_by("node_id", "step").alias("last"))
    into = d.where("in_degree = 0").select(F.lit(source).cast("long").alias("src"), F.col("node_id").alias("dst")).union(ends.select(F.lit(source).cast("long"), "first"))
    out = d.where("out_degree = 0").select(F.col("node_id").alias("src"), F.lit(sink).cast("long").alias("dst")).union(ends.select("last", F.lit(sink).cast("long")))
    return into.union(out).distinct()


def append(a: PathGraph, b: PathGraph) -> PathGraph:
    """The disjoint union: b's node ids move behind a's largest."""
    shift = a.nodes.agg((F.coalesce(F.max("node_id"), F.lit(-1)) + 1).alias("shift"))
    move = lambda df, *cols: df.crossJoin(F.broadcast(shift)).select(*[(F.col(c) + F.col("shift")).alias(c) if c in cols else F.col(c) for c in df.columns])  # noqa: E731  one row
    return PathGraph(a.nodes.unionByName(move(b.nodes, "node_id")), a.edges.unionByName(move(b.edges, "src", "dst")), a.steps.unionByName(move(b.steps, "node_id")))


def purge_uncovered(g: PathGraph) -> PathGraph:
    """Only nodes that a path covers, and the edges between them."""
    covered = g.steps.select("node_id").distinct()
    edges = g.edges.join(covered.select(F.col("node_id").alias("src")), "src", "left_semi").join(covered.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return PathGraph(g.nodes.join(covered, "node_id", "left_semi"), edges.select("src", "dst"), g.steps)


def step_index(steps: DataFrame) -> DataFrame:
    """(node_id, path_id, step, visit): where each node stands on each path, visits numbered from 1."""
    w = Window.partitionBy("node_id", "path_id").orderBy("step")
    return steps.select("node_id", "path_id", "step", F.row_number().over(w).alias("visit"))


def unipaths(nodes: DataFrame, edges: DataFrame, steps: DataFrame) -> DataFrame:
    """(node_id, unipath, place): maximal non-branching runs, named by their first node. A node joins its
    predecessor if that is its only one and has no other successor; runs are contracted by pointer
    doubling, so a run of length n takes log2(n) joins. Nodes of a branchless cycle stand alone."""
    d = degrees(nodes, edges)
    simple = make_simple(edges)
    inner = simple.join(d.where("out_degree = 1").select(F.col("node_id").alias("src")), "src", "left_semi").join(d.where("in_degree = 1").select(F.col("node_id").alias("dst")), "dst", "left_semi")
    starts = steps.groupBy("path_id").agg(F.min_by("node_id", "step").alias("dst")).select("dst").distinct()
    ends = steps.groupBy("path_id").agg(F.max_by("node_id", "step").alias("src")).select("src").distinct()
    inner = inner.where("src != dst").join(starts, "dst", "left_anti").join(ends, "src", "left_anti")
    shared_dir(nodes.sparkSession)
    jump = nodes.select("node_id").join(inner.select(F.col("dst").alias("node_id"), F.col("src").alias("up")), "node_id", "left")
    jump = jump.select("node_id", F.coalesce("up", "node_id").alias("up"), F.col("up").isNotNull().cast("long").alias("far")).checkpoint()
    for _ in range(64):
        target = jump.select(F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("far").alias("more"))
        after = jump.join(target, "up").select("node_id", F.col("next").alias("up"), (F.col("far") + F.col("more")).alias("far"), (F.col("more") > 0).alias("moved")).checkpoint()
        jump = after.drop("moved")
        if not after.where("moved").limit(1).count():
            return jump.select("node_id", F.col("up").alias("unipath"), F.col("far").alias("place"))
    # only a cycle goes on without end
    return jump.select("node_id", F.col("node_id").alias("unipath"), F.lit(0).cast("long").alias("place"))


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, layer): the longest walk to each node, a topological order by layers. A cycle is a
    :class:`CycleError`."""
    shared_dir(nodes.sparkSession)
    simple = make_simple(edges).checkpoint()
    if _fits(nodes, simple):

        def kernel(v: np.ndarray, e: np.ndarray) -> tuple:
            names, src, dst = _indexed(v, e)
            return names, dag.layers_of(len(names), src, dst)

        out = _in_one_task([nodes.select("node_id"), simple], kernel, "node_id long, layer long").checkpoint()
        if out.where("layer < 0").limit(1).count():
            raise CycleError("the graph has a cycle")
        return out.join(nodes.select("node_id"), "node_id", "left_semi")
    left, n, taken = simple, simple.count(), []
    while n:
        tops = left.select("src").distinct().join(left.select(F.col("dst").alias("src")), "src", "left_anti")
        marked = left.join(tops.withColumn("top", F.lit(True)), "src", "left").checkpoint()
        # a node lies one below the last layer that an edge into it leaves
        taken.append(marked.where("top").select(F.col("dst").alias("node_id"), F.lit(len(taken) + 1).cast("long").alias("layer")))
        left = marked.where("top is null").select("src", "dst")
        rest = left.count()
        if rest == n:
            raise CycleError("the graph has a cycle")
        n = rest
    out = nodes.select("node_id", F.lit(0).cast("long").alias("layer"))
    for t in taken:
        out = out.union(t)
    return out.groupBy("node_id").agg(F.max("layer").alias("layer")).checkpoint()


def is_acyclic(nodes: DataFrame, edges: DataFrame) -> bool:
    try:
        layers(nodes, edges)
    except CycleError:
        return False
    return True


def topological_order(nodes: DataFrame, edges: DataFrame, layered: DataFrame | None = None) -> DataFrame:
    """(node_id, place): a total order that all edges follow, by layer and id. Places are offsets of layers,
    from a row a layer, plus ranks within the layer."""
    layered = layers(nodes, edges) if layered is None else layered
    before = Window.orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    first = layered.groupBy("layer").agg(F.count("*").alias("n")).select("layer", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("layer").orderBy("node_id"))
    return layered.withColumn("rank", rank).join(first, "layer").select("node_id", (F.col("first") + F.col("rank") - 1).alias("place"))


def _sweep(edges: DataFrame, layered: DataFrame, start: DataFrame | None, own: DataFrame | None, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """States of nodes, a layer a round: ``fold`` takes the states of a layer's predecessors, by edge (src,
    node_id and the state's columns), to the layer's, which ``own`` joins; the first layer has ``start``, or
    else its own. A round writes its own layer; what all rounds read is written before them, so that none
    goes back to what it was made of."""
    shared_dir(layered.sparkSession)
    layered = layered.checkpoint()
    if own is not None:
        own = own.join(layered, "node_id").checkpoint()
    mine = lambda k: own.where(F.col("layer") == k).drop("layer")
    at = lambda c: layered.select(F.col("node_id").alias(c), F.col("layer").alias(f"{c}_layer"))
    placed = edges.join(at("src"), "src").join(at("dst"), "dst").checkpoint()
    ahead: dict[int, list[int]] = {}
    for a, b in placed.select("src_layer", "dst_layer").distinct().collect():  # pairs of layers
        ahead.setdefault(b, []).append(a)
    done = {0: (mine(0) if start is None else start).checkpoint()}
    for k in sorted(ahead):
        before = None
        for a in ahead[k]:
            before = done[a] if before is None else before.union(done[a])
        step = placed.where(F.col("dst_layer") == k).select("src", F.col("dst").alias("to")).join(before.withColumnRenamed("node_id", "src"), "src")
        states = fold(step.withColumnRenamed("to", "node_id"))
        if own is not None:
            states = fold(states.withColumn("src", F.lit(None).cast("long")).unionByName(mine(k).withColumn("src", F.lit(None).cast("long")), allowMissingColumns=True))
        done[k] = states.checkpoint()
    out = None
    for d in done.values():
        out = d if out is None else out.union(d)
    return out


def minmax_distance(nodes: DataFrame, edges: DataFrame, layered: DataFrame | None = None) -> DataFrame:
    """(node_id, min_distance, max_distance): the shortest and longest walks from sources, in edges."""
    simple = make_simple(edges)
    if layered is None and _fits(nodes, simple):

        def kernel(v: np.ndarray, e: np.ndarray) -> tuple:
            names, src, dst = _indexed(v, e)
            layer = dag.layers_of(len(names), src, dst)
            if (layer < 0).any():
                raise CycleError("the graph has a cycle")
            return names, *dag.distances(layer, src, dst)

        return _in_one_task([nodes.select("node_id"), simple], kernel, "node_id long, min_distance long, max_distance long")
    layered = layers(nodes, edges) if layered is None else layered
    zero = F.lit(0).cast("long")
    start = layered.where("layer = 0").select("node_id", zero.alias("min_distance"), zero.alias("max_distance"))
    return _sweep(simple, layered, start, None, lambda s: s.groupBy("node_id").agg(F.min(F.col("min_distance") + 1).alias("min_distance"), F.max(F.col("max_distance") + 1).alias("max_distance")))


def count_walks(nodes: DataFrame, edges: DataFrame, layered: DataFrame | None = None) -> DataFrame:
    """(node_id, walks): walks from any source, saturating at the largest long."""
    simple = make_simple(edges)
    if layered is None and _fits(nodes, simple):

        def kernel(v: np.ndarray, e: np.ndarray) -> tuple:
            names, src, dst = _indexed(v, e)
            layer = dag.layers_of(len(names), src, dst)
            if (layer < 0).any():
                raise CycleError("the graph has a cycle")
            return names, dag.walks(layer, src, dst)

        return _in_one_task([nodes.select("node_id"), simple], kernel, "node_id long, walks long")
    layered = layers(nodes, edges) if layered is None else layered
    total = F.least(F.sum(F.col("walks").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    start = layered.where("layer = 0").select("node_id", F.lit(1).cast("long").alias("walks"))
    return _sweep(simple, layered, start, None, lambda s: s.groupBy("node_id").agg(total.alias("walks")))


def _on_paths(own: DataFrame, simple: DataFrame, nodes: DataFrame, kernel: Callable, columns: list[str]) -> DataFrame | None:
    """(node_id, path_id, columns) from the last own steps of nodes on paths, if the graph is one bounded group,
    else None. ``kernel`` takes layers, edges and own steps, of shape (nodes, paths) and -1 for none, to an
    array a column, the first with -1 where there is no row."""
    paths = own.select("path_id").distinct().limit(1001).collect()
    if not 0 < len(paths) <= 1000 or not _fits(own, simple) or nodes.count() * len(paths) > 20 * ONE_GROUP:
        return None
    names = [r.path_id for r in paths]  # a thousand at most
    kind = own.schema["path_id"].dataType.simpleString()
    number = F.create_map(*(F.lit(x).cast(kind if i % 2 == 0 else "long") for p in enumerate(names) for i, x in enumerate((p[1], p[0]))))

    def run(o: np.ndarray, e: np.ndarray) -> tuple:
        every, src, dst = _indexed(o[:, 0], e)
        layer = dag.layers_of(len(every), src, dst)
        if (layer < 0).any():
            raise CycleError("the graph has a cycle")
        held = np.full((len(every), max(1, o[:, 1].max(initial=0) + 1)), -1, dtype=np.int64)
        held[np.searchsorted(every, o[:, 0]), o[:, 1]] = o[:, 2]
        got = kernel(layer, src, dst, held)
        at, path = np.nonzero(got[0] >= 0)
        return every[at], path, *(x[at, path] for x in got)

    found = _in_one_task([own.select("node_id", number[F.col("path_id")].alias("path"), "last_step"), simple], run, ", ".join(f"{c} long" for c in ("node_id", "path", *columns)))
    back = F.array(*(F.lit(x).cast(kind) for x in names))
    return found.select("node_id", F.element_at(back, (F.col("path") + 1).cast("int")).alias("path_id"), *columns)


def reach(steps: DataFrame, edges: DataFrame, layered: DataFrame | None = None) -> DataFrame:
    """(node_id, path_id, last_step): for each node and path the last step of the path from which the node
    can be reached, its own included. ``a`` on a path at step s reaches ``b`` if s <= last_step."""
    shared_dir(steps.sparkSession)
    own = steps.groupBy("node_id", "path_id").agg(F.max("step").alias("last_step"))
    simple = make_simple(edges)
    nodes = steps.select("node_id").union(simple.select("src")).union(simple.select("dst")).distinct()
    if layered is None:
        found = _on_paths(own, simple, nodes, lambda layer, src, dst, held: [dag.last_steps(layer, src, dst, held)], ["last_step"])
        if found is not None:
            return found
    layered = layers(nodes, edges) if layered is None else layered
    return _sweep(simple, layered, None, own, lambda s: s.groupBy("node_id", "path_id").agg(F.max("last_step").alias("last_step")))


def reachable(pairs: DataFrame, reached: DataFrame, steps: DataFrame) -> DataFrame:
    """(a, b, reachable) of pairs of nodes on paths, from :func:`reach`: an equality on the path, and a step
    of ``a`` no later than the last one that reaches ``b``."""
    first = steps.groupBy("node_id", "path_id").agg(F.min("step").alias("step"))
    on = pairs.select("a", "b").distinct().join(first.withColumnRenamed("node_id", "a"), "a").join(reached.withColumnRenamed("node_id", "b"), ["b", "path_id"])
    held = on.where("step <= last_step").select("a", "b").distinct().withColumn("reachable", F.lit(True))
    return pairs.select("a", "b").join(held, ["a", "b"], "left").select("a", "b", F.coalesce("reachable", F.lit(False)).alias("reachable"))


def chain_cover(nodes: DataFrame, edges: DataFrame, steps: DataFrame) -> DataFrame:
    """(path_id, step, node_id) of a cover by chains without common nodes: the maximal runs, named by
    their first nodes."""
    return unipaths(nodes, edges, steps).select(F.col("unipath").alias("path_id"), F.col("place").alias("step"), "node_id")


def forward_edges(reached: DataFrame, steps: DataFrame) -> DataFrame:
    """(node_id, path_id, from_node): the last node of each path that reaches a node, from :func:`reach`."""
    at = steps.select("path_id", F.col("step").alias("last_step"), F.col("node_id").alias("from_node"))
    return reached.join(at, ["path_id", "last_step"]).select("node_id", "path_id", "from_node")


def masked_forward_edges(forward: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Those forward edges that lead from an end of a match to a start of one (node_id)."""
    return forward.join(starts.select("node_id"), "node_id", "left_semi").join(ends.select(F.col("node_id").alias("from_node")), "from_node", "left_semi").select("node_id", "path_id", "from_node")


def post_switch_distances(steps: DataFrame, edges: DataFrame, layered: DataFrame | None = None) -> DataFrame:
    """(node_id, path_id, last_step, distance): the least number of edges walked from the last step of each
    path that reaches a node; zero on the path. Steps of a null path take no part."""
    shared_dir(steps.sparkSession)
    steps = steps.where("path_id is not null")
    own = steps.groupBy("node_id", "path_id").agg(F.max("step").alias("last_step"))
    simple = make_simple(edges)
    nodes = steps.select("node_id").union(simple.select("src")).union(simple.select("dst")).distinct()
    if layered is None:

        def kernel(layer: np.ndarray, src: np.ndarray, dst: np.ndarray, held: np.ndarray) -> list[np.ndarray]:
            last = dag.last_steps(layer, src, dst, held)
            return [last, dag.switch_distances(layer, src, dst, held, last)]

        found = _on_paths(own, simple, nodes, kernel, ["last_step", "distance"])
        if found is not None:
            return found
    layered = layers(nodes, edges) if layered is None else layered
    own = own.withColumn("distance", F.lit(0).cast("long"))

    def fold(s: DataFrame) -> DataFrame:
        # a state that came along an edge has walked it
        here = F.col("distance") + F.col("src").isNotNull().cast("long")
        best = F.min(F.struct((-F.col("last_step")).alias("late"), here.alias("distance")))
        return s.groupBy("node_id", "path_id").agg(best.alias("x")).select("node_id", "path_id", (-F.col("x.late")).alias("last_step"), F.col("x.distance").alias("distance"))

    return _sweep(simple, layered, None, own, fold)


def target_reachability(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(node_id, hops): every node that reaches one of ``targets`` (node_id), with its least number of edges."""
    return shortest_paths(reverse(edges), targets)


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node_id, hops): every node that ``sources`` (node_id) reach, with its least number of edges."""
    shared_dir(edges.sparkSession)
    arcs = make_simple(edges).checkpoint()
    if _fits(arcs, sources):

        def kernel(e: np.ndarray, s: np.ndarray) -> tuple:
            names, src, dst = _indexed(s, e)
            hops = dag.breadth_first(len(names), src, dst, np.searchsorted(names, s[:, 0]))
            return names[hops >= 0], hops[hops >= 0]

        return _in_one_task([arcs, sources.select("node_id")], kernel, "node_id long, hops long")
    front = sources.select("node_id").distinct().checkpoint()
    out, hops = [front.withColumn("hops", F.lit(0).cast("long"))], 0
    while front.limit(1).count():
        known = out[0]
        for o in out[1:]:
            known = known.union(o)
        if len(out) > 16:
            out = [known := known.checkpoint()]
        hops += 1
        front = front.join(arcs.withColumnRenamed("src", "node_id"), "node_id").select(F.col("dst").alias("node_id")).distinct().join(known, "node_id", "left_anti").checkpoint()
        out.append(front.withColumn("hops", F.lit(hops).cast("long")))
    known = out[0]
    for o in out[1:]:
        known = known.union(o)
    return known


def shortest_walk(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(step, node_id) of one walk of fewest nodes from ``sources`` to ``targets`` (node_id): of all such
    walks, the one whose nodes have the smallest ids, from the end backwards. Empty if there is none."""
    hops = shortest_paths(edges, sources)
    ends = hops.join(targets.select("node_id"), "node_id", "left_semi")
    on = make_simple(edges).join(hops.select(F.col("node_id").alias("src"), F.col("hops").alias("h")), "src").join(hops.select(F.col("node_id").alias("dst"), F.col("hops").alias("k")), "dst")
    back = on.where("k = h + 1").groupBy(F.col("dst").alias("node_id")).agg(F.min("src").alias("before")).checkpoint()
    last = ends.agg(F.min(F.struct("hops", "node_id")).alias("x")).select("x.hops", "x.node_id").where("hops is not null").collect()  # one row
    if not last:
        return hops.limit(0).select(F.col("hops").alias("step"), "node_id")
    up, span = back, 1
    walk = edges.sparkSession.createDataFrame([(last[0].hops, last[0].node_id)], "step long, node_id long").checkpoint()
    while span <= last[0].hops:  # ways back of doubled length
        walk = walk.union(walk.join(up, "node_id").select((F.col("step") - span).alias("step"), F.col("before").alias("node_id"))).checkpoint()
        up = up.join(up.select(F.col("node_id").alias("before"), F.col("before").alias("further")), "before").select("node_id", F.col("further").alias("before")).checkpoint()
        span *= 2
    return walk


def connecting_nodes(edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """(node_id) strictly between ``sources`` and ``sinks``: reached from the one and reaching the other."""
    ends = sources.select("node_id").union(sinks.select("node_id"))
    ahead = shortest_paths(edges, sources).select("node_id")
    return ahead.join(target_reachability(edges, sinks).select("node_id"), "node_id", "left_semi").join(ends, "node_id", "left_anti")


def induced(g: PathGraph, keep: DataFrame) -> PathGraph:
    """The subgraph on ``keep`` (node_id); steps outside are dropped, so a path may fall apart."""
    edges = g.edges.join(keep.select(F.col("node_id").alias("src")), "src", "left_semi").join(keep.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return PathGraph(g.nodes.join(keep, "node_id", "left_semi"), edges.select("src", "dst"), g.steps.join(keep, "node_id", "left_semi"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def connecting_graph(g: PathGraph, sources: DataFrame, sinks: DataFrame) -> PathGraph:
    """The subgraph strictly between ``sources`` and ``sinks``."""
    return induced(g, connecting_nodes(g.edges, sources, sinks))


def extending_nodes(edges: DataFrame, start: DataFrame, forward: bool = True) -> DataFrame:
    """(node_id) of all that ``start`` (node_id) reaches, or is reached from, without itself."""
    met = shortest_paths(edges, start) if forward else target_reachability(edges, start)
    return met.select("node_id").join(start.select("node_id"), "node_id", "left_anti")


def with_nodes(g: PathGraph, nodes: DataFrame) -> PathGraph:
    """With further nodes (node_id, label); ids that are there already are an error of the caller."""
    return PathGraph(g.nodes.unionByName(nodes.select("node_id", "label")), g.edges, g.steps)


def without_nodes(g: PathGraph, nodes: DataFrame) -> PathGraph:
    """Without nodes (node_id), their edges and their steps; later steps keep their numbers."""
    gone = nodes.select("node_id").distinct()
    edges = g.edges.join(gone.withColumnRenamed("node_id", "src"), "src", "left_anti").join(gone.withColumnRenamed("node_id", "dst"), "dst", "left_anti")
    return PathGraph(g.nodes.join(gone, "node_id", "left_anti"), edges.select("src", "dst"), g.steps.join(gone, "node_id", "left_anti"))


def relabelled(g: PathGraph, labels: DataFrame) -> PathGraph:
    """With new labels (node_id, label) for the nodes named."""
    new = labels.select("node_id", F.col("label").alias("new"))
    return PathGraph(g.nodes.join(new, "node_id", "left").select("node_id", F.coalesce("new", "label").alias("label")), g.edges, g.steps)


def with_edges(g: PathGraph, edges: DataFrame) -> PathGraph:
    return PathGraph(g.nodes, g.edges.select("src", "dst").unionByName(edges.select("src", "dst")), g.steps)


def without_edges(g: PathGraph, edges: DataFrame) -> PathGraph:
    """Without any copy of the edges (src, dst)."""
    return PathGraph(g.nodes, g.edges.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst"), g.steps)


def extended(steps: DataFrame, more: DataFrame, front: bool = False) -> DataFrame:
    """``steps`` with further ones (path_id, step, node_id; steps numbered from 0) behind the last step of
    their path, or before its first, whose steps then move; a path that is not there yet begins."""
    kept, new = steps.select("path_id", "step", "node_id"), more.select("path_id", "step", "node_id")
    moved, other = (kept, new) if front else (new, kept)
    shift = other.groupBy("path_id").agg((F.max("step") + 1).alias("shift"))
    moved = moved.join(shift, "path_id", "left").select("path_id", (F.col("step") + F.coalesce("shift", F.lit(0))).alias("step"), "node_id")
    return other.unionByName(moved)


def reassigned(steps: DataFrame, subpaths: DataFrame) -> DataFrame:
    """``steps`` with other nodes at the places of ``subpaths`` (path_id, step, node_id)."""
    new = subpaths.select("path_id", "step", F.col("node_id").alias("new"))
    return steps.join(new, ["path_id", "step"], "left").select("path_id", "step", F.coalesce("new", "node_id").alias("node_id"))


def without_sentinels(edges: DataFrame, source: int = -1, sink: int = -2) -> DataFrame:
    """``edges`` without those of :func:`sentinel_edges`."""
    return edges.where((F.col("src") != source) & (F.col("dst") != sink))


def reassigned_sentinels(nodes: DataFrame, edges: DataFrame, steps: DataFrame, source: int = -1, sink: int = -2) -> DataFrame:
    """(src, dst) of the sentinels' edges anew, after the graph has changed."""
    return sentinel_edges(nodes, without_sentinels(edges, source, sink), steps, source, sink)


def densified(g: PathGraph) -> PathGraph:
    """The graph with node ids from 0 in the order of the old ones. Ids are ranks within ranges of old ids
    plus the ranges' offsets, so no task sees all of them."""
    width = 1_000_000
    at = F.floor(F.col("node_id") / width)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = g.nodes.groupBy(at.alias("range")).agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # a row a range
    rank = F.row_number().over(Window.partitionBy("range").orderBy("node_id"))
    to = g.nodes.select("node_id", at.alias("range")).withColumn("rank", rank).join(first, "range").select("node_id", (F.col("first") + F.col("rank") - 1).alias("to"))
    move = lambda df, c: df.join(to.select(F.col("node_id").alias(c), F.col("to").alias(f"{c}_to")), c).drop(c).withColumnRenamed(f"{c}_to", c)
    return PathGraph(move(g.nodes, "node_id").select("node_id", "label"), move(move(g.edges.select("src", "dst"), "src"), "dst").select("src", "dst"), move(g.steps, "node_id").select("path_id", "step", "node_id"))


def cycle_closed(edges: DataFrame, source: int = -1, sink: int = -2) -> DataFrame:
    """``edges`` and one from the sink back to the source, so that a graph between sentinels is a cycle."""
    return edges.select("src", "dst").union(edges.sparkSession.createDataFrame([(sink, source)], "src long, dst long"))


def side_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, side, component): adjacency components of node sides, 0 where edges enter and 1 where they
    leave, each named by its smallest side (twice the id plus the side)."""
    sides = nodes.select(F.explode(F.array(F.col("node_id") * 2, F.col("node_id") * 2 + 1)).alias("node_id"))
    found = components(sides, edges.select((F.col("src") * 2 + 1).alias("src"), (F.col("dst") * 2).alias("dst")))
    return found.select(F.floor(F.col("node_id") / 2).alias("node_id"), F.pmod("node_id", F.lit(2)).cast("int").alias("side"), "component")


def spelled(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path_id, seq): what each path spells."""
    letters = steps.join(nodes.select("node_id", "label"), "node_id").groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("step", "label"))).alias("x"))
    return letters.select("path_id", F.array_join(F.transform("x", lambda r: r["label"]), "").alias("seq"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component) of every node over undirected edges, named by the smallest node."""
    found = connected_components(edges.select("src", "dst"))
    return nodes.select("node_id").join(found.withColumnRenamed("node", "node_id"), "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def internal_fuse(g: PathGraph, pairs: DataFrame) -> PathGraph:
    """Merge nodes that ``pairs`` (n1, n2) align, transitively, into one node for each label of a group;
    it bears the smallest id."""
    part = components(g.nodes, pairs.where("n1 is not null and n2 is not null").select(F.col("n1").alias("src"), F.col("n2").alias("dst")))
    w = Window.partitionBy("component", "label")
    to = g.nodes.join(part, "node_id").select("node_id", "label", F.min("node_id").over(w).alias("to"))
    shift = lambda df, c: df.join(to.select(F.col("node_id").alias(c), F.col("to").alias(f"{c}_to")), c).drop(c).withColumnRenamed(f"{c}_to", c)
    nodes = to.where("node_id = to").select("node_id", "label")
    return PathGraph(nodes, make_simple(shift(shift(g.edges, "src"), "dst")), shift(g.steps, "node_id").select("path_id", "step", "node_id"))


def fuse(a: PathGraph, b: PathGraph, aligned: DataFrame) -> PathGraph:
    """Merge b into a along ``aligned`` (n1, n2): pairs of equal labels become one node with a's id; the
    others stay two nodes. b's ids move behind a's. Edges are united without repeats."""
    shift = a.nodes.agg((F.coalesce(F.max("node_id"), F.lit(-1)) + 1).alias("shift"))
    same = aligned.where("n1 is not null and n2 is not null").join(a.nodes.select(F.col("node_id").alias("n1"), F.col("label").alias("l1")), "n1").join(b.nodes.select(F.col("node_id").alias("n2"), F.col("label").alias("l2")), "n2")
    same = same.where("l1 = l2").select(F.col("n2").alias("node_id"), F.col("n1").alias("merged"))
    to = b.nodes.join(same, "node_id", "left").crossJoin(F.broadcast(shift)).select("node_id", "label", F.coalesce("merged", F.col("node_id") + F.col("shift")).alias("to"), F.col("merged").isNull().alias("own"))
    move = lambda df, c: df.join(to.select(F.col("node_id").alias(c), F.col("to").alias(f"{c}_to")), c).drop(c).withColumnRenamed(f"{c}_to", c)
    nodes = a.nodes.unionByName(to.where("own").select(F.col("to").alias("node_id"), "label"))
    edges = a.edges.select("src", "dst").unionByName(move(move(b.edges.select("src", "dst"), "src"), "dst").select("src", "dst")).distinct()
    return PathGraph(nodes, edges, a.steps.unionByName(move(b.steps, "node_id").select("path_id", "step", "node_id")))
