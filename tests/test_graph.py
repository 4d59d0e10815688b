import random

import pytest

from plait.model import PathGraph
from plait.operators import graph as G
from plait.operators.components import connected_components


def make(spark, n, edges, steps=(), labels="ACGTN"):
    return PathGraph(
        spark.createDataFrame([(i, labels[i % len(labels)]) for i in range(n)], "node_id long, label string"),
        spark.createDataFrame(list(edges), "src long, dst long"),
        spark.createDataFrame(list(steps), "path_id string, step long, node_id long"),
    )


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def random_dag(rng, n):
    return [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 2.0 / n]


def test_components_equal_brute_force(spark):
    rng = random.Random(1)
    for n, m in ((40, 25), (200, 150), (60, 200)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        up = list(range(n))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        seen = {x for e in edges for x in e}
        got = rows(connected_components(spark.createDataFrame(edges, "src long, dst long")), "node", "component")
        assert got == sorted((x, find(x)) for x in seen)
    line = [(i, i + 1) for i in range(300)]
    assert {c for _, c in rows(connected_components(spark.createDataFrame(line, "src long, dst long")), "node", "component")} == {0}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_in_one_task_equal_rounds(spark):
    rng = random.Random(3)
    loose = [(rng.randrange(-50, 50), rng.randrange(-50, 50)) for _ in range(60)] + [(70, 70), (None, 1), (2, None)]
    chain = [(i, i + 1) for i in range(300)]
    rng.shuffle(chain)
    for edges in (loose, loose + loose, chain, []):
        e = spark.createDataFrame(edges, "src long, dst long")
        n = sum(None not in x for x in edges)
        want = rows(connected_components(e), "node", "component")
        assert rows(connected_components(e, one_group=n), "node", "component") == want
        assert rows(connected_components(e, one_group=n - 1), "node", "component") == want


def test_dag_operators(spark):
    rng = random.Random(2)
    n = 14
    e = random_dag(rng, n)
    g = make(spark, n, e)
    pred = {v: [a for a, b in e if b == v] for v in range(n)}
    hi, lo, walks = {}, {}, {}
    for v in range(n):
        hi[v] = max((hi[p] + 1 for p in pred[v]), default=0)
        lo[v] = min((lo[p] + 1 for p in pred[v]), default=0)
        walks[v] = sum(walks[p] for p in pred[v]) if pred[v] else 1
    layered = G.layers(g.nodes, g.edges)
    assert rows(layered, "node_id", "layer") == sorted(hi.items())
    assert rows(G.minmax_distance(g.nodes, g.edges, layered), "node_id", "min_distance", "max_distance") == [(v, lo[v], hi[v]) for v in range(n)]
    assert rows(G.count_walks(g.nodes, g.edges, layered), "node_id", "walks") == sorted(walks.items())
    assert G.is_acyclic(g.nodes, g.edges)
    loop = make(spark, 3, [(0, 1), (1, 2), (2, 0)])
    assert not G.is_acyclic(loop.nodes, loop.edges)
    with pytest.raises(ValueError):
        G.layers(loop.nodes, loop.edges)


def test_reach(spark):
    e = [(0, 1), (1, 2), (0, 3), (3, 2), (2, 4)]
    steps = [("p", 0, 0), ("p", 1, 1), ("p", 2, 2), ("p", 3, 4), ("q", 0, 0), ("q", 1, 3), ("q", 2, 2)]
    g = make(spark, 5, e, steps)
    got = rows(G.reach(g.steps, g.edges, G.layers(g.nodes, g.edges)), "node_id", "path_id", "last_step")
    assert got == [(0, "p", 0), (0, "q", 0), (1, "p", 1), (1, "q", 0), (2, "p", 2), (2, "q", 2), (3, "p", 0), (3, "q", 1), (4, "p", 3), (4, "q", 2)]


def test_unipaths(spark):
    e = [(0, 1), (1, 2), (2, 3), (2, 4), (3, 5), (4, 5), (5, 6)]
    g = make(spark, 7, e, [("p", 0, 0), ("p", 1, 1), ("p", 2, 2), ("p", 3, 3), ("p", 4, 5), ("p", 5, 6)])
    assert rows(G.unipaths(g.nodes, g.edges, g.steps), "node_id", "unipath", "place") == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 5, 1)]
    line = make(spark, 40, [(i, i + 1) for i in range(39)])
    assert rows(G.unipaths(line.nodes, line.edges, line.steps), "unipath", "place") == [(0, i) for i in range(40)]


def test_purge_append_fuse(spark):
    a = make(spark, 4, [(0, 1), (1, 2), (1, 3)], [("p", 0, 0), ("p", 1, 1), ("p", 2, 2)])
    assert rows(G.purge_uncovered(a).nodes, "node_id") == [(0,), (1,), (2,)] and rows(G.purge_uncovered(a).edges, "src", "dst") == [(0, 1), (1, 2)]
    b = make(spark, 3, [(0, 1), (1, 2)], [("q", 0, 0), ("q", 1, 1), ("q", 2, 2)], labels="ACT")
    both = G.append(a, b)
    assert rows(both.edges, "src", "dst") == [(0, 1), (1, 2), (1, 3), (4, 5), (5, 6)] and both.nodes.count() == 7
    pairs = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (None, None)], "n1 long, n2 long")
    f = G.fuse(a, b, pairs)  # A-A and C-C merge, G-T do not
    assert rows(f.edges, "src", "dst") == [(0, 1), (1, 2), (1, 3), (1, 6)] and f.nodes.count() == 5
    assert [r.node_id for r in f.steps.where("path_id = 'q'").orderBy("step").collect()] == [0, 1, 6]
    label = {r.node_id: r.label for r in f.nodes.collect()}
    assert "".join(label[r.node_id] for r in f.steps.where("path_id = 'q'").orderBy("step").collect()) == "ACT"


def test_internal_fuse(spark):
    g = make(spark, 6, [(0, 1), (1, 2), (3, 4), (4, 5)], [("p", i, i) for i in range(3)] + [("q", i - 3, i) for i in range(3, 6)], labels="ACG")
    f = G.internal_fuse(g, spark.createDataFrame([(0, 3), (2, 5), (1, 3)], "n1 long, n2 long"))
    # 0, 3 and 1 are one group; 0 and 3 share a label, 1 does not
    assert rows(f.nodes, "node_id", "label") == [(0, "A"), (1, "C"), (2, "G"), (4, "C")]
    assert rows(f.edges, "src", "dst") == [(0, 1), (0, 4), (1, 2), (4, 2)]


def test_leaf_graph_spells(spark):
    s = spark.createDataFrame([("b", "acgt"), ("a", "TTN")], "name string, seq string")
    g = G.leaf_graph(s)
    got = {p: "" for p in "ab"}
    for r in g.steps.join(g.nodes, "node_id").orderBy("path_id", "step").collect():
        got[r.path_id] += r.label
    assert got == {"a": "TTN", "b": "ACGT"} and g.edges.count() == 5


def test_extraction(spark):
    e = [(0, 1), (1, 2), (2, 3), (1, 4), (5, 2)]
    g = make(spark, 6, e)
    one = lambda x: spark.createDataFrame([(x,)], "node_id long")
    assert rows(G.connecting_nodes(g.edges, one(0), one(3)), "node_id") == [(1,), (2,)]
    assert rows(G.shortest_paths(g.edges, one(0)), "node_id", "hops") == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 2)]
    assert rows(G.target_reachability(g.edges, one(2)), "node_id", "hops") == [(0, 2), (1, 1), (2, 0), (5, 1)]
    sub = G.induced(g, spark.createDataFrame([(1,), (2,)], "node_id long"))
    assert rows(sub.edges, "src", "dst") == [(1, 2)]


def test_kernels_equal_rounds(spark, monkeypatch):
    rng = random.Random(5)
    e = random_dag(rng, 16)
    steps = [("p", k, v) for k, v in enumerate(sorted(rng.sample(range(16), 7)))] + [("q", k, v) for k, v in enumerate(sorted(rng.sample(range(16), 5)))]
    g = make(spark, 16, e, steps)
    one = spark.createDataFrame([(0,)], "node_id long")

    def every():
        return [
            rows(G.layers(g.nodes, g.edges), "node_id", "layer"),
            rows(G.minmax_distance(g.nodes, g.edges), "node_id", "min_distance", "max_distance"),
            rows(G.count_walks(g.nodes, g.edges), "node_id", "walks"),
            rows(G.reach(g.steps, g.edges), "node_id", "path_id", "last_step"),
            rows(G.shortest_paths(g.edges, one), "node_id", "hops"),
        ]

    kernels = every()
    monkeypatch.setattr(G, "ONE_GROUP", 0)
    assert [sorted(x) for x in every()] == [sorted(x) for x in kernels]


def test_long_walks(spark):
    n = 3000
    line = make(spark, n, [(i, i + 1) for i in range(n - 1)])
    assert G.layers(line.nodes, line.edges).agg({"layer": "max"}).first()[0] == n - 1
    walk = G.shortest_walk(line.edges, spark.createDataFrame([(5,)], "node_id long"), spark.createDataFrame([(1000,), (7,)], "node_id long"))
    assert rows(walk, "step", "node_id") == [(0, 5), (1, 6), (2, 7)]


def counted(df, seen):
    """``df``, with each row counted in ``seen`` whenever it is made."""

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema)


def test_post_switch_distances(spark, monkeypatch):
    rng = random.Random(6)
    n = 16
    e = random_dag(rng, n) + [(i, i + 1) for i in range(0, n - 1, 2)]
    steps = [("p", k, v) for k, v in enumerate(sorted(rng.sample(range(n), 7)))] + [("q", k, v) for k, v in enumerate(sorted(rng.sample(range(n), 5)))]
    far = {(a, a): 0 for a in range(n)}
    for a in range(n):
        for b in range(a, n):
            for x, y in e:
                if x == b and (a, b) in far:
                    far[a, y] = min(far.get((a, y), n), far[a, b] + 1)
    want = []
    for v in range(n):
        for p in "pq":
            last = max(((k, a) for q, k, a in steps if q == p and (a, v) in far), default=None)
            if last:
                want.append((v, p, last[0], far[last[1], v]))
    g = make(spark, n, e, [*steps, (None, 0, 3)])
    columns = "node_id", "path_id", "last_step", "distance"
    assert rows(G.post_switch_distances(g.steps, g.edges), *columns) == want
    monkeypatch.setattr(G, "ONE_GROUP", 0)
    assert rows(G.post_switch_distances(g.steps, g.edges), *columns) == want
    # what a round reads does not go back to the steps
    layered, seen = G.layers(g.nodes, g.edges), spark.sparkContext.accumulator(0)
    assert rows(G.post_switch_distances(counted(g.steps, seen), g.edges, layered), *columns) == want
    assert seen.value <= 2 * (len(steps) + 1)


def test_post_switch_query_reads_lines_once(spark, monkeypatch):
    from plait import adapters, graph_queries

    seen, d = spark.sparkContext.accumulator(0), "/root/testdata/sf0.001"
    monkeypatch.setattr(adapters, "table", lambda spark, d, name, read=adapters.table: counted(read(spark, d, name), seen))
    assert graph_queries.dag_post_switch_distances(spark, d).count()
    assert seen.value == spark.read.parquet(f"{d}/lineitem.parquet").count()
