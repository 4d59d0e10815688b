import pytest
from pyspark.errors import PySparkException

from plait.kernels import align as K
from plait.model import PathGraph
from plait.operators import trees
from plait.plans import progressive
from plait.sources import fasta, gfa, newick, text

TREES = ["((A,B),(C,D));", "((A),(B,C));", "(,,(,));", "(A,B,(C,D)E)F;", "(A:0.1,B:0.2,(C:0.3,D:0.4)E:0.5)F;", "A;", '("x y":1,B:2):0;']


def test_newick_round_trip():
    for t in TREES:
        tree = newick.parse(t + " \n")
        again = newick.parse(newick.write(tree))
        assert (again.parent, again.label, again.distance) == (tree.parent, tree.label, tree.distance)
    for bad in ("((A,B);", "(A,B)); ", "(A,B)", "(A,A);", "('A',B);", "(A#1,B);", "(A,B);x", 'A B"C";'):
        with pytest.raises(ValueError):
            newick.parse(bad)


def test_tree_operators():
    t = newick.parse("((A:1,B:2)x:3,(C:1,(D:1,E:1,F:2):1)y:4)r;")
    at = {n: i for i, n in enumerate(t.label) if n}
    assert t.pair_distance(at["A"], at["B"]) == 3 and t.pair_distance(at["A"], at["D"]) == 1 + 3 + 4 + 1 + 1
    assert [t.label[n] for n in t.leaves()] == list("ABCDEF")
    p = t.pruned({"A", "D", "E"}).compacted()
    back = {n: i for i, n in enumerate(p.label) if n}
    assert {p.label[n] for n in p.leaves()} == {"A", "D", "E"} and p.pair_distance(back["A"], back["D"]) == 10 and len(p.parent) == 5
    q = t.pruned({"D", "E"})
    assert {q.label[n] for n in q.leaves()} == {"D", "E"} and q.distance[0] is None
    b = t.binarized()
    assert all(len(c) in (0, 2) for c in b.children) and {b.label[n] for n in b.leaves()} == set("ABCDEF")
    bb = {n: i for i, n in enumerate(b.label) if n}
    assert b.pair_distance(bb["A"], bb["F"]) == t.pair_distance(at["A"], at["F"])
    sizes = [len([x for x in t.leaves() if n in up(t, x)]) for n in t.small_first()]
    assert sizes == sorted(sizes)
    other = newick.parse("((A,C),(B,(D,E,F)));")
    assert [(w, f) for w, _, _, f in trees.compare(t, other)] == [("first", 0), ("first", 1), ("second", 0), ("second", 1)] or any(f for *_, f in trees.compare(t, other))
    assert newick.parse(trees.in_order(["a", "b", "c"])).label.count("") == 2
    assert len(newick.parse("((A:1,B:1):0,C:1);").polytomized().children[0]) == 3


def up(t, n):
    out = {n}
    while (n := t.parent[n]) is not None:
        out.add(n)
    return out


def test_tree_tables(spark):
    t = newick.parse("((A:1,B:2)x:3,(C:1,(D:1,E:1):1)y:4)r;")
    table = t.to_table(spark)
    closure = trees.ancestors(table)
    leaves = t.leaves()
    got = {(r.a, r.b): r.distance for r in trees.leaf_pair_distances(table, closure).collect()}
    assert got == {(a, b): t.pair_distance(a, b) for a in leaves for b in leaves if a < b}
    assert sorted((r.ancestor, r.leaf) for r in trees.leaf_sets(table, closure).collect()) == sorted((a, n) for n in leaves for a in up(t, n))


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT\nAC\n>two\nNNNN\n")
    rows = {r.name: r.seq for r in fasta.read(spark, str(tmp_path / "a.fa")).collect()}
    assert rows == {"one": "ACGTAC", "two": "NNNN"}
    fasta.write(fasta.read(spark, str(tmp_path / "a.fa")), str(tmp_path / "out"))
    assert {r.name: r.seq for r in fasta.read(spark, str(tmp_path / "out/*.txt")).collect()} == rows
    for bad in (">a\nAC\nACGT\n", ">a\nACG\nA\nACG\n", "ACGT\n", ">a\nA\n>a\nC\n"):
        (tmp_path / "b.fa").write_text(bad)
        with pytest.raises(PySparkException):
            fasta.read(spark, str(tmp_path / "b.fa")).collect()


def test_gfa_round_trip(spark, tmp_path):
    bases = "ACGTACGTAC"
    edges = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (3, 5), (4, 6), (5, 6), (6, 7), (7, 8), (8, 9)]
    paths = {"p": [0, 1, 3, 4, 6, 7, 8, 9], "q": [0, 2, 3, 5, 6, 7, 8, 9]}
    g = PathGraph(
        spark.createDataFrame([(i, c) for i, c in enumerate(bases)], "node_id long, label string"),
        spark.createDataFrame(edges, "src long, dst long"),
        spark.createDataFrame([(p, i, v) for p, w in paths.items() for i, v in enumerate(w)], "path_id string, step long, node_id long"),
    )
    gfa.write(g, str(tmp_path / "g"))
    kinds = [r.value[0] for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert (kinds.count("S"), kinds.count("L"), kinds.count("P")) == (7, 8, 2)
    back = gfa.read(spark, str(tmp_path / "g"))
    label = {r.node_id: r.label for r in back.nodes.collect()}
    spelled = {p: "" for p in paths}
    for r in back.steps.orderBy("path_id", "step").collect():
        spelled[r.path_id] += label[r.node_id]
    assert spelled == {p: "".join(bases[v] for v in w) for p, w in paths.items()} and back.edges.count() == len(edges)
    (tmp_path / "r.gfa").write_text("S\t1\tAC\nS\t2\tG\nL\t2\t-\t1\t-\t0M\nP\tx\t1+,2+\t*\n")
    r = gfa.read(spark, str(tmp_path / "r.gfa"))
    assert sorted((x.src, x.dst) for x in r.edges.collect()) == [(0, 1), (1, 2)]
    for bad in ("S\t1\tA\nS\t2\tC\nL\t1\t+\t2\t-\t*\n", "S\t1\tA\nL\t1\t+\t1\t+\t3M\n", "X\t1\n", "S\t1\tA\nP\tx\t1-\t*\n"):
        (tmp_path / "b.gfa").write_text(bad)
        with pytest.raises((PySparkException, ValueError)):
            b = gfa.read(spark, str(tmp_path / "b.gfa"))
            b.edges.collect(), b.steps.collect()


def test_config():
    values = {"threads": 4, "name": "a b", "on": True, "pieces": [1.5, 2.0]}
    assert text.parse_config(text.write_config(values)) == {"threads": "4", "name": "a b", "on": "true", "pieces": "1.5, 2.0"}
    assert text.parse_config("# c\n---\nx: 1 # one\n\ny: \"a # b\"\n") == {"x": "1", "y": "a # b"}
    for bad in ("x: 1", "---\nx 1", "---\nx: 1\nx: 2", '---\nx: "a'):
        with pytest.raises(ValueError):
            text.parse_config(bad)


def test_bed_identity_maf(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track name=x\nchr1\t5\t9\tm\t0\n")
    assert [tuple(r) for r in text.read_bed(spark, str(tmp_path / "a.bed")).collect()] == [("chr1", 5, 9, "m")]
    (tmp_path / "i.txt").write_text("3\n4\n")
    assert [r.value for r in text.read_identity(spark, str(tmp_path / "i.txt")).collect()] == [3, 4]
    rows = [(0, 0, "p", 2, "A", 9, "q", None, None, 7), (0, 1, "p", 3, "C", 9, "q", None, None, 7)]
    df = spark.createDataFrame(rows, "block long, pos long, name1 string, at1 long, base1 string, size1 long, name2 string, at2 long, base2 string, size2 long")
    assert text.maf_lines(df).first().text == "a\ns\tp\t2\t2\t+\t9\tAC\ns\tq\t7\t0\t+\t7\t--\n"


def test_progressive():
    import random

    rng = random.Random(3)
    root = "".join(rng.choice("ACGT") for _ in range(30))
    seqs = {}
    for i in range(5):
        s = list(root)
        for _ in range(3):
            k = rng.randrange(len(s))
            s[k : k + 1] = rng.choice([[], [rng.choice("ACGT")], [s[k], rng.choice("ACGT")]])
        seqs[f"s{i}"] = "".join(s)
    g = progressive.align(seqs, newick.parse("((s0,s1),(s2,s3),s4);"))
    assert all(g.spelled(n) == s for n, s in seqs.items()) and len(g.labels) < sum(map(len, seqs.values())) / 2
    g.dag()  # acyclic
    same = progressive.align({"a": root, "b": root})
    assert len(same.labels) == len(root)
    aln, anchors, _ = progressive.pairwise(root, root)
    assert K.cigar(aln, root, root) == "30=" and anchors == 1
    assert progressive.align({}).labels == []


def test_deep_tree(spark):
    n = 1300  # deeper than a thousand
    rows = [(i, i - 1 if i else None, 0, f"n{i}", 1.0) for i in range(n)]
    closure = trees.ancestors(spark.createDataFrame(rows, "node_id long, parent_id long, ord int, label string, distance double"))
    assert closure.count() == n * (n + 1) // 2
    assert closure.agg({"edges": "max", "distance": "max"}).first()[:2] == (n - 1, n - 1.0)
    with pytest.raises(ValueError):
        trees.ancestors(spark.createDataFrame([(0, 1), (1, 0)], "node_id long, parent_id long").selectExpr("*", "1.0d as distance"))


def test_pairs_of_leaves(spark):
    import random

    rng = random.Random(2)
    t = trees.Tree()
    t.add(None, "0")
    for i in range(1, 60):
        t.add(rng.randrange(i), str(i), float(rng.randrange(1, 9)))
    table = t.to_table(spark)
    old, trees.PAIR_LEAVES = trees.PAIR_LEAVES, 5
    try:
        got = sorted(tuple(r) for r in trees.leaf_pair_distances(table, trees.ancestors(table)).select("a", "b", "distance").collect())
    finally:
        trees.PAIR_LEAVES = old
    leaves = sorted(t.leaves())
    assert got == [(a, b, t.pair_distance(a, b)) for a in leaves for b in leaves if a < b]
