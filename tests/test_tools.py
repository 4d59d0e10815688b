import random

import numpy as np
import pytest

from plait.kernels import cyclic as Y
from plait.kernels import strings as S
from plait.parameters import Parameters
from plait.plans import executor, progressive
from plait.sources import newick
from plait.tools import simulate, variants


def test_parameters():
    p = Parameters(fasta_name="x.fa").validate()
    assert Parameters.from_config(p.to_config()) == p
    rng = random.Random(1)
    for _ in range(20):
        q = Parameters(fasta_name="a b", max_count=rng.randrange(1, 99), restart=rng.random() < 0.5, subproblems_prefix="p", anchor_gap_open=(1.0, 2.5, 3.0))
        assert Parameters.from_config(q.to_config()) == q
    for bad in ({"threads": 0}, {"max_wfa_size": 1}, {"stitch_gap_open": (9, 8, 7)}, {"anchor_gap_extend": (1.0, 2.0, 3.0)}, {"restart": True}, {"logging_level": 9}, {"indel_fuzz_score_proportion": 1.5}, {"fasta_name": ""}):
        with pytest.raises(ValueError):
            Parameters(**({"fasta_name": "x"} | bad)).validate()
    with pytest.raises(ValueError):
        Parameters.from_config("---\nno_such: 1")


def test_suffix_arrays():
    rng = random.Random(2)
    for _ in range(100):
        s = "".join(rng.choice("AC$") for _ in range(rng.randrange(0, 30)))
        order = S.suffix_array([ord(c) for c in s])
        assert list(order) == sorted(range(len(s)), key=lambda i: s[i:])
        lcp = S.common_prefixes(s, order)
        for k in range(1, len(s)):
            a, b = s[order[k - 1] :], s[order[k] :]
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert lcp[k] == n


def test_trie_and_automaton():
    t = S.Trie()
    t.insert("a", [1, 2, 3])
    t.insert("b", [1, 2, 4])
    assert t.follow([1, 2]) is not None and t.follow([2]) is None and len(t.children) == 5
    rng = random.Random(3)
    for _ in range(50):
        n = rng.randrange(1, 8)
        labels = "".join(rng.choice("AC") for _ in range(n))
        succ = [[j for j in range(i + 1, n) if rng.random() < 0.5] for i in range(n)]
        pred = [[i for i in range(n) if j in succ[i]] for j in range(n)]
        sinks = [i for i in range(n) if not succ[i]]

        def language(labels, succ, ends):
            """Labels of walks to the ends."""
            out, todo = set(), [(e, labels[e]) for e in ends]
            back = [[i for i in range(len(succ)) if j in succ[i]] for j in range(len(succ))]
            while todo:
                v, w = todo.pop()
                out.add(w)
                todo += [(p, labels[p] + w) for p in back[v]]
            return out

        lab, edges, members = S.reverse_deterministic(labels, pred, sinks)
        out = [[b for a, b in edges if a == i] for i in range(len(lab))]
        assert language(lab, out, [i for i, m in enumerate(members) if m & set(sinks)]) == language(labels, succ, sinks)
        for i in range(len(lab)):
            into = [lab[a] for a, b in edges if b == i]
            assert len(into) == len(set(into))


def test_cyclic_blocks():
    a, b = [1, 2, 3, 4, 5, 6], [1, 2, 9, 4, 5, 6]
    assert Y.blocks(a, b) == [[(i, i) for i in range(6)]]
    two = [1, 2, 3, 1, 2, 3]
    for blk in Y.blocks(two, [1, 2, 3]):
        assert all(two[x] == [1, 2, 3][y] for x, y in blk if None not in (x, y))
    assert Y.close_short_gaps([(0, 0), (1, None), (None, 1), (2, 2)]) == [(0, 0), (1, 1), (2, 2)]
    assert Y.close_short_gaps([(0, None)]) == [(0, None)]
    assert Y.noncyclic_extension([1, 2, 3, 1, 4, 5], [(1, 2)]) == [(1, 4)] or Y.noncyclic_extension([1, 2, 3, 1, 4, 5], [(1, 2)]) == [(1, 6)]


def test_bonds():
    a, b, c = [(0, 100, 50)], [(2, 101, 30)], [(500, 900, 50)]
    assert Y.distinct_bonds([a, b, c], 100) == [a, c]
    assert Y.distinct_bonds([b, a], 100) == [a]
    assert Y.bonded_pairs(list(range(10, 20)), [[(0, 5, 2)]]) == [(10, 15), (11, 16)]
    assert Y.trimmed([0.0, 5.0, 5.0, 0.0], [1.0] * 4, 1.0, 1.0) == (1, 3)
    assert Y.masked([([1, 2], [3, 4]), ([1, 2], [4, 3])], [([2], [4])]) == [True, False]


def test_variants():
    g = progressive.PathDag(list("ACGTA"), {(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)}, {"p": [0, 1, 3, 4], "q": [0, 2, 3, 4]})
    assert variants.variant_matrix(g) == [(0, 3, "SNP", {"p": "C", "q": "G"})]
    assert variants.universal_bridges(g) == [(3, 4, {"p": (2, 2), "q": (2, 2)})]
    h, t = variants.without_samples(g, newick.parse("(p,q,r);"), {"q", "r"})
    assert h.spelled("p") == "ACTA" and len(h.labels) == 4 and t.label == ["p"]


def test_simulation():
    rng = np.random.default_rng(1)
    root = simulate.repeat_array(rng, 15, 2, 6)
    tree = newick.parse("((a:1,b:1):1,(c:1,d:1):1);")
    one, two = simulate.simulate(tree, root, seed=4), simulate.simulate(tree, root, seed=4)
    assert one == two and set(one) == set("abcd")
    for s, o in one.values():
        assert len(s) == len(o)
    still = simulate.simulate(tree, root, simulate.Rates(0, 0, 0, 0))
    assert all(s == root and o == list(range(len(root))) for s, o in still.values())
    m = simulate.compare([(i, i) for i in range(len(root))], *(still[x][1] for x in "ab"))
    assert m == {"match_rate": 1.0, "completeness": 1.0, "accuracy": 1.0}
    assert abs(simulate.pareto_mean(simulate.pareto_shape(1.5)) - 1.5) < 1e-3


def test_executor(spark):
    seqs = spark.createDataFrame([("j1", "a", "ACGTACGT"), ("j1", "b", "ACGACGT"), ("j2", "c", "TTTT"), ("j2", "d", "TTAT")], "job string, name string, seq string")
    trees = spark.createDataFrame([("j1", "(a,b);")], "job string, newick string")
    jobs = executor.jobs_of(seqs, trees)
    got = executor.run(jobs)
    for r in got.collect():
        text = {n: "".join(r.labels[v] for v in p) for n, p in zip(r.names, r.paths)}
        assert text == {x.name: x.seq for x in seqs.where(f"job = '{r.job}'").collect()}
    kept = got.where("job = 'j1'").cache()
    again = executor.run(jobs, Parameters(), kept)
    assert sorted(r.job for r in again.collect()) == ["j1", "j2"] and executor.info(again).count() == 2


def test_restart_from_a_table(spark, tmp_path):
    from plait.plans import executor

    rows = [(f"j{i}", f"s{i}{k}", "ACGTACGT"[k:]) for i in range(3) for k in range(2)]
    jobs = executor.jobs_of(spark.createDataFrame(rows, "job string, name string, seq string"))
    path = str(tmp_path / "results")
    assert [r.job for r in executor.run_to(jobs.where("job = 'j1'"), path).collect()] == ["j1"]
    assert sorted(r.job for r in executor.run_to(jobs, path).collect()) == ["j0", "j1", "j2"]
    assert spark.read.parquet(path).count() == 3  # the first was not run again
    assert {r.digest for r in executor.run_to(jobs, path).collect()} == {executor.digest([f"s{i}0", f"s{i}1"]) for i in range(3)}
