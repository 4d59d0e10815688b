"""Kernels against brute force on random inputs."""

import itertools
import random

import pytest

from plait.kernels import align as K
from plait.kernels import chain as C
from plait.kernels import partition as P
from plait.kernels import structure as T


def seq(rng, n, alphabet="ACGT"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def spelled(alignment, n, m):
    a, b = [x for x, _ in alignment if x is not None], [y for _, y in alignment if y is not None]
    return a == list(range(n)) and b == list(range(m)) and all(p != (None, None) for p in alignment)


def random_dag(rng, n, p=0.3):
    succ = [[j for j in range(i + 1, n) if j == i + 1 and rng.random() < 0.7 or rng.random() < p * 2 / (j - i + 1)] for i in range(n)]
    return K.Dag(seq(rng, n, "AC"), succ)


def walks(g):
    out, stack = [], [[s] for s in g.sources]
    while stack:
        w = stack.pop()
        if not g.succ[w[-1]]:
            out.append(w)
        stack += [[*w, x] for x in g.succ[w[-1]]]
    return out


def test_needleman_wunsch_is_optimal():
    rng = random.Random(1)
    for s in (K.Scoring(2, 3, (4,), (1,)), K.Scoring(5, 4, (3, 9), (4, 1)), K.Scoring(20, 80)):
        for _ in range(40):
            a, b = seq(rng, rng.randrange(0, 9)), seq(rng, rng.randrange(0, 9))
            score, aln = K.needleman_wunsch(a, b, s)
            assert spelled(aln, len(a), len(b)) and K.rescore(aln, a, b, s) == score
            assert score == K.partial_order(K.chain(a), K.chain(b), s)[0]


def test_partial_order_over_walks():
    rng = random.Random(2)
    s = K.Scoring(5, 4, (3, 9), (4, 1))
    for _ in range(40):
        g, h = random_dag(rng, rng.randrange(1, 7)), random_dag(rng, rng.randrange(1, 7))
        want = max(K.needleman_wunsch("".join(g.labels[x] for x in v), "".join(h.labels[x] for x in w), s)[0] for v in walks(g) for w in walks(h))
        score, aln = K.partial_order(g, h, s)
        assert score == want and K.rescore(aln, g.labels, h.labels, s) == score


def test_edit_script_is_least():
    rng = random.Random(3)
    for _ in range(200):
        a, b = seq(rng, rng.randrange(0, 14), "AC"), seq(rng, rng.randrange(0, 14), "AC")
        d, aln = K.edit_script(a, b)
        assert spelled(aln, len(a), len(b))
        assert d == sum(x is None or y is None for x, y in aln) and all(x is None or y is None or a[x] == b[y] for x, y in aln)
        lcs = [p for p in K.longest_common_subsequence(a, b) if None not in p]
        assert d == len(a) + len(b) - 2 * len(lcs)
        assert spelled(K.longest_common_subsequence(a, b), len(a), len(b))


def test_lcs_is_longest():
    rng = random.Random(4)
    for _ in range(100):
        a, b = seq(rng, rng.randrange(0, 9), "ACG"), seq(rng, rng.randrange(0, 9), "ACG")
        best = max(k for k in range(len(a) + 1) for c in itertools.combinations(a, k) if (it := iter(b)) and all(x in it for x in c))
        got = [(a[x], b[y]) for x, y in K.longest_common_subsequence(a, b) if x is not None and y is not None]
        assert len(got) == best and all(x == y for x, y in got)
        part = K.nonrepeating_common_subsequence(a, b)
        assert len({a[x] for x, _ in part}) == len(part)


def test_wavefront_equals_needleman_wunsch():
    rng = random.Random(5)
    s = K.Scoring(2, 3, (4, 9), (3, 1))
    for _ in range(40):
        a, b = seq(rng, rng.randrange(1, 9)), seq(rng, rng.randrange(1, 9))
        score, aln = K.wavefront(K.chain(a), K.chain(b), s)
        assert score == K.needleman_wunsch(a, b, s)[0] and spelled(aln, len(a), len(b))
        near = K.wavefront(K.chain(a), K.chain(b), s, prune=50)
        assert near[0] == score


def test_deletion_and_greedy():
    rng = random.Random(6)
    s = K.Scoring(20, 80)
    long = seq(rng, 400)
    short = long[:15] + long[-12:]
    score, aln = K.deletion_wavefront(K.chain(short), K.chain(long), s)
    assert spelled(aln, len(short), len(long)) and score == 20 * 27 - s.gap(373)
    score, aln = K.greedy_partial(K.chain(short), K.chain(long), s)
    assert spelled(aln, len(short), len(long)) and K.rescore(aln, short, long, s) == score
    for _ in range(60):
        g, h = random_dag(rng, rng.randrange(1, 8)), random_dag(rng, rng.randrange(1, 8))
        _, aln = K.greedy_partial(g, h, s)
        for side, d in ((0, g), (1, h)):
            walk = [p[side] for p in aln if p[side] is not None]
            assert walk[0] in d.sources and walk[-1] in d.sinks and all(y in d.succ[x] for x, y in zip(walk, walk[1:]))


def test_dispatch():
    d = K.Dispatch()
    assert K.kernel_for(0, 5, 0, 0, 5, 5, False) == "pure deletion"
    assert K.kernel_for(100, 100, 100, 100, 100, 100, False) == "partial order"
    assert K.kernel_for(200, 5000, 200, 200, 5000, 5000, True) == "deletion wavefront"
    assert K.kernel_for(7000, 7000, 7000, 7000, 7000, 7000, False) == "pruned wavefront"
    assert K.kernel_for(7000, 7000, 7000, 7000, 7000, 7000, True) == "greedy partial"
    rng = random.Random(7)
    for _ in range(20):
        a, b = seq(rng, rng.randrange(0, 20)), seq(rng, rng.randrange(0, 20))
        _, aln = K.align_gap(K.chain(a), K.chain(b), K.Scoring())
        assert spelled(aln, len(a), len(b))
    small = K.Dispatch(max_trivial=0, min_wave=0, max_wave=10**9, short_max=0)
    a = seq(rng, 30)
    kind, aln = K.align_gap(K.chain(a), K.chain(a), K.Scoring(), False, small)
    assert kind == "pruned wavefront" and K.cigar(aln, a, a) == "30="


def test_scoring_pieces():
    s = K.Scoring()
    assert s.useful(10).opens == (60,) and s.useful(50).opens == (60, 800) and s.useful(5000).opens == s.opens
    assert s.gap(0) == 0 and s.gap(1) == 90 and s.gap(10000) == 12500


def anchors(rng, n):
    out = []
    for _ in range(n):
        b, c, k = rng.randrange(40), rng.randrange(40), rng.randrange(1, 5)
        out.append((b, b + k, c, c + k, round(rng.random() * 5 + 0.1, 3)))
    return out


def test_sparse_chains_equal_exhaustive():
    rng = random.Random(8)
    for _ in range(200):
        a = anchors(rng, rng.randrange(0, 25))
        want = C.exhaustive(a)[0]
        got, idx = C.sparse(a)
        assert got == pytest.approx(want) and sum(a[i][4] for i in idx) == pytest.approx(got)
        for opens, extends in (((0.25,), (0.25,)), ((0.4, 2.0), (0.5, 0.01)), ((1.25, 50, 5000), (2.5, 0.1, 0.0015))):
            want = C.exhaustive(a, opens, extends, 0.7)[0]
            got, idx = C.sparse_affine(a, opens, extends, 0.7)
            assert got == pytest.approx(want)
            assert all(a[i][1] <= a[j][0] and a[i][3] <= a[j][2] for i, j in zip(idx, idx[1:]))


def test_chain_helpers():
    a = [(0, 2, 0, 2, 1.0), (10, 12, 10, 12, 1.0)]
    assert C.fill_in([0, 1], a, [(4, 6, 4, 6, 0.5), (11, 13, 1, 3, 9.0)]) == [a[0], (4, 6, 4, 6, 0.5), a[1]]
    assert C.score_scale(a, [0, 1]) == 0.5 and C.reanchor_budget([1, 3], 10) == [3, 8]


def every_partition(n):
    if n == 0:
        yield []
        return
    for rest in every_partition(n - 1):
        yield rest
    for i in range(n):
        for rest in every_partition(i):
            yield [*rest, (i, n)]


def items(rng, n):
    return [(rng.choice([1.0, 2.0, 4.0, 0.5]), rng.choice([1.0, 2.0])) for _ in range(n)], [(rng.choice([-1.0, -3.0, 0.0, 0.5]), rng.choice([0.0, 1.0, 3.0])) for _ in range(max(0, n - 1))]


def test_partitions_equal_brute_force():
    rng = random.Random(9)
    for _ in range(150):
        x, y = items(rng, rng.randrange(0, 7))
        least = rng.choice([0.5, 1.5, 3.0])
        every = list(every_partition(len(x)))
        worth = lambda p: P.value(x, y, p, least)
        assert worth(P.maximum_weight(x, y, least)) == pytest.approx(max(map(worth, every)))
        avg = rng.choice([0.3, 0.8, 1.2])

        def meets(i, j):
            s = sum(a for a, _ in x[i:j]) + sum(a for a, _ in y[i : j - 1])
            n = sum(b for _, b in x[i:j]) + sum(b for _, b in y[i : j - 1])
            return s >= avg * n - 1e-9

        got = P.average_constrained(x, y, least, avg)
        assert all(meets(i, j) for i, j in got)
        assert worth(got) == pytest.approx(max(worth(p) for p in every if all(meets(i, j) for i, j in p)))
        window = rng.choice([2.0, 3.0, 6.0])
        begin, end = P._sums(x, y)
        bad = P.bad_windows(x, y, avg, window)

        def windows(i, j):
            if end[j - 1, 1] - begin[i, 1] < window:
                return meets(i, j)
            return not any(bad[k] for k in range(i, j) if begin[k, 1] + window <= end[j - 1, 1])

        got = P.window_average(x, y, least, avg, window)
        assert all(windows(i, j) for i, j in got)
        assert worth(got) == pytest.approx(max(worth(p) for p in every if all(windows(i, j) for i, j in p)))


def test_near_optimal_stretches_equal_brute_force():
    rng = random.Random(10)
    for _ in range(100):
        n = rng.randrange(0, 7)
        x = [(rng.choice([1.0, 2.0]), 2.0, rng.choice([0.5, 2.0, 1.5])) for _ in range(n)]
        y = [(rng.choice([0.0, 1.0]), 1.0, rng.choice([0.0, 1.0])) for _ in range(max(0, n - 1))]

        def ok(i, j):
            a, b, c = (sum(t[k] for t in x[i:j]) + sum(t[k] for t in y[i : j - 1]) for k in range(3))
            return a >= 2.0 and c >= 0.6 * b - 1e-9

        span = lambda p: sum(sum(t[0] for t in x[i:j]) + sum(t[0] for t in y[i : j - 1]) for i, j in p)
        got = P.longest_near_optimal(x, y, 2.0, 0.6)
        assert all(ok(i, j) for i, j in got)
        assert span(got) == pytest.approx(max(span(p) for p in every_partition(n) if all(ok(i, j) for i, j in p)))


def test_weak_anchors():
    assert P.weak_anchors([100.0, 0.1, 100.0], [0, 60, -60, 0], 0.001, 50) == [(1, 2)]
    assert P.weak_anchors([100.0, 50.0, 100.0], [0, 60, -60, 0], 0.001, 50) == []


def connected(n, edges, without, a, b):
    seen, todo = {a}, [a]
    while todo:
        v = todo.pop()
        for i, (x, y) in enumerate(edges):
            if i not in without and v in (x, y):
                w = y if v == x else x
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
    return b in seen


def test_edge_connectivity():
    rng = random.Random(11)
    for _ in range(60):
        n = rng.randrange(2, 8)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 13))]
        want = [i for i, (a, b) in enumerate(edges) if a != b and not connected(n, edges, {i}, a, b)]
        assert T.bridges(n, edges) == want
        two, three = T.two_edge_components(n, edges), T.three_edge_components(n, edges)
        for a in range(n):
            for b in range(a):
                joined = connected(n, edges, set(), a, b)
                assert (two[a] == two[b]) == (joined and all(connected(n, edges, {i}, a, b) for i in range(len(edges))))
                assert (three[a] == three[b]) == (joined and all(connected(n, edges, {i, j}, a, b) for i in range(len(edges)) for j in range(len(edges))))


def brute_superbubbles(succ):
    n = len(succ)

    def reach(s, without=None):
        seen, todo = {s}, [s]
        while todo:
            for w in succ[todo.pop()]:
                if w not in seen and w != without:
                    seen.add(w)
                    todo.append(w)
        return seen

    pred = [[a for a in range(n) if b in succ[a]] for b in range(n)]

    def back(t, without):
        seen, todo = {t}, [t]
        while todo:
            for w in pred[todo.pop()]:
                if w not in seen and w != without:
                    seen.add(w)
                    todo.append(w)
        return seen

    good = set()
    for s in range(n):
        for t in range(n):
            if s != t and t in reach(s):
                u = reach(s, t) | {t}
                if u == (back(t, s) | {s}):
                    good.add((s, t))
    return {(s, t) for s, t in good if not any((s, x) in good for x in reach(s, t) if x not in (s, t))}


def test_superbubbles():
    rng = random.Random(12)
    for _ in range(150):
        g = random_dag(rng, rng.randrange(2, 9))
        succ = [list(x) for x in g.succ]
        n = len(succ)
        succ = [[x + 1 for x in s] or [n + 1] for s in succ]
        succ = [[x + 1 for x in g.sources], *succ, []]
        assert set(T.superbubbles(succ)) == brute_superbubbles(succ)


def test_variant_classes():
    succ = [[1, 2], [3], [3], [4, 5], [5], []]
    b = T.superbubbles(succ)
    assert b == [(0, 3), (3, 5)] and T.lengths(succ, b) == [(3, 3), (2, 3)]
    assert [T.variant_class(*x) for x in T.lengths(succ, b)] == ["SNP", "indel"]
    assert T.variant_class(4, 9) == "MNV" and T.variant_class(2, 60) == "SV"
    assert T.nesting([(0, 9), (1, 3), (3, 8)], {i: i for i in range(10)}) == [None, 0, 0]


def test_snarls():
    edges = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (3, 5), (4, 6), (5, 6)]
    assert T.snarls(7, edges) == [[(0, 3), (3, 6)]]
    assert T.snarl_lengths(7, edges, (0, 3)) == (3, 3)
    loop = [(0, 1), (1, 2), (2, 1), (2, 3)]
    assert T.snarls(4, loop) and all(T.snarl_lengths(4, loop, s)[1] in (-1, 2, 3, 4) for c in T.snarls(4, loop) for s in c)
    assert T.snarl_lengths(4, loop, (0, 3)) == (4, -1)
    rng = random.Random(13)
    for _ in range(150):
        g = random_dag(rng, rng.randrange(2, 9))
        n = len(g.succ)
        succ = [[x + 1 for x in s] or [n + 1] for s in g.succ]
        succ = [[x + 1 for x in g.sources], *succ, []]
        e = [(a, b) for a, out in enumerate(succ) for b in out]
        found = {s for c in T.snarls(len(succ), e) for s in c}
        for s, t in T.superbubbles(succ):
            assert (s, t) in found
            lo, hi = T.lengths(succ, [(s, t)])[0]
            assert T.snarl_lengths(len(succ), e, (s, t)) == (lo, hi)


def test_graph_to_chain_equals_partial_order():
    rng = random.Random(14)
    for s in (K.Scoring(5, 4, (3, 9), (4, 1)), K.Scoring(), K.Scoring(2, 1, (0,), (2,))):
        for _ in range(60):
            g, h = random_dag(rng, rng.randrange(1, 10)), K.chain(seq(rng, rng.randrange(1, 10), "AC"))
            score, aln = K.graph_to_chain(g, h, s)
            assert score == K.partial_order(g, h, s)[0] == K.rescore(aln, g.labels, h.labels, s)
            walk = [x for x, _ in aln if x is not None]
            assert [y for _, y in aln if y is not None] == list(range(len(h)))
            assert walk[0] in g.sources and walk[-1] in g.sinks and all(b in g.succ[a] for a, b in zip(walk, walk[1:]))
