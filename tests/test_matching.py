import random

from plait.operators import matching as M


def table(spark, seqs):
    return spark.createDataFrame([(n, i, n * 1000 + i, c) for n, s in enumerate(seqs) for i, c in enumerate(s)], "path_id long, step long, node_id long, label string")


def brute(one, two, most):
    def count(seqs):
        out = {}
        for s in seqs:
            for i in range(len(s)):
                for j in range(i + 1, len(s) + 1):
                    out[s[i:j]] = out.get(s[i:j], 0) + 1
        return out

    a, b = count(one), count(two)
    both = {s: (a[s], b[s]) for s in a if s in b}
    return sorted((s, *c) for s, c in both.items() if c[0] * c[1] <= most and not any(t != s and t in s and both[t] == c for t in both))


def test_equals_brute_force(spark):
    rng = random.Random(1)
    cases = [(["AAGAG"], ["AAGAG"], 1), (["GCGACACGACNNG"], ["ATTCGACGCGACA"], 5), (["TCAAGATCTC"], ["TGACATTCTC"], 1)]
    for n in (5, 12, 25):
        a = "".join(rng.choice("ACGT") for _ in range(n))
        b = "".join(c if rng.random() > 0.2 else rng.choice("ACGT") for c in a)
        cases.append(([a, a[:4]], [b], rng.randrange(1, 6)))
    for one, two, most in cases:
        got = sorted((r.match, r.count1, r.count2) for r in M.minimal_rare_matches(table(spark, one), table(spark, two), most).collect())
        assert got == brute(one, two, most)


def test_rounds_equal_the_kernel(spark, monkeypatch):
    rng = random.Random(3)
    a = ["".join(rng.choice("ACG") for _ in range(14)) for _ in range(2)]
    b = [a[0][:6] + "T" + a[1][5:12]]
    # two places of one node count once
    one = table(spark, a).selectExpr("path_id", "step", "if(step < 3, step, node_id) as node_id", "label")
    two = table(spark, b)
    for longest in (None, 3):
        kernel = sorted(tuple(r) for r in M.minimal_rare_matches(one, two, 4, longest).collect())
        with monkeypatch.context() as m:
            m.setattr(M, "ONE_GROUP", 0)
            assert sorted(tuple(r) for r in M.minimal_rare_matches(one, two, 4, longest).collect()) == kernel and kernel
    assert M.minimal_rare_matches(one.limit(0), two, 4).count() == 0


def test_walks_and_weights(spark):
    t = table(spark, ["ACACG"])
    m = spark.createDataFrame([("AC", 2, 1), ("G", 1, 1)], "match string, count1 long, count2 long")
    assert sorted((r.match, r.step) for r in M.match_walks(m, t).collect()) == [("AC", 0), ("AC", 2), ("G", 4)]
    assert {r.match: round(r.weight, 6) for r in M.query_index(m, 0).collect()} == {"AC": round(2**-0.5, 6), "G": 1.0}


def test_budget(spark):
    sets = [(i, float(w), p) for i, (w, p) in enumerate([(9, 5), (8, 9), (7, 3), (7, 3), (6, 1), (5, 1)])]
    df = spark.createDataFrame(sets, "set_id long, weight double, pairs long")
    # 5 fits, 9 does not, one of the two 3s fits, then 1
    got = sorted(r.set_id for r in M.within_budget(df, 9).collect())
    left, want = 9, []
    for i, w, p in sets:
        if p <= left:
            left -= p
            want.append(i)
    assert got == want


def test_masks(spark):
    pairs = spark.createDataFrame([(1, [1, 2, 3], [7, 8, 9]), (2, [2, 5], [8, 1]), (3, [2, 5], [9, 1])], "pair_id long, nodes1 array<long>, nodes2 array<long>")
    assert sorted(r.pair_id for r in M.chain_mask(pairs, pairs.where("pair_id = 1")).collect()) == [1, 2]


def test_range_join(spark):
    rng = random.Random(4)
    a = [(i, rng.randrange(2), rng.choice("xy"), b := rng.randrange(300), b + rng.randrange(1, 90)) for i in range(80)]
    r = [(i, rng.choice("xy"), b := rng.randrange(300), b + rng.randrange(1, 60)) for i in range(20)]
    places = spark.createDataFrame(a, "set_id long, side int, path string, begin long, end long")
    regions = spark.createDataFrame(r, "region long, path string, begin2 long, end2 long")
    got = sorted(tuple(x) for x in M.induced_matches(places, regions, 25).collect())
    want = sorted((i, s, side, 1, min(e, e2) - max(b, b2)) for i, p2, b2, e2 in r for s, side, p, b, e in a if p == p2 and b < e2 and b2 < e)
    assert got == want
