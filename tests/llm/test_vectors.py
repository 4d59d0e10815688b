import numpy as np

from plait.llm import ann, maxscore


def table(spark, n=900, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)).astype(np.float32)
    x[n // 2 : n // 2 + n // 4] = x[0] + 0.01 * rng.standard_normal((n // 4, dims))
    x[10:40] = x[5]  # ties
    rows = [(i, x[i].tolist(), i % 3) for i in range(n)]
    rows[7] = (7, None, 0)
    rows[8] = (8, [float("nan")] * dims, 0)
    rows[9] = (9, [0.0] * dims, 0)
    rows[60] = (60, [None] + x[60].tolist()[1:], 0)
    rows.append((None, x[0].tolist(), 0))
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"), x


def brute(x, bad, every, k, score):
    ids = [i for i in range(len(x)) if i not in bad]
    out = {}
    for q in ids:
        if q % every == 0:
            s = sorted(((-score(x[q], x[i]), i) for i in ids if i != q))
            out[q] = [(i, -v) for v, i in s[:k]]
    return out


def test_maxscore_equals_brute_force(spark):
    df, x = table(spark)
    x = x.astype(np.float64)
    x[9] = 0
    score = lambda a, b: int((np.floor(1024 * a) * np.floor(1024 * b)).sum())
    want = brute(x, {7, 8, 60}, 100, 10, score)
    got = {}
    for r in maxscore.top_k(df.repartition(5)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want


def test_ann_recall_and_scores(spark):
    df, x = table(spark)
    x = x.astype(np.float64)
    want = brute(x, {7, 8, 9, 60}, 20, 20, lambda a, b: float((a * b).sum()))
    got = {}
    for r in ann.nearest(df.repartition(3)).orderBy("query_id", "rank").collect():
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    hit = total = 0
    for q in want:
        assert len(got[q]) == 20
        hit += len({i for i, _ in got[q]} & {i for i, _ in want[q]})
        total += 20
        for i, s in got[q]:
            assert abs(s - float((x[q] * x[i]).sum())) < 1e-12
    assert hit >= 0.9 * total


def test_small_and_empty(spark):
    df, _ = table(spark)
    assert ann.nearest(df.limit(0)).count() == 0 and maxscore.top_k(df.limit(0)).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert ann.nearest(few).count() == 2 and maxscore.top_k(few).count() == 2


def test_large_weights(spark):
    rng = np.random.default_rng(4)
    for size in (1e5, 1e6, 3e9, 1e12):
        x = np.round(rng.standard_normal((300, 8)) * size, 3)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        w = [[int(np.floor(1024 * v)) for v in row] for row in x]
        clip = lambda v: min(max(v, -(2**63)), 2**63 - 1)
        score = lambda a, b: sum(p * q for p, q in zip(a, b))
        got = {}
        for r in maxscore.top_k(df.repartition(2), k=5).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        # ranked by the whole score; those beyond a long tie once they are given as the nearest one
        want = {q: [(i, clip(s)) for i, s in v] for q, v in brute(w, set(), 100, 5, score).items()}
        assert {q: [s for _, s in v] for q, v in got.items()} == {q: [s for _, s in v] for q, v in want.items()}
        assert size > 1e8 or got == want


def test_lengths_and_blocks(spark):
    df, x = table(spark)
    odd = df.unionByName(spark.createDataFrame([(2000, [1.0, 2.0], 0), (2001, [3.0, 1.0], 0), (2002, [1e300, 1e300], 0), (2100, [], 0)], "vec_id long, embedding array<float>, score int"))
    plain = {(r.query_id, r.rank): (r.vec_id, r.score) for r in maxscore.top_k(df).collect()}
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in maxscore.top_k(odd.repartition(3)).collect()}
    assert {k: v for k, v in got.items() if k[0] < 2000} == plain
    assert got[2000, 1] == (2001, 1024 * 1024 * 5)
    assert {r.vec_id for r in ann.nearest(odd).where("query_id = 2000").collect()} == {2001}
    from plait.llm import vectors

    rows = vectors.usable(df, zero=True)
    many = vectors.search(rows, rows.where("vec_id % 100 = 0"), 10, lambda ids, v: maxscore.answer(ids, v, 10), "long", block=2)
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in many.collect()} == plain
