import math
import random
from collections import Counter, defaultdict

import pytest

from plait.llm import quality


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney from its definition, on strings with boundary signs."""
    B = chr(0x10FFFF)
    top = Counter()
    for t in texts:
        s = B * (order - 1) + t + B
        for i in range(len(t) + 1):
            top[s[i : i + order]] += 1
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        lower = Counter()
        for g in counts[k + 1]:
            lower[g[1:]] += 1
        counts[k] = lower
    disc, total, mass = {}, {}, {}
    for k, c in counts.items():
        n = Counter(min(v, 5) for v in c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        disc[k] = [0]
        for i in (1, 2, 3):
            d = i - (i + 1) * y * n[i + 1] / n[i] if y is not None and n[i] else 0.5 * i
            disc[k].append(max(0.1, min(d, 0.95 * i)))
        total[k], mass[k] = defaultdict(int), defaultdict(float)
        for g, v in c.items():
            total[k][g[:-1]] += v
            mass[k][g[:-1]] += disc[k][min(v, 3)]
    uniform = 1 / (len(counts[1]) + 1)

    def p(g):
        k = len(g)
        if k == 0:
            return uniform
        ctx = g[:-1]
        lower = p(g[1:])
        if ctx not in total[k]:
            return lower
        v = counts[k][g]
        return ((v - disc[k][min(v, 3)]) if v else 0) / total[k][ctx] + mass[k][ctx] / total[k][ctx] * lower

    def nats(t):
        s = B * (order - 1) + t + B
        return -sum(math.log(p(s[i : i + order])) for i in range(len(t) + 1))

    return nats


def corpus(spark, n=260):
    rng = random.Random(4)
    syll = {"en": ["the", "on", "er", "st", "a"], "fr": ["é", "ou", "le", "ai", "x"]}
    docs, labels = [], []
    for i in range(n):
        lang = "en" if i % 3 else "fr"
        bad = i % 6 == 5
        w = ["".join(rng.choice(syll[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))]
        t = " ".join(w) + "."
        if bad:
            t = t.upper().replace(" ", "!! ")
        docs.append((i, t, lang, i))
        labels.append((i, int(not bad), 0))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, nats int").drop("nats"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_equals_definition(spark):
    docs, labels = corpus(spark)
    d, lab = frames(spark, docs, labels)
    good = {i for i, q, _ in labels if q}
    for order in (2, 4):
        want = {lang: brute_model([t for i, t, g, _ in docs if g == lang and i in good], order) for lang in ("en", "fr")}
        got = {r.doc_id: (r.nats, r.n) for r in quality.perplexities(d, lab, order).collect()}
        joined = {r.doc_id: (r.nats, r.n) for r in quality.perplexities(d, lab, order, broadcast_entries=0).collect()}
        for i, t, g, _ in docs:
            assert got[i][0] == pytest.approx(want[g](t), rel=1e-9) and got[i][1] == len(t) + 1
            assert joined[i][0] == pytest.approx(got[i][0], rel=1e-9) and joined[i][1] == got[i][1]


def test_rejects_bad_and_keeps_good(spark):
    docs, labels = corpus(spark)
    d, lab = frames(spark, docs, labels)
    kept = {r.doc_id: r.keep for r in quality.judge(d, lab).collect()}
    bad = [i for i, q, _ in labels if not q]
    good = [i for i, q, _ in labels if q]
    assert sum(kept[i] for i in bad) <= 0.1 * len(bad) and sum(kept[i] for i in good) >= 0.98 * len(good)


def test_long_text_in_parts():
    import numpy as np

    texts = ["ab c" * 30_000 + "end", "", "x", "yz" * 70]
    whole = [quality._of_order(p, at, "x", 4) for p, at, _ in quality.spans(enumerate(texts), 4, 10**9)]
    parts = [(quality._of_order(p, at, "x", 4), own) for p, at, own in quality.spans(enumerate(texts), 4, 1000)]
    assert len(whole) == 1 and (np.concatenate([h for h, _ in parts]) == whole[0]).all()
    assert np.bincount(np.concatenate([own for _, own in parts])).tolist() == [len(t) + 1 for t in texts]


def test_clashing_columns(spark):
    docs, labels = corpus(spark, 60)
    d, lab = frames(spark, docs, labels)
    want = {r.doc_id: (r.nats, r.keep) for r in quality.judge(d, lab).collect()}
    odd = d.selectExpr("*", "1 as n", "'x' as score", "2 as nats", "3 as trusted", "4 as threshold", "5 as keep", "6 as mean", "7 as label", "8 as gram", "9 as _id", "10 as of")
    rows = quality.judge(odd, lab).collect()
    assert {r.doc_id: (r.nats, r.keep) for r in rows} == want and rows[0].label == 7
    assert {r.doc_id: r.nats for r in quality.perplexities(odd, lab, folds=3, broadcast_entries=0).collect()} == pytest.approx({i: x for i, (x, _) in want.items()})


def test_edges(spark, edge_docs):
    docs, labels = corpus(spark, 40)
    d, lab = frames(spark, docs, labels)
    odd = edge_docs.selectExpr("doc_id + 1000 as doc_id", "text", "if(doc_id % 3 = 0, null, if(doc_id % 3 = 1, 'en', 'xx')) as lang")
    rows = quality.judge(d.union(odd), lab).collect()
    assert len(rows) == 40 + edge_docs.count()
    assert all(r.keep for r in rows if r.lang is None or r.lang == "xx")
    assert quality.judge(d.limit(0), lab.limit(0)).count() == 0
    assert all(r.keep for r in quality.judge(d, lab.limit(0)).collect())
