"""Thresholds hold for documents that the model has not seen."""

import random

from plait.llm import quality
from tests.llm.test_quality import frames


def prose(rng, vocab):
    return " ".join(vocab[min(int(rng.paretovariate(0.6)) - 1, len(vocab) - 1)] for _ in range(rng.randrange(40, 120))) + "."


def test_small_language(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("aeioubcdfghlmnprst") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    docs = [(i, prose(rng, vocab), "de", i) for i in range(120)] + [(200 + i, "#@!%$ " * 30, "de", i) for i in range(10)]
    docs += [(300 + i, prose(rng, vocab[::-1]), "xx", i) for i in range(30)]
    labels = [(i, 1, 0) for i in range(40)] + [(300 + i, 1, 0) for i in range(10)]
    kept = {r.doc_id: r.keep for r in quality.judge(*frames(spark, docs, labels)).collect()}
    assert sum(not kept[i] for i in range(40, 120)) <= 2
    assert not any(kept[i] for i in range(200, 210))
    assert all(kept[i] for i in range(300, 330))  # ten trusted texts are no evidence


def test_folds_leave_counts_out(spark):
    rng = random.Random(9)
    docs, labels = [(i, "".join(rng.choice("abcd ") for _ in range(80)), "en", i) for i in range(30)], [(i, 1, 0) for i in range(25)]
    d, lab = frames(spark, docs, labels)
    got = {r.doc_id: r.nats for r in quality.perplexities(d, lab, 3, folds=3).collect()}
    joined = {r.doc_id: r.nats for r in quality.perplexities(d, lab, 3, broadcast_entries=0, folds=3).collect()}
    whole = {r.doc_id: r.nats for r in quality.perplexities(d, lab, 3).collect()}
    fold = {r.doc_id: r.f for r in d.selectExpr("doc_id", "pmod(xxhash64(text), 3) as f").collect()}
    for k in range(3):
        rest = [(i, 1, 0) for i in range(25) if fold[i] != k]
        alone = {r.doc_id: r.nats for r in quality.perplexities(d, spark.createDataFrame(rest, "doc_id long, quality int, toxic int"), 3).collect()}
        assert all(abs(got[i] - alone[i]) < 1e-6 for i in range(25) if fold[i] == k)
    assert all(abs(got[i] - joined[i]) < 1e-6 for i in range(30))
    assert all(abs(got[i] - whole[i]) < 1e-6 for i in range(25, 30))
