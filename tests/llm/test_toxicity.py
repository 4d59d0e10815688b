import math
import random
import re

import pytest

from plait.llm import toxicity

BAD = ["scum", "moron", "pathetic"]


def corpus(spark, n=900, seed=3):
    rng = random.Random(seed)
    words = [a + b for a in ("the", "ou", "ing", "ar", "ble", "st") for b in ("er", "on", "at", "es", "is")]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                bad = rng.choice(BAD)
                if rng.random() < 0.3:
                    bad = bad.replace("o", "0").replace("a", "а").replace("c", "с")
                w.insert(rng.randrange(len(w)), bad)
        elif i % 7 == 0:
            w.insert(3, "no moron here")
        docs.append((i, " ".join(w), i % 3))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels}


def test_fold():
    assert toxicity.fold("1D10T m0r0n ѕсum Scum$$$ it's 5!") == "idiot moron scum scum$$$ it's 5!"
    assert toxicity.fold("Mörôn ｍｏｒｏｎ 𝐦𝐨𝐫𝐨𝐧 a55 m.o.r.o.n m o r o n. U.S. no 15 x2") == "moron moron moron ass moron moron. u.s. no 15 x2"


def plain(lexicon, text):
    """The features by a loop over words, without an automaton."""
    folded = toxicity.fold(text or "")
    spared = set()
    for p in lexicon.phrases:
        for m in re.finditer(rf"(?<![^\W\d_]){re.escape(p)}(?![^\W\d_])", folded):
            spared |= set(range(*m.span()))
    total = 0.0
    for m in re.finditer(r"[^\W\d_]+", folded):
        word = m[0]
        entries = [(w, x) for e, x in lexicon.weights.items() for w in [e.rstrip("*")] if (word == w if "*" not in e else word.startswith(w) and word != w)]
        if entries:
            # the heaviest entry counts; a phrase spares it if it covers it
            w, x = max(entries, key=lambda t: t[1])
            if not set(range(m.start(), m.start() + len(w))) <= spared:
                total += x
    return math.log1p(total), math.log1p(100 * total / (folded.count(" ") + folded.count("\n") + 1))


def test_equals_plain_scorer(spark):
    docs, labels, _ = corpus(spark)
    learned = toxicity.learn(docs, labels)
    made = toxicity.Lexicon({"moron": 3.0, "scum": 2.5, "moro*": 2.0, "patheti*": 4.0, "äss": 1.0}, {"no moron", "scum here"}, (-1.0, 1.0, 1.0))
    rng = random.Random(6)
    words = ["moron", "m0r0n", "morons", "no", "scum", "here", "pathetic", "s.c.u.m", "ok", "x" * 40, "pathetically", "ｓｃｕｍ", "it's", "5!", "\n"]
    texts = [r.text for r in docs.limit(80).collect()] + [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(300)] + [None, ""]
    for lexicon in (learned, made):
        assert [lexicon.features(t) for t in texts] == [pytest.approx(plain(lexicon, t)) for t in texts]


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if toxicity.is_held_out(i)}
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert right >= 0.97 * len(held) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_held_out_labels_do_not_matter(spark):
    docs, labels, _ = corpus(spark, 300)
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = toxicity.learn(docs, labels), toxicity.learn(docs, flipped)
    assert a.weights == b.weights and a.phrases == b.phrases and a.model == pytest.approx(b.model)


def test_exceptions():
    lex = toxicity.Lexicon({"moron": 3.0}, {"no moron"}, (-1.0, 1.0, 1.0))
    assert lex.features("no moron here")[0] == 0 and lex.features("a moron no")[0] > 0
    assert lex.features("no moron, moron")[0] == pytest.approx(lex.features("x moron")[0])
    assert toxicity._uncovered([(3, 8, 1.0), (20, 25, 1.0)], [(0, 8)]) == [(20, 25, 1.0)]
    assert lex.features("oxymoronic") == (0.0, 0.0)


def test_edges(spark, edge_docs):
    _, labels, _ = corpus(spark, 30)
    rows = toxicity.classify(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and not [r for r in rows if r.doc_id is None][0].held_out
    assert toxicity.classify(edge_docs.limit(0), labels.limit(0)).count() == 0
