"""Groups of near copies against brute force over all pairs."""

import random

from plait.llm import near_copies
from tests.llm.test_near_copies import jaccard, shingles

WORDS = [f"w{i}" for i in range(5000)]


def zipf(rng, n):
    return [WORDS[min(int(rng.paretovariate(0.7)) - 1, 4999)] for _ in range(n)]


def brute(texts):
    """The component of each text over all pairs at 0.8."""
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= 0.8 * (len(a) + len(sets[j]) - both):
                up[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def parts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(near_copies.groups(df.repartition(4)).collect())
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    return rows


def same(labels, others):
    return len(set(labels)) == len(set(others)) == len(set(zip(labels, others)))


def test_dense_cluster_is_one_part(spark):
    # copies of one text that drift apart: many share keys, few are at 0.8 of one another
    rng = random.Random(3)
    texts = [" ".join(zipf(rng, 300))]
    for _ in range(500):
        w = rng.choice(texts[-60:]).split()
        for _ in range(rng.randrange(2, 8)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    want = brute(texts)
    got = parts(spark, texts)
    assert same([r.part for r in got], want)
    assert sum(r.stays for r in got) == len(set(want))


def test_appended_and_truncated_copies(spark):
    rng = random.Random(4)
    texts = []
    for i in range(150):
        w = zipf(rng, rng.randrange(150, 1000))
        more = zipf(rng, int(len(w) * rng.uniform(0.02, 0.3)))
        texts += [" ".join(w), " ".join(w + more if i % 3 == 0 else more + w if i % 3 == 1 else w[: len(w) - len(more)])]
    close = sum(jaccard(texts[i], texts[i + 1]) >= 0.8 for i in range(0, 300, 2))
    assert 80 < close < 140
    assert same([r.part for r in parts(spark, texts)], brute(texts))


def test_repeated_passage(spark):
    # sets, not counts of shingles, decide
    rng = random.Random(5)
    texts = []
    for r in (1, 4, 5, 20):
        body, passage = rng.sample(WORDS, 104), rng.sample(WORDS, 54)
        texts += [" ".join(body + passage), " ".join(body + passage * r + [str(r)])]
    want = brute(texts)
    assert len(set(want)) == 4
    assert same([r.part for r in parts(spark, texts)], want)


def test_rows_without_id(spark):
    rng = random.Random(6)
    w = rng.sample(WORDS, 200)
    other = rng.sample(WORDS, 200)
    texts = [(None, " ".join(w)), (None, " ".join([*w, "end"])), (None, " ".join(other)), (7, " ".join(["start", *other]))]
    rows = near_copies.groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len({r.part for r in rows}) == 2
    assert sum(r.stays for r in rows) == 2 and [r.stays for r in rows if r.doc_id == 7] == [True]
