import random

import numpy as np

from plait.llm import near_copies


def shingles(t, n=5):
    w = t.lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def corpus(n=60, copies=5, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(["the", "ou", "ing", "ar", "ble", "st", "er"]) for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(120, 400))) for _ in range(n)]
    pairs = []
    for i in range(0, n, 3):
        for _ in range(copies):
            w = texts[i].split()
            for _ in range(rng.randrange(1, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            pairs.append((i, len(texts)))
            texts.append(" ".join(w))
        texts.append(texts[i].upper())
    return texts, pairs


def test_groups(spark):
    texts, pairs = corpus()
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, part int")
    rows = {r.doc_id: r for r in near_copies.groups(df).collect()}
    assert len(rows) == len(texts)
    close = [(i, j) for i, j in pairs if jaccard(texts[i], texts[j]) >= 0.8]
    far = [i for i in range(60) if i % 3]
    assert sum(not rows[j].stays for _, j in close) >= 0.93 * len(close)
    assert all(rows[i].stays for i in far)
    # nothing goes without a copy at 0.8 that it hangs together with
    for j, r in rows.items():
        if not r.stays:
            assert max(jaccard(texts[j], texts[k]) for k, x in rows.items() if x.part == r.part and k != j) >= 0.8
    assert len({r.part for r in rows.values()}) == sum(r.stays for r in rows.values())


def test_a_question_a_class():
    import pyarrow as pa

    rng = random.Random(2)
    centre = rng.getrandbits(46)
    fp = np.array([centre] + [centre ^ (1 << rng.randrange(46)) ^ (1 << rng.randrange(46)) for _ in range(1500)], dtype=np.int64)
    node = np.arange(len(fp))
    low, high = (near_copies.nearby(fp >> s & (1 << 23) - 1) for s in (0, 23))
    r, i, j = np.nonzero((low[:, :, None] >= 0) & (high[:, None, :] >= 0))
    key = low[r, i] << 12 | high[r, j]
    by = np.argsort(key, kind="stable")
    batch = pa.RecordBatch.from_arrays([pa.array(key[by]), pa.array(fp[r][by]), pa.array(node[r][by])], ["key", "fp", "node"])
    got = {n: c for b in near_copies.centres(iter([batch.slice(at, 700) for at in range(0, batch.num_rows, 700)])) for n, _, c in zip(*(c.to_pylist() for c in b.columns))}
    # each asks one centre, and nearly all ask the true one or a copy next to it
    assert len(got) >= len(fp) - 1 and sum(c == 0 for c in got.values()) > 0.8 * len(fp)


def test_similar_sets():
    rng = random.Random(3)
    sets, every = near_copies.Sets(), []
    for i in range(40):
        every.append(np.unique(np.array([rng.randrange(60) for _ in range(rng.randrange(1, 120))], dtype=np.uint64)))
        sets.add(i, every[-1])
    for _ in range(100):
        h = np.unique(np.array([rng.randrange(60) for _ in range(rng.randrange(1, 120))], dtype=np.uint64))
        want = {i for i, x in enumerate(every) if len(np.intersect1d(x, h)) >= 0.8 * len(np.union1d(x, h))}
        got = sets.similar(h, 0.8)
        assert got in want if want else got is None


def test_edges(spark, edge_docs):
    rows = near_copies.groups(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert sum(r.stays for r in rows if r.doc_id in (0, 1, 2)) == 1
    assert near_copies.groups(edge_docs.limit(0)).count() == 0


def test_few_links_write_no_rounds(spark, monkeypatch):
    """Rounds of components write files in each task: a table with few links needs none of them."""
    rng = random.Random(8)
    docs = []
    for g in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for k in range(4):
            docs.append((10 * g + k, " ".join([*words[: 60 + k], f"x{g}{k}", *words[61 + k :]])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seen = []
    real = type(df).checkpoint
    monkeypatch.setattr(type(df), "checkpoint", lambda self, *a, **b: seen.append(1) or real(self, *a, **b))
    got = sorted((r.doc_id, r.part, r.stays) for r in near_copies.groups(df).collect())
    assert not seen
    assert len({p for _, p, _ in got}) == 6 and [d for d, _, s in got if s] == [10 * g for g in range(6)]
