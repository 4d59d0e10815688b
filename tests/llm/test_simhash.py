import random
import re

import numpy as np
import xxhash

from plait.llm import simhash


def brute_print(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    up = {i: i for i, _ in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if i < j and (a ^ b).bit_count() <= 4:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in prints}


def test_golay_is_perfect():
    t = simhash.golay_table()
    assert (t >= 0).all() and (np.bincount(t) == 2048).all()


def test_keys_meet_within_four_bits():
    rng = random.Random(9)
    a = [rng.getrandbits(64) for _ in range(3000)]
    b = []
    for x in a:
        for bit in rng.sample(range(64), rng.randrange(5)):
            x ^= 1 << bit
        b.append(x)
    keys = []
    for v in (a, b):
        row, key = simhash.keys_of(np.array(v, dtype=np.uint64))
        sets = [set() for _ in v]
        for r, k in zip(row.tolist(), key.tolist()):
            sets[r].add(k)
        keys.append(sets)
    for x, y in zip(*keys):
        # exact+nearby keys are equal; index+index keys meet nearby+nearby ones but for the last bit
        assert any(k in y or k ^ 1 in y for k in x if not k & 1) or any(k ^ 1 in y for k in x if k & 1)


def test_fingerprints(prose):
    for t in [*prose, None, "", " \n", "One two", "a b c d", "A B c D e"]:
        assert simhash.fingerprint(t) == brute_print(t)


def test_query_equals_brute_force(spark, prose):
    rng = random.Random(2)
    texts = list(prose)
    for t in prose[:30]:
        w = t.split(" ")
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    texts += [None, "", "same copy here now"] + ["same copy here now"] * 40
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, fp int, component_id int")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    prints = [(i, brute_print(t)) for i, t in docs]
    want = brute_components(prints)
    assert len(got) == len(docs)
    for i, p in prints:
        assert got[i].fingerprint == f"{p:016x}" and got[i].component_id == want[i]


def test_dense_cluster_and_runs():
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    fps = list({centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(600)})
    forest = simhash.Forest()
    simhash._run_links(np.array(fps, dtype=np.uint64), np.arange(len(fps)), 4, forest)
    want = brute_components(list(enumerate(fps)))
    assert [forest.find(i) for i in range(len(fps))] == [want[i] for i in range(len(fps))]


def test_edges(spark, edge_docs):
    rows = simhash.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert {r.component_id for r in rows if r.doc_id in (0, 1, 2)} <= {0}
    assert simhash.near_duplicates(edge_docs.limit(0)).count() == 0
