import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from plait.llm import packing
from tests.llm.conftest import EDGE_TEXTS

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_equals_library(prose):
    library, own = Tokenizer.from_file(PATH), packing.encoder(PATH)
    rng = random.Random(3)
    odd = ["".join(chr(rng.choice([rng.randrange(0, 127), rng.randrange(128, 592), 10, 32, 160])) for _ in range(60)) for _ in range(300)]
    for t in [x or "" for x in EDGE_TEXTS] + prose + odd:
        assert own(t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_bound_and_bins():
    rng = np.random.default_rng(4)
    for cap in (10, 64, 1024):
        for _ in range(60):
            x = rng.integers(1, cap + 1, rng.integers(1, 80))
            which, offset, fill = packing.best_fit_decreasing(x, cap)
            assert fill.max() <= cap and fill.sum() == x.sum()
            low = packing.bound(x, cap)
            assert -(-x.sum() // cap) <= low <= len(fill) <= 1.5 * low + 1
    # three items above half, which only a threshold function sees
    assert packing.bound(np.array([6, 6, 6]), 10) == 3
    # brute force: the bound never exceeds the optimum
    def optimum(items, cap):
        best = [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + items[i] <= cap:
                    go(i + 1, bins[:j] + [bins[j] + items[i]] + bins[j + 1 :])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best[0]

    for _ in range(60):
        x = sorted(rng.integers(1, 13, rng.integers(1, 8)).tolist(), reverse=True)
        assert packing.bound(np.array(x), 12) <= optimum(x, 12)


def _check(rows, docs, library, capacity=1024):
    bins, by_doc = {}, {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for spans in bins.values():
        end = 0
        for at, n in sorted(spans):
            assert at == end
            end += n
        assert end <= capacity
    for i, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert sum(r.length for r in mine) == len(ids)
        for r in mine:
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
        assert all(r.length == capacity for r in mine[1:])
    return len(bins)


def test_pack_documents(spark, prose):
    library = Tokenizer.from_file(PATH)
    texts = prose * 12 + ["word " * 5000, None, ""]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", packing.F.lit(1))
    rows = packing.pack_documents(df, PATH).collect()
    n = _check(rows, docs, library)
    low = packing.bound(np.array([r.length for r in rows]), 1024)
    assert low <= n <= 1.02 * low + 2
    assert all(r.part_bins >= r.part_bound for r in rows)


def test_edges(spark, edge_docs):
    rows = packing.pack_documents(edge_docs, PATH).collect()
    assert {r.doc_id for r in rows} == {*range(len(EDGE_TEXTS)), None}
    assert len([r for r in rows if r.doc_id == 3]) == 3
    assert packing.pack_documents(edge_docs.limit(0), PATH).count() == 0
