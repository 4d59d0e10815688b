import random

import pytest

import corpus_pipeline
from plait.llm import pii


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = ["".join(rng.choice(["the", "ou", "ing", "ar", "ble", "st", "er"]) for _ in range(rng.randrange(1, 4))) for _ in range(800)]

    def prose(n):
        return "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randrange(4, 15))) + "." for _ in range(n))

    shared = "First shared line here.\nSecond shared line here.\nThird shared line here."
    docs, labels = [], []
    for i in range(240):
        t = prose(rng.randrange(6, 20))
        good = 1
        if i % 8 == 7:
            t, good = t.upper().replace(" ", "!!! "), 0
        elif i % 10 == 3:
            t += "\n" + shared
        elif i % 10 == 4:
            t += f"\nmail me{i}@mail.example.com or +1 (555) 010-{i:04d}."
        docs.append((i, t, "en", f"src{i % 3}", len(t)))
        labels.append((i, good, 0))
    for i in range(240, 260):  # near copies of the first documents
        w = docs[i - 240][1].split()  # on one line, so that no window of lines is repeated
        w[3] = "changed"
        t = " ".join(w)
        docs.append((i, t, "en", "copy", len(t)))
    docs += [(260, None, "en", "odd", None), (261, "", None, "odd", 0), (None, prose(5), "en", "odd", 1), (5, docs[5][1], "en", "repeat", 1)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        assert k == 4 or docs.columns == columns
    ids = lambda name: [r.doc_id for r in kept[name]]
    bad = {i for i in range(240) if i % 8 == 7}
    assert len(bad & set(ids("quality"))) <= 2 and len(set(range(240)) - bad - set(ids("quality"))) <= 3
    assert sorted(map(str, ids("lines"))) == sorted(map(str, ids("quality")))
    assert sum("Second shared line here." in (r.text or "") for r in kept["lines"]) == 1
    gone = set(range(240, 260)) & set(ids("near_duplicates"))
    assert len(gone - {i + 240 for i in bad}) <= 3 and set(ids("near_duplicates")) >= {i for i in ids("lines") if i is not None and i < 240}
    assert ids("near_duplicates").count(5) == 1
    for r in kept["privacy"]:
        f = pii.find(r.text)
        assert not f["email"] and not f["phone"]
        assert r.text is None or r.n_chars == len(r.text)
    assert set(ids("packing")) == set(ids("privacy"))


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        end = 0
        for at, n in sorted(spans):
            assert at == end
            end += n
        assert end <= 1024
    assert len(bins) <= sum(r.length for r in rows) // 1024 + 2


CLASHING = ("n", "n_lines", "n_removed", "nats", "score", "threshold", "keep", "trusted", "t", "row", "gone", "gone_id", "gone_t", "part", "stays", "node", "label", "gram", "block", "lines", "d", "length", "piece", "size", "first", "host", "k")


def test_clashing_names_in_every_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40 or doc_id >= 240 or doc_id is null")
    odd = docs.selectExpr("*", *(f"doc_id as `{c}`" for c in CLASHING))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        # a stage deletes what the one before left in the shared folder
        rows = [(r.doc_id, r.text) for r in stage(spark, docs, sf_dir).collect()]
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns, name
        got = out.collect()
        key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
        assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(rows, key=key), name
        assert all(r[c] == r.doc_id for r in got for c in CLASHING), name
    packing = corpus_pipeline.STAGES[-1][1]
    n = packing(spark, odd, sf_dir).count()
    assert n == packing(spark, docs, sf_dir).count() > 0


def test_empty_and_very_long(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(4)
    long = "\n".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(9999)) for _ in range(20)) for _ in range(20_000))
    one = spark.createDataFrame([(1, long, "en", "s", len(long)), (2, long + " end", "en", "s", 1), (3, None, None, None, None), (4, " \n\t", "en", "s", 3)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        got = stage(spark, one, sf_dir).collect()
        want = {"quality": {1, 2, 3, 4}, "lines": {1, 2, 3, 4}, "near_duplicates": {1, 3}, "privacy": {1, 2, 3, 4}, "packing": {1, 2, 3, 4}}[name]
        assert {r.doc_id for r in got} == want, name
