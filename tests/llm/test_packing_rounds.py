"""Rounds of the exchange on thousands of pieces."""

import numpy as np
from pyspark.sql import functions as F

from plait.llm import packing
from tests.llm.test_packing import PATH


def pack(spark, lengths, **kw):
    cut = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(cut, **kw).toPandas()
    assert sorted(rows["doc_id"]) == list(range(len(lengths)))
    assert rows.groupby("sequence_id")["length"].sum().max() <= 1024
    return rows["sequence_id"].nunique(), packing.bound(np.array(lengths), 1024)


def test_thousands_of_empty_texts(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "").alias("text"))
    rows = packing.pack_documents(docs, PATH).collect()
    assert len(rows) == 3000 and len({r.sequence_id for r in rows}) == 3


def test_many_one_token_pieces(spark):
    rng = np.random.default_rng(1)
    n, low = pack(spark, [*rng.integers(2, 400, 20_000), *[1] * 10_000])
    assert low <= n <= low + 1
    n, low = pack(spark, [1] * 120_000)  # more than a partition holds
    assert n == low


def test_partition_gives_all_that_it_has_too_much():
    lengths = np.random.default_rng(2).integers(205, 512, 4000)
    rows = packing.pd.DataFrame({"doc_id": range(4000), "piece": 0, "start": 0, "length": lengths, "ids_crc32": 0, "part": 0})
    out = packing._pack_part(rows, 1024, 0, False)
    over = int(out["part_bins"][0] - out["part_bound"][0])
    fill = out.groupby("sequence_id")["length"].sum()
    assert over > 3
    assert out.loc[out["given"], "sequence_id"].nunique() == min(over + 1, int((fill < 1024).sum()))


def test_null_and_repeated_ids_by_the_thousand(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).alias("doc_id"), F.lit("a b").alias("text"))
    rows = packing.pack_documents(docs, PATH).collect()
    tokens = rows[0].length
    assert len(rows) == 4000 and sum(r.doc_id is None for r in rows) == 2666
    assert len({r.sequence_id for r in rows}) == -(-4000 // (1024 // tokens))
    # all are one kind of row, and still no part holds more than its share
    cut = packing.materialise(packing.pieces(docs, PATH), "cut")
    sizes = packing.pack(cut, part_rows=500).groupBy((F.col("sequence_id") / 2**22).cast("long")).count().toPandas()
    assert sizes["count"].max() < 2000
