"""Alignments as tables: run lengths, CIGARs, scores and alignments that shared nodes imply.

An alignment table has (aln_id, pos, n1, n2), in order of pos, with null for a gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def operation(n1: Column, n2: Column, equal: Column | None = None) -> Column:
    """I where side 1 has a gap, D where side 2 has; else M, or = and X if ``equal`` tells them apart."""
    match = F.lit("M") if equal is None else F.when(equal, "=").otherwise("X")
    return F.when(n1.isNull(), "I").when(n2.isNull(), "D").otherwise(match)


def run_lengths(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, run, value, n): maximal runs of equal values in order, numbered from 0."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(0))
    runs = df.select(key, order, value, new.alias("new")).withColumn("run", F.sum("new").over(w))
    return runs.groupBy(key, "run", value).agg(F.count("*").alias("n"))


def cigar(alignment: DataFrame, labels1: DataFrame | None = None, labels2: DataFrame | None = None) -> DataFrame:
    """(aln_id, cigar); with the label tables (node_id, label) of both sides, = and X for M."""
    rows = alignment
    if labels1 is not None and labels2 is not None:
        rows = rows.join(labels1.select(F.col("node_id").alias("n1"), F.col("label").alias("l1")), "n1", "left").join(labels2.select(F.col("node_id").alias("n2"), F.col("label").alias("l2")), "n2", "left")
        op = operation(F.col("n1"), F.col("n2"), F.col("l1") == F.col("l2"))
    else:
        op = operation(F.col("n1"), F.col("n2"))
    runs = run_lengths(rows.select("aln_id", "pos", op.alias("op")), "aln_id", "pos", "op")
    return join_runs(runs, "aln_id")


def join_runs(runs: DataFrame, key: str) -> DataFrame:
    """(key, cigar) from (key, run, op, n)."""
    parts = F.array_sort(F.collect_list(F.struct("run", F.concat(F.col("n").cast("string"), F.col("op")).alias("s"))))
    return runs.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["s"]), "").alias("cigar"))


def explode_cigar(cigars: DataFrame, key: str = "aln_id") -> DataFrame:
    """(key, run, op, n, begin1, begin2) of every run of a CIGAR, with where it begins on each side."""
    pairs = F.regexp_extract_all("cigar", F.lit(r"([0-9]+)([MIDX=])"), 0)
    runs = cigars.select(key, F.posexplode(pairs).alias("run", "s")).select(key, "run", F.substring("s", -1, 1).alias("op"), F.expr("cast(substring(s, 1, length(s) - 1) as bigint)").alias("n"))
    w = Window.partitionBy(key).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    on = lambda ops: F.coalesce(F.sum(F.when(F.col("op").isin(ops), F.col("n")).otherwise(0)).over(w), F.lit(0))
    return runs.select(key, "run", "op", "n", on(["M", "=", "X", "D"]).alias("begin1"), on(["M", "=", "X", "I"]).alias("begin2"))


def score(runs: DataFrame, key: str, match: int, mismatch: int, opens: list[int], extends: list[int], merge_gaps: bool = True) -> DataFrame:
    """(key, score) of alignments from (key, run, op, n) with =, X, I and D. With ``merge_gaps``, an I run
    beside a D run is one gap of the sum of their lengths."""
    gap = lambda n: F.greatest(*[-(F.lit(o) + F.lit(e) * n) for o, e in zip(opens, extends)]) if len(opens) > 1 else -(F.lit(opens[0]) + F.lit(extends[0]) * n)
    kind = F.when(F.col("op").isin("I", "D"), "G" if merge_gaps else F.col("op")).otherwise(F.col("op"))
    w = Window.partitionBy(key).orderBy("run")
    merged = runs.withColumn("kind", kind).withColumn("new", F.coalesce((F.col("kind") != F.lag("kind").over(w)).cast("int"), F.lit(0))).withColumn("r", F.sum("new").over(w))
    merged = merged.groupBy(key, "r", "kind").agg(F.sum("n").alias("n"))
    worth = F.when(F.col("kind") == "=", F.col("n") * match).when(F.col("kind") == "X", F.col("n") * -mismatch).when(F.col("kind") == "M", F.lit(0)).otherwise(gap(F.col("n")))
    return merged.groupBy(key).agg(F.sum(worth).cast("long").alias("score"))


def induced(steps: DataFrame, pairs: DataFrame) -> DataFrame:
    """(path1, path2, step1, step2) of the alignment that shared nodes imply for acyclic paths: nodes on
    both paths are columns, others gaps. ``pairs`` is (path1, path2)."""
    one = pairs.join(steps.select(F.col("path_id").alias("path1"), F.col("step").alias("step1"), "node_id"), "path1")
    two = pairs.join(steps.select(F.col("path_id").alias("path2"), F.col("step").alias("step2"), "node_id"), "path2")
    return one.join(two, ["path1", "path2", "node_id"], "full_outer").select("path1", "path2", "step1", "step2")


def induced_summary(aligned: DataFrame) -> DataFrame:
    """(path1, path2, shared, only1, only2) of induced alignments."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return aligned.groupBy("path1", "path2").agg(
        count(F.col("step1").isNotNull() & F.col("step2").isNotNull()).alias("shared"), count(F.col("step2").isNull()).alias("only1"), count(F.col("step1").isNull()).alias("only2")
    )


def truth_metrics(compared: DataFrame, key: str) -> DataFrame:
    """(key, match_rate, completeness, accuracy) from (key, n1, n2, matches, mismatches, aligned, truth)."""
    total = {c: F.sum(c) for c in ("n1", "n2", "matches", "mismatches", "aligned", "truth")}
    return compared.groupBy(key).agg(
        (2.0 * total["matches"] / (total["n1"] + total["n2"])).alias("match_rate"),
        F.try_divide(total["aligned"].cast("double"), total["truth"]).alias("completeness"),
        F.try_divide(total["matches"].cast("double"), total["matches"] + total["mismatches"]).alias("accuracy"),
    )
