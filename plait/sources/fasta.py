"""FASTA reader and writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of every record. Each file is read as one text, so that a record never spans tasks and
    several files are read in parallel; a name ends at the first white space. Errors: text before the
    first header, no record at all, a name twice, lines of a record that grow, or unequal ones inside."""
    files = spark.read.text(path, wholetext=True)
    records = files.select(F.explode(F.split(F.concat(F.lit("\n"), "value"), "\n>")).alias("r"))
    parsed = records.select(F.split("r", "\r?\n").alias("lines")).select(
        F.regexp_extract(F.col("lines")[0], r"^(\S*)", 1).alias("name"), F.filter(F.slice("lines", F.lit(2), F.size("lines")), lambda x: x != "").alias("body"), F.col("lines")[0].alias("head")
    )
    lead = (F.col("head") == "") & (F.size("body") == 0)
    bad = (F.col("head") == "") & (F.size("body") > 0)
    first = F.length(F.col("body")[0])
    inner = F.exists(F.slice("body", 1, F.greatest(F.size("body") - 1, F.lit(0))), lambda x: F.length(x) != first)
    last = F.coalesce(F.length(F.try_element_at("body", F.lit(-1))) > first, F.lit(False))
    checked = F.when(bad, F.raise_error(F.lit("FASTA text does not begin with a header"))).when(inner | last, F.raise_error(F.concat(F.lit("uneven lines in FASTA record "), "name"))).otherwise(F.array_join("body", ""))
    out = parsed.where(~lead).select("name", checked.alias("seq"))
    twice = F.count("*").over(Window.partitionBy("name")) > 1
    return out.select("name", F.when(twice, F.raise_error(F.concat(F.lit("FASTA name twice: "), "name"))).otherwise(F.col("seq")).alias("seq"))


def write(sequences: DataFrame, path: str, width: int = 80) -> None:
    """Records of ``(name, seq)`` with lines of ``width``; a text file a task."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    sequences.select(F.concat(F.lit(">"), "name", F.lit("\n"), body)).write.text(path)
