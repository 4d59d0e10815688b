"""Small text formats: configuration, BED, identity tracks, MAF and alignment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_config(text: str) -> dict[str, str]:
    """``name: value`` lines after ``---``; ``#`` begins a comment, values may stand in double quotes."""
    out: dict[str, str] = {}
    begun = False
    for number, line in enumerate(text.splitlines(), 1):
        line = line.split("#", 1)[0].strip() if '"' not in line else line.strip()
        if not line or line.startswith("#"):
            continue
        if line == "---":
            begun = True
            continue
        if not begun:
            raise ValueError("configuration does not begin with ---")
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"line {number} of a configuration has no colon")
        value = value.strip()
        if value.startswith('"'):
            end = value.find('"', 1)
            if end < 0:
                raise ValueError(f"line {number} of a configuration has an open quote")
            value = value[1:end]
        if name.strip() in out:
            raise ValueError(f"configuration sets {name.strip()} twice")
        out[name.strip()] = value
    return out


def write_config(values: dict) -> str:
    """The text that :func:`parse_config` reads back."""

    def shown(v) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (list, tuple)):
            return ", ".join(map(str, v))
        return f'"{v}"' if isinstance(v, str) else str(v)

    return "---\n" + "".join(f"{k}: {shown(v)}\n" for k, v in values.items())


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, begin, end, name) of lines with four columns or more; track and browser lines are left out."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where("value != '' and not value rlike '^(track|browser|#)'").select(f.alias("f"))
    short = F.raise_error(F.lit("a BED line of fewer than four columns"))
    return rows.select(F.when(F.size("f") >= 4, F.col("f")[0]).otherwise(short).alias("chrom"), F.col("f")[1].cast("long").alias("begin"), F.col("f")[2].cast("long").alias("end"), F.col("f")[3].alias("name"))


def read_identity(spark: SparkSession, path: str) -> DataFrame:
    """(value) of an identity track, a whole number a line."""
    return spark.read.text(path).where("trim(value) != ''").select(F.trim("value").cast("long").alias("value"))


def maf_lines(blocks: DataFrame) -> DataFrame:
    """(block, text) of MAF blocks from (block, pos, name1, at1, base1, size1, name2, at2, base2, size2); a
    gap has null at and base. A side of gaps alone begins at its sequence's size."""
    side = lambda i: F.concat(F.lit("s\t"), F.first(f"name{i}"), F.lit("\t"), F.coalesce(F.min(f"at{i}"), F.first(f"size{i}")).cast("string"), F.lit("\t"), F.count(f"at{i}").cast("string"), F.lit("\t+\t"), F.first(f"size{i}").cast("string"), F.lit("\t"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(f"base{i}", F.lit("-")).alias("b")))), lambda x: x["b"]), ""))
    return blocks.groupBy("block").agg(F.concat(F.lit("a\n"), side(1), F.lit("\n"), side(2), F.lit("\n")).alias("text"))


def subalignment_lines(alignment: DataFrame, places1: DataFrame, places2: DataFrame) -> DataFrame:
    """(aln_id, pos, text): six columns a pair, the first place (path, step, base) of each node; ``-`` for
    gaps. ``places`` are (node_id, path_id, step, label)."""
    first = lambda p, i: p.groupBy("node_id").agg(F.min(F.struct("path_id", "step", "label")).alias(f"p{i}")).withColumnRenamed("node_id", f"n{i}")
    rows = alignment.join(first(places1, 1), "n1", "left").join(first(places2, 2), "n2", "left")
    cell = lambda i, f: F.coalesce(F.col(f"p{i}.{f}").cast("string"), F.lit("-"))
    return rows.select("aln_id", "pos", F.concat_ws("\t", *[cell(i, f) for i in (1, 2) for f in ("path_id", "step", "label")]).alias("text"))
