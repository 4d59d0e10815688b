"""A run from sequences and a tree to a graph, one Spark task per group, restartable by table.

A job is a set of sequences with its own tree. Jobs are rows; each is aligned in one task, and its
result bears its digest. :func:`run_to` writes results to a table, so that a restart aligns only what is
missing there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.functions.sequence import names_digest
from plait.parameters import Parameters
from plait.plans import progressive
from plait.runtime import ship
from plait.sources import newick

RESULT = "digest string, job string, names array<string>, labels array<string>, src array<long>, dst array<long>, paths array<array<long>>"


def digest(names: list[str]) -> str:
    """Name of a subproblem: it depends on its sequences' names alone."""
    return hashlib.sha256("\0".join(sorted(names)).encode()).hexdigest()[:16]


def jobs_of(sequences: DataFrame, trees: DataFrame | None = None) -> DataFrame:
    """(job, sequences, newick) from (job, name, seq) and (job, newick); without a tree, in order of name."""
    rows = sequences.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("name", "seq"))).alias("sequences"))
    return rows.join(trees, "job", "left") if trees is not None else rows.withColumn("newick", F.lit(None).cast("string"))


def _named(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("digest", names_digest(F.transform("sequences", lambda x: x["name"])))


def run(jobs: DataFrame, parameters: Parameters = Parameters(), finished: DataFrame | None = None, again: bool = True) -> DataFrame:
    """Results of jobs (job, sequences, newick). Jobs whose digest stands in ``finished`` are not run again;
    if ``again``, its rows are part of the result."""
    ship(jobs.sparkSession)
    scoring = parameters.scoring()
    todo = _named(jobs)
    if finished is not None:
        todo = todo.join(finished.select("digest"), "digest", "left_anti")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, job, seqs, tree in zip(*(b.column(i).to_pylist() for i in range(4))):
                g = progressive.align({x["name"]: x["seq"] for x in seqs}, newick.parse(tree) if tree else None, scoring)
                src, dst = zip(*sorted(g.edges)) if g.edges else ((), ())
                one = [[name], [job], [list(g.paths)], [g.labels], [list(src)], [list(dst)], [list(g.paths.values())]]
                types = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(one, types)], ["digest", "job", "names", "labels", "src", "dst", "paths"])

    done = todo.select("digest", F.col("job").cast("string"), "sequences", "newick").mapInArrow(align, RESULT)
    return finished.unionByName(done) if finished is not None and again else done


def run_to(jobs: DataFrame, path: str, parameters: Parameters = Parameters()) -> DataFrame:
    """The results of jobs, from a table at ``path`` that bears those of earlier runs: what is missing there is
    aligned and added."""
    spark = jobs.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    old = spark.read.schema(RESULT).parquet(path) if there else None
    run(jobs, parameters, old, again=False).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path).join(_named(jobs).select("digest"), "digest", "left_semi").select(*[c.split()[0] for c in RESULT.split(", ")])


def info(results: DataFrame) -> DataFrame:
    """(digest, text): a line of JSON per subproblem."""
    line = F.to_json(F.struct(F.col("digest").alias("subproblem"), "job", F.col("names").alias("sequences"), F.size("labels").alias("nodes")))
    return results.select("digest", line.alias("text"))
