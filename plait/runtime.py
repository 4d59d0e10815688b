"""Session helpers shared by every operator: shipping the package to executors and
materialising intermediate tables where all executors can read them."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_stages: list[tuple[SparkSession, str]] = []


#: Rows of an Arrow batch, unless the session says otherwise: texts and vectors are long rows, and a
#: batch is held in the JVM and in the worker at once.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that Python kernels can be
    imported there whatever the executors' own path holds, and keep Arrow batches small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # the default
        spark.conf.set(key, BATCH_ROWS)
    sc = spark.sparkContext
    if getattr(sc, "_plait_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="plait-")), "plait_src.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"plait/{p.relative_to(root)}")
        sc.addPyFile(archive)
    sc._plait_shipped = True


def trim() -> None:
    """Give a worker's free memory back to the system; workers live on between tasks."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(kernel):
    """A batch kernel that trims its worker's memory when its task ends."""

    def run(batches):
        yield from kernel(batches)
        trim()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``). Only a session on
    one machine may name none: a local one is made for it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        current = sc._jsc.sc().getCheckpointDir()
        path = current.get() if current.isDefined() else None
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="plait-shared-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage with a copy that
    outlives any executor. The tables go when the driver ends, or with :func:`cleanup`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/plait/{tag}-{unique()}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def stage_table(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and its path: a table that :func:`cleanup` leaves
    until the driver ends, for results that several steps read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/plait/stage-{tag}-{unique()}"
    df.write.option("compression", "zstd").parquet(path)
    _stages.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def unique() -> str:
    return uuid.uuid4().hex


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written() -> int:
    """How many tables :func:`materialise` has written and not yet deleted."""
    return len(_written)


def cleanup(first: int = 0) -> None:
    """Delete the tables that :func:`materialise` wrote in this process, from the ``first`` on."""
    _drop(_written, first)


def _drop(tables: list[tuple[SparkSession, str]], first: int) -> None:
    while len(tables) > first:
        spark, path = tables.pop()
        try:
            delete(spark, path)
        except Exception:  # the session may have ended already
            pass


atexit.register(lambda: (_drop(_written, 0), _drop(_stages, 0)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memory() -> dict[str, int]:
    """Bytes that this process holds now and has held at most."""
    import resource

    now = 0
    with open("/proc/self/statm") as f:
        now = int(f.read().split()[1]) * resource.getpagesize()
    return {"now": now, "most": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024}


def log(message: str, level: str = "info") -> None:
    """A line of the run's log, with the memory of the driver."""
    import logging

    getattr(logging.getLogger("plait"), level)("%s (%.0f MB)", message, memory()["now"] / 1e6)
