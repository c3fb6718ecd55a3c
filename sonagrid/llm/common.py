"""What the operators of this package share: exact column picking, the shared folder, bounded broadcasts."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table of a few plain columns may be broadcast; with more, the same join shuffles.
BROADCAST_ROWS = 1_000_000
#: Bytes of one Arrow batch handed to Python, so that long texts do not add up to a whole partition.
BATCH_BYTES = 4 << 20

_LIBC = ctypes.CDLL(None)
_OWN_ROOT: list[str] = []
_STORED: set[str] = set()


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns called c0, c1, ... and their names, which may repeat or differ in case only."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), list(df.columns)


def trim() -> None:
    """Give freed memory back to the system: Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function over a task's batches, with what it freed given back at the end."""

    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return inner


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the columns ``names``, whatever else the table carries.

    Other columns may repeat a name or differ from one in case only; the first exact match counts.
    """
    flat, own = numbered(df)
    return flat.select(*[flat[f"c{own.index(n)}"].alias(n) for n in names])


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches where the user hasn't, and let Python workers import this package."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the driver and all executors share (spark.checkpoint.dir).

    Where none is set, a local master gets a temporary folder; on a cluster that is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN_ROOT:
            _OWN_ROOT.append(tempfile.mkdtemp(prefix="sonagrid-"))
        root = f"file://{_OWN_ROOT[0]}"
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _STORED.add(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there and outlives executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _STORED.discard(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` gave and that nothing reads any longer."""
    for df in tables:
        _delete(df.sparkSession, df.stored_at)


def step(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` returns, stored; the tables that it stored on the way are deleted."""
    before = set(_STORED)
    out = stored(make(), label)
    for path in _STORED - before - {out.stored_at}:
        _delete(out.sparkSession, path)
    return out


def purge(spark: SparkSession) -> None:
    """Delete what ``stored`` wrote in this process; results that still read it must be written out before."""
    for path in list(_STORED):
        _delete(spark, path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` stay below ``limit``, else as it is."""
    return F.broadcast(df) if rows <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
