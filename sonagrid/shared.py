"""The folder that the driver and all executors share, and tables stored there to end a lineage."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_ROOT: list[str] = []
_WRITTEN: set[str] = set()


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in spark.checkpoint.dir; where that isn't set, a local master gets a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN_ROOT:
            _OWN_ROOT.append(tempfile.mkdtemp(prefix="sonagrid-"))
        root = f"file://{_OWN_ROOT[0]}"
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_lines(lines: DataFrame, label: str) -> str:
    """The path of a text table of ``lines`` (value)."""
    path = shared_path(lines.sparkSession, label)
    lines.select("value").write.text(path)
    return path


def dealt(df: DataFrame, key: list[str], weight: Column, most: int) -> DataFrame:
    """``df`` by ``key`` in partitions that hold about ``most`` of the sum of ``weight``, which is taken first.

    Spark puts partitions together by their compressed bytes. Where rows become many behind the shuffle, as words of a
    text do, that makes tasks whose memory grows with the table; partitions of a given number stay as they are.
    """
    total = df.agg(F.sum(weight)).first()[0] or 0
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(total / most)), *key)


def purge(spark: SparkSession) -> int:
    """Delete all paths that this process was given so far, and say how many; results that still read them must be written out before."""
    paths, hadoop = sorted(_WRITTEN), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        target = hadoop(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _WRITTEN.difference_update(paths)
    return len(paths)
