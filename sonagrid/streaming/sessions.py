"""Intervals from streams: an addition of Spark's own; what it is modelled on is batch only.

The same expressions run on a bounded table, so the batch query tests what the stream computes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged_sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(key, st, ed, n): events of a key less than ``gap`` apart, put together; ``late`` is a stream's watermark.

    State is one row for each open session; a session is given out once the watermark has passed its end.
    """
    rows = events.withWatermark(time, late) if late else events
    out = rows.groupBy(F.col(key), F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("st"), F.col("w.end").alias("ed"), "n")
