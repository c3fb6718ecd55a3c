"""Evaluation regions: which events and words lie in them, and times between anchors.

Regions, words and events meet by recording and cell of time, so a long recording is no single group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 3600.0


def cells(st: Column, ed: Column, cell: float) -> Column:
    return F.explode(F.sequence(F.floor(st / cell), F.floor(ed / cell)))


def in_region(events: DataFrame, regions: DataFrame, key: str, st: str, ed: str, *, slack: float = 1e-8, cell: float = CELL, outside: bool = False) -> DataFrame:
    """Events that lie within one of the regions (key, rst, red), give or take ``slack``; with ``outside``, all others."""
    dealt = regions.select(key, "rst", "red", cells(F.col("rst") - slack, F.col("red") + slack, cell).alias("_c"))
    at = F.floor(F.col(st) / cell)
    inside = (F.col("rst") - slack <= F.col(st)) & (F.col(ed) <= F.col("red") + slack)
    r = dealt.withColumnRenamed(key, "_k")
    return events.join(r, (F.col(key) == F.col("_k")) & (at == F.col("_c")) & inside, "left_anti" if outside else "left_semi")


def midpoint_in_region(words: DataFrame, regions: DataFrame, key: str, mid: str, *, cell: float = CELL, outside: bool = False) -> DataFrame:
    """Words whose middle lies in one of the regions, ends included; with ``outside``, all others."""
    return in_region(words.withColumn("_m", F.col(mid)), regions, key, "_m", "_m", slack=0.0, cell=cell, outside=outside).drop("_m")


def word_ranges(events: DataFrame, words: DataFrame, key: str, event: str, *, cell: float = CELL) -> DataFrame:
    """(key, event, first, last): the least and largest idx of words (key, idx, mid) whose middle lies in the event (st, ed)."""
    dealt = events.select(key, event, "st", "ed", cells(F.col("st"), F.col("ed"), cell).alias("_c"))
    at = words.select(F.col(key).alias("_k"), "idx", "mid", F.floor(F.col("mid") / cell).alias("_w"))
    hit = dealt.join(at, (F.col(key) == F.col("_k")) & (F.col("_c") == F.col("_w")) & F.col("mid").between(F.col("st"), F.col("ed")))
    return hit.groupBy(key, event).agg(F.min("idx").alias("first"), F.max("idx").alias("last"))


def between_anchors(df: DataFrame, key: list[str], idx: str, time: str) -> DataFrame:
    """``df`` with ``aligned``: its time, else one on the line between the nearest anchors, else that of the only side's."""
    w = Window.partitionBy(*key).orderBy(idx)
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    anchor = F.when(F.col(time).isNotNull(), F.struct(F.col(idx).alias("i"), F.col(time).alias("t")))
    rows = df.withColumn("_a", F.last(anchor, ignorenulls=True).over(back)).withColumn("_b", F.first(anchor, ignorenulls=True).over(on))
    a, b = F.col("_a"), F.col("_b")
    line = a["t"] + (b["t"] - a["t"]) * (F.col(idx) - a["i"]) / (b["i"] - a["i"])
    return rows.withColumn("aligned", F.coalesce(F.col(time), line, a["t"], b["t"])).drop("_a", "_b")
