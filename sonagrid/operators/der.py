"""Diarization error rate with the best mapping of speakers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..shared import stored
from . import intervals


def hungarian(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the assignment with the largest sum; only pairs with a positive gain are returned.

    Shortest augmenting paths with potentials, one row at a time.
    """
    n, m = gain.shape
    if n > m:
        return sorted((r, c) for c, r in hungarian(gain.T))
    cost = -gain
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            row = match[j]
            slack = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better] = slack[better]
            way[1:][better] = j
            free = np.where(used[1:], np.inf, least[1:])
            k = int(free.argmin()) + 1
            delta = free[k - 1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = k
            if not match[j]:
                break
        while j:
            match[j] = match[way[j]]
            j = way[j]
    return sorted((match[c] - 1, c - 1) for c in range(1, m + 1) if match[c] and gain[match[c] - 1, c - 1] > 0)


def best_mapping(pairs: DataFrame, key: list[str], weight: str = "ov") -> DataFrame:
    """(key..., ref, sys, weight): one-to-one pairs with the largest total weight among rows of (key..., ref, sys, weight).

    A key's speakers are few, whatever its length, so its rows are one array; keys are many, and pass a task in batches.
    """
    grouped = pairs.groupBy(*key).agg(F.collect_list(F.struct(F.col("ref").cast("string").alias("ref"), F.col("sys").cast("string").alias("sys"), F.col(weight).cast("double").alias("w"))).alias("_pairs"))
    mapped = StructType([StructField("ref", StringType()), StructField("sys", StringType()), StructField(weight, DoubleType())])
    schema = StructType([*[grouped.schema[k] for k in key], *mapped])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["_pairs"]
            ends, (refs, others, gains) = lists.offsets.to_numpy(), (c.to_pylist() for c in lists.values.flatten())
            at, out = [], ([], [], [])
            for k in range(len(lists)):
                rows = range(ends[k], ends[k + 1])
                for pair in mapping((refs[r], others[r], gains[r]) for r in rows):
                    at.append(k)
                    for column, item in zip(out, pair, strict=True):
                        column.append(item)
            kept = [batch[k].take(pa.array(at, pa.int64())) for k in key]
            kinds = (pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]], names=schema.names)

    return grouped.mapInArrow(run, schema)


def mapping(rows: Iterable[tuple[str | None, str | None, float | None]]) -> list[tuple[str, str, float]]:
    """Pairs (ref, sys, sum of weights) of the best assignment; where one side has one speaker it is looked up."""
    total: dict[tuple[str, str], float] = {}
    for ref, sys, w in rows:
        if ref is not None and sys is not None:
            total[ref, sys] = total.get((ref, sys), 0.0) + w
    refs, others = (sorted({p[side] for p in total}) for side in (0, 1))
    if min(len(refs), len(others)) <= 1:
        best = min(total, key=lambda p: (-total[p], p), default=None)
        return [(*best, total[best])] if best and total[best] > 0 else []
    gain = np.zeros((len(refs), len(others)))
    for (ref, sys), w in total.items():
        gain[refs.index(ref), others.index(sys)] = w
    return [(refs[a], others[b], float(gain[a, b])) for a, b in hungarian(gain)]


def co_occurrence(pieces: DataFrame, key: list[str]) -> DataFrame:
    """(key..., ref, sys, ov): the time that each pair of speakers shares, from ``intervals.atoms``."""
    rows = pieces.select(*key, (F.col("ed") - F.col("st")).alias("d"), F.explode("ref").alias("ref"), "sys")
    return rows.select(*key, "d", "ref", F.explode("sys").alias("sys")).groupBy(*key, "ref", "sys").agg(F.sum("d").alias("ov"))


def error_times(pieces: DataFrame, mapped: DataFrame, key: list[str]) -> DataFrame:
    """Seconds scored, missed, false and confused in each key."""
    d = F.col("ed") - F.col("st")
    sums = pieces.groupBy(*key).agg(
        F.sum(d * F.col("n_ref")).alias("scored"),
        F.sum(d * F.greatest(F.lit(0), F.col("n_ref") - F.col("n_sys"))).alias("miss"),
        F.sum(d * F.greatest(F.lit(0), F.col("n_sys") - F.col("n_ref"))).alias("fa"),
        F.sum(d * F.least("n_ref", "n_sys")).alias("both"),
    )
    right = mapped.groupBy(*key).agg(F.sum("ov").alias("right"))
    out = sums.join(right, key, "left")
    return out.select(*key, "scored", "miss", "fa", (F.col("both") - F.coalesce("right", F.lit(0.0))).alias("error"))


def percent(part: F.Column, whole: F.Column) -> F.Column:
    """100 * part / whole; 0 of 0 is 0, anything else of 0 is 100."""
    return F.when(whole == 0, F.when(part == 0, 0.0).otherwise(100.0)).otherwise(100.0 * part / F.when(whole != 0, whole))


def rates(times: DataFrame, key: list[str]) -> DataFrame:
    total = F.col("miss") + F.col("fa") + F.col("error")
    s = F.col("scored")
    return times.select(*key, "scored", percent(F.col("miss"), s).alias("ms"), percent(F.col("fa"), s).alias("fa"), percent(F.col("error"), s).alias("ser"), percent(total, s).alias("der"))


def der(ref: DataFrame, sys: DataFrame, key: list[str], uem: DataFrame | None = None, *, collar: float = 0.0, ignore_overlap: bool = False) -> DataFrame:
    """Miss, false-alarm, speaker and total error in percent for each key and, with null keys, over all.

    ``ref`` and ``sys``: key..., st, ed, speaker. Without ``uem`` each key's reference extent is scored; keys that only
    ``sys`` has are left out. Pieces, and the times of each key, are stored once, as several sums read them.
    """
    scored = uem if uem is not None else intervals.extent(ref, key)
    if collar:
        scored = intervals.subtract_collars(scored, ref, key, collar)
    if ignore_overlap:
        scored = intervals.subtract_overlap(scored, ref, key)
    pieces = stored(intervals.atoms(scored, ref, sys, key), "pieces")
    mapped = best_mapping(co_occurrence(pieces, key), key)
    times = stored(error_times(pieces, mapped, key), "times")
    whole = times.agg(*[F.sum(c).alias(c) for c in ("scored", "miss", "fa", "error")])
    return rates(times, key).unionByName(rates(whole, []), allowMissingColumns=True)
