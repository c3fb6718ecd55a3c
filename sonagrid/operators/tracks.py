"""Boxes in frames: suppression, tracking, batches. Greedy by nature, so grouped pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo, hi = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.prod(np.clip(hi - lo, 0, None), axis=2)
    area = lambda x: np.prod(x[:, 2:] - x[:, :2], axis=1)
    return both / np.maximum(area(a)[:, None] + area(b)[None] - both, 1e-12)


def kinds(df: DataFrame, key: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in key)


def nms(df: DataFrame, key: list[str], box: str, score: str, iou: float = 0.5, top_k: int = -1, candidates: int = 200) -> DataFrame:
    """(key..., box, score, rank): of the best ``candidates`` boxes of a key those that overlap no better one.

    Of boxes with one score the least by coordinates is better.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.assign(_b=g[box].map(tuple)).sort_values([score, "_b"], ascending=[False, True], kind="stable").head(candidates)
        m = iou_matrix(x := np.stack([np.asarray(b, float) for b in g[box]]), x)
        keep: list[int] = []
        for i in range(len(g)):
            if all(m[i, k] <= iou for k in keep):
                keep.append(i)
                if 0 < top_k <= len(keep):
                    break
        return g.iloc[keep][[*key, box, score]].assign(rank=np.arange(1, len(keep) + 1, dtype=np.int32))

    return df.select(*key, box, score).groupBy(*key).applyInPandas(run, f"{kinds(df, key)}`{box}` array<double>, `{score}` double, rank int")


def track_boxes(df: DataFrame, key: list[str], frame: str, box: str, max_gap: int = 10, iou: float = 0.5, min_track: int = 10, min_size: float = 1.0) -> DataFrame:
    """(key..., track, frame, box): boxes followed through frames, gaps filled by interpolation.

    A track goes on with the first box that overlaps its last one enough within ``max_gap`` frames; tracks of at most
    ``min_track`` boxes or boxes of a smaller mean side than ``min_size`` are left out.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rest = [(int(f), np.asarray(b, float)) for f, b in g.sort_values(frame, kind="stable")[[frame, box]].itertuples(index=False)]
        out, number = [], 0
        while rest:
            track = [rest.pop(0)]
            k = 0
            while k < len(rest):
                gap = rest[k][0] - track[-1][0]
                if gap > max_gap:
                    break
                if gap > 0 and iou_matrix(rest[k][1][None], track[-1][1][None])[0, 0] > iou:
                    track.append(rest.pop(k))
                    continue
                k += 1
            if len(track) <= min_track:
                continue
            f, b = np.array([t[0] for t in track]), np.stack([t[1] for t in track])
            every = np.arange(f[0], f[-1] + 1)
            boxes = np.stack([np.interp(every, f, b[:, i]) for i in range(4)], axis=1)
            if max((boxes[:, 2] - boxes[:, 0]).mean(), (boxes[:, 3] - boxes[:, 1]).mean()) > min_size:
                out += [(*[g[x].iloc[0] for x in key], number, int(i), v.tolist()) for i, v in zip(every, boxes, strict=True)]
                number += 1
        return pd.DataFrame(out, columns=[*key, "track", frame, box])

    return df.select(*key, frame, box).groupBy(*key).applyInPandas(run, f"{kinds(df, key)}track int, `{frame}` int, `{box}` array<double>")


def length_batches(df: DataFrame, key: list[str], length: str, ties: list[str], budget: int) -> DataFrame:
    """``df`` with ``batch``, from 0: rows by falling length, cut so that a batch has as many as its first length goes into budget.

    A task gets a key's number of rows of each length only: between two lengths batches are of one size, so where the
    first one begins there says where all do. A row's place is counted among rows of its key and length, in the order of
    ``ties``. A null length is 0; a batch has a row at least.
    """
    own = {k: f"_k{i}" for i, k in enumerate(key)}
    rows = df.withColumn("_l", F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("long"))
    counts = rows.groupBy(*[F.col(k).alias(v) for k, v in own.items()], "_l").agg(F.count(F.lit(1)).alias("_n"))
    kept = [*own.values(), "_l"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out, place, at, number = [], 0, 0, 0
        g = g.sort_values("_l", ascending=False, ignore_index=True)
        for long, n in zip(g["_l"].tolist(), g["_n"].tolist(), strict=True):
            size = max(1, budget // max(1, long))
            out.append((place, at, number, size))
            place += n
            begun = -(-(place - at) // size) if at < place else 0
            at, number = at + begun * size, number + begun
        return pd.concat([g[kept], pd.DataFrame(out, columns=["_first", "_at", "_batch", "_size"])], axis=1)

    kinds_ = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in kept)
    starts = counts.groupBy(*own.values()).applyInPandas(run, f"{kinds_}, _first long, _at long, _batch long, _size long").withColumnRenamed("_l", "_of")
    same = F.col("_l") == F.col("_of")
    for k, v in own.items():
        same = same & F.col(k).eqNullSafe(F.col(v))
    place = F.col("_first") + F.row_number().over(Window.partitionBy(*key, "_l").orderBy(*ties)) - 1
    ahead = place - F.col("_at")
    batch = F.col("_batch") + F.when(ahead < 0, -1).otherwise(F.floor(ahead / F.col("_size")))
    return rows.join(starts, same).withColumn("batch", batch.cast("int")).select(*df.columns, "batch")
