"""Column expressions over numeric arrays, in doubles."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body or a function within it uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(x: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(x), lambda v: v * v)))


def cosine(a: Column, b: Column, eps: float = 0.0) -> Column:
    """0 with a zero vector; with ``eps`` each norm is at least that."""
    if eps:
        return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def l2_normalised(x: Column) -> Column:
    return let(norm(x), lambda n: F.transform(doubles(x), lambda v: F.when(n == 0, 0.0).otherwise(v / n)))


def shares(x: Column) -> Column:
    """Items over their sum."""
    return let(x, lambda e: let(total(e), lambda all_: F.transform(e, lambda v: v / all_)))


def softmax(x: Column, temperature: float = 1.0) -> Column:
    return let(F.array_max(doubles(x)), lambda top: shares(F.transform(doubles(x), lambda v: F.exp((v - top) / temperature))))


def sharpen(p: Column, temperature: float) -> Column:
    return shares(F.transform(doubles(p), lambda v: F.pow(v, F.lit(1 / temperature))))


def argmax(x: Column) -> Column:
    """The place, from 0, of the first of the largest items."""
    return F.array_position(x, F.array_max(x)) - 1


def one_hot(label: Column, classes: int, off: float = 0.0, on: float = 1.0) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == label, on).otherwise(off))


def power_db(x: Column, eps: float = 1e-6) -> Column:
    return 10 * F.log10(total(F.transform(doubles(x), lambda v: v * v)) / F.size(x) + eps)


def circle_pad(x: Column, n: int) -> Column:
    """The first ``n`` items of ``x`` repeated without end."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(x, (i % F.size(x)).cast("int") + 1))


def circular_chunks(x: Column, n: int) -> Column:
    """Chunks of ``n``, ceil(size / n) of them; the last goes on with the first items."""
    count = F.ceil(F.size(x) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(x, ((k * n + i) % F.size(x)).cast("int") + 1)))


def frames(x: Column, length: int, shift: int) -> Column:
    """1 + (size - length) / shift whole frames; none if ``x`` is shorter."""
    n = F.when(F.size(x) >= length, 1 + F.floor((F.size(x) - length) / shift)).otherwise(0).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(x, i * shift + 1, length))).otherwise(F.expr("array()").cast(f"array<{'array<double>'}>"))


def pre_emphasis(x: Column, coefficient: float = 0.97) -> Column:
    """x[i] - c * x[i - 1]; the first item takes itself as the one before."""
    return let(doubles(x), lambda v: F.transform(v, lambda y, i: y - coefficient * F.element_at(v, F.greatest(i, F.lit(1)).cast("int"))))


def without_mean(x: Column) -> Column:
    return let(total(doubles(x)) / F.size(x), lambda m: F.transform(doubles(x), lambda y: y - m))


def window(kind: str, n: int) -> Column:
    """Window weights of ``n`` points: hanning, hamming, povey, sine, rectangular, blackman."""
    a = 2 * math.pi / (n - 1)
    shape = {
        "hanning": lambda i: 0.5 - 0.5 * F.cos(a * i),
        "hamming": lambda i: 0.54 - 0.46 * F.cos(a * i),
        "povey": lambda i: F.pow(0.5 - 0.5 * F.cos(a * i), F.lit(0.85)),
        "sine": lambda i: F.sin(0.5 * a * i),
        "rectangular": lambda i: F.lit(1.0) + 0 * i,
        "blackman": lambda i: 0.42 - 0.5 * F.cos(a * i) + 0.08 * F.cos(2 * a * i),
    }[kind]
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: shape(i.cast("double")))


def lfr(rows: Column, m: int, n: int) -> Column:
    """Low frame rate: every ``n``-th frame with the ``m`` frames around it in one; ends are repeated."""
    left = (m - 1) // 2
    count = F.ceil(F.size(rows) / n).cast("int")
    at = lambda k, j: F.element_at(rows, F.greatest(F.lit(1), F.least(F.size(rows), k * n + j - left + 1)).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: at(k, j))))


def cmvn(x: Column, shift: Column, scale: Column) -> Column:
    return F.zip_with(F.zip_with(doubles(x), shift, lambda a, b: a + b), scale, lambda a, b: a * b)


def mask(x: Column, first: int, last: int) -> Column:
    """``x`` with zeros from place ``first`` up to, without, ``last``."""
    return F.transform(doubles(x), lambda v, i: F.when((i >= first) & (i < last), 0.0).otherwise(v))


def mix_at_snr(wav: Column, noise: Column, snr: Column) -> Column:
    """``wav`` with ``noise`` scaled to ``snr`` dB below it, over the peak if that is above 1."""
    scale = F.pow(F.lit(10.0), (power_db(wav) - power_db(noise) - snr) / 20)
    both = let(scale, lambda k: F.zip_with(doubles(wav), doubles(noise), lambda a, b: a + k * b))
    return let(both, lambda x: let(F.array_max(F.transform(x, lambda v: F.abs(v))) + 1e-6, lambda peak: F.transform(x, lambda v: v / peak)))


def mean_vectors(df: DataFrame, key: list[str], emb: str, *, weight: str | None = None) -> DataFrame:
    """(key..., centroid): the mean vector of each key, dimension by dimension, so partial sums are made map-side."""
    w = F.col(weight) if weight else F.lit(1.0)
    long = df.select(*key, w.alias("_w"), F.posexplode(doubles(emb)).alias("_i", "_v"))
    means = long.groupBy(*key, "_i").agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("_m"))
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_m")))
    return means.groupBy(*key).agg(F.transform(ordered, lambda s: s["_m"]).alias("centroid"))


def pooled(df: DataFrame, key: list[str], emb: str) -> DataFrame:
    """(key..., mean, std) with the unbiased deviation, sqrt(var + 1e-8)."""
    long = df.select(*key, F.posexplode(doubles(emb)).alias("_i", "_v"))
    s = long.groupBy(*key, "_i").agg(F.avg("_v").alias("_m"), F.sqrt(F.var_samp("_v") + 1e-8).alias("_s"))
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_m", "_s")))
    return s.groupBy(*key).agg(F.transform(ordered, lambda x: x["_m"]).alias("mean"), F.transform(ordered, lambda x: x["_s"]).alias("std"))


def attentive(df: DataFrame, key: list[str], emb: str, alpha: str) -> DataFrame:
    """(key..., mean, std) weighted by ``alpha``: sum(a x), sqrt(max(sum(a x x) - mean^2, 1e-10))."""
    long = df.select(*key, F.col(alpha).alias("_a"), F.posexplode(doubles(emb)).alias("_i", "_v"))
    s = long.groupBy(*key, "_i").agg(F.sum(F.col("_a") * F.col("_v")).alias("_m"), F.sum(F.col("_a") * F.col("_v") * F.col("_v")).alias("_q"))
    s = s.withColumn("_s", F.sqrt(F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(1e-10))))
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_m", "_s")))
    return s.groupBy(*key).agg(F.transform(ordered, lambda x: x["_m"]).alias("mean"), F.transform(ordered, lambda x: x["_s"]).alias("std"))


def mean_normalised(df: DataFrame, key: list[str], emb: str) -> DataFrame:
    """``df`` with ``emb`` less the mean of its key."""
    means = mean_vectors(df, key, emb)
    return df.join(means, key).withColumn(emb, F.zip_with(doubles(emb), "centroid", lambda a, b: a - b)).drop("centroid")
