"""Manifests: unique keys, inverted lists, shards, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import python_round


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """(key..., n) of keys that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, *key: str) -> DataFrame:
    """``df``, or an error that names a key that repeats."""
    twice = duplicates(df, *key).limit(1).collect()
    if twice:
        raise ValueError(f"{key} is not unique: {twice[0].asDict()}")
    return df


def assert_vocab(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """``df``, or an error that names a value outside ``allowed``."""
    odd = df.where(~F.col(column).isin(allowed)).select(column).limit(1).collect()
    if odd:
        raise ValueError(f"{column} has {odd[0][0]!r}, which is none of {allowed}")
    return df


def last_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of each key that comes last in ``order``."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def suffixed(column: Column, suffix: str) -> Column:
    return F.concat_ws("_", column, F.lit(suffix)) if suffix else column


def spk2utt(df: DataFrame, utt: str, spk: str, order: str) -> DataFrame:
    """(spk, first, utts): a speaker's utterances in order, and where it is first seen."""
    utts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(utt).alias("u")))), lambda s: s["u"])
    return df.groupBy(spk).agg(F.min(order).alias("first"), utts.alias("utts"))


def utt2spk(df: DataFrame, spk: str, utts: str) -> DataFrame:
    return df.select(F.explode(utts).alias("utt_id"), spk)


def joined_strict(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join of two manifests that must have the same keys: a key that one of them lacks is an error in the job."""
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), key, "full")
    lost = F.concat(F.lit("a manifest lacks "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    checked = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(lost)).otherwise(F.col(key))
    return both.withColumn(key, checked).drop("_l", "_r")


def segment_table(manifest: DataFrame, speakers: DataFrame, seg_dur: float = 3.0, min_spkdur: float = 0.0, *, random_segment: bool = False) -> DataFrame:
    """Training segments (ID, dur, path, start, stop, spk) of manifest (utt_id, path, dur) and speakers (utt_id, spk_id).

    Times in IDs have one place, rounded as Python and C round: by the double's exact value, halves to the even neighbour.
    Only speakers with more than ``min_spkdur`` seconds stay; each chunk counts ``seg_dur``, even a shorter one. With
    ``random_segment`` each utterance is one row of its whole length, from which training crops.
    """
    from .intervals import chunk_count, fixed_chunks

    rows = manifest.join(speakers, "utt_id")
    # a speaker's time is summed over utterances, before they become chunks, and comes back by a join
    own = F.col("dur") if random_segment else chunk_count(F.col("dur"), seg_dur) * seg_dur
    long = rows.groupBy("spk_id").agg(F.sum(own).alias("_all")).where(F.col("_all") > min_spkdur).select("spk_id")
    rows = rows.join(long, "spk_id")
    if random_segment:
        rows = rows.withColumns({"start": F.lit(0.0), "stop": F.col("dur")})
    else:
        rows = fixed_chunks(rows, "dur", seg_dur)
    name = F.concat_ws("_", F.col("utt_id").cast("string"), *[F.format_string("%.1f", python_round(F.col(t), 1)) for t in ("start", "stop")])
    return rows.select(name.alias("ID"), "dur", "path", "start", "stop", F.col("spk_id").alias("spk"))


def error_budget(df: DataFrame, bad: Column, share: float = 0.1) -> DataFrame:
    """``df`` without bad rows, or an error if more than ``share`` of all rows are bad."""
    n = df.agg(F.avg(bad.cast("double")).alias("x")).first()["x"] or 0.0
    if n > share:
        raise ValueError(f"{n:.1%} of the rows are bad, more than {share:.0%}")
    return df.where(~bad)


def shard(df: DataFrame, position: str, rank: int, world: int) -> DataFrame:
    """Every ``world``-th row from ``rank`` on."""
    return df.where(F.pmod(F.col(position), F.lit(world)) == rank)


def disjoint_union(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    """Both tables, or an error if they share a key or repeat one."""
    return assert_unique(a.unionByName(b), *key)


def without_done(df: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """Rows whose key is not among those done."""
    return df.join(done.select(*key).distinct(), list(key), "left_anti")
