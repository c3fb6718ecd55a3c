"""Row filters, caps and small reshapes of manifests, tokens, frames and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with ``reason``: the first rule (name: condition that rejects) that holds, null for good rows.

    The good rows and the log of rejected ones are two filters of the result. A null condition doesn't reject.
    """
    reason = F.lit(None).cast("string")
    for name, bad in reversed(rules.items()):
        reason = F.when(bad, name).otherwise(reason)
    return df.withColumn("reason", reason)


def after_offset(rows: DataFrame, offsets: DataFrame, key: str, ed: str, offset: str = "offset") -> DataFrame:
    """``rows`` that end at or after their key's offset; keys without an offset keep all rows. Equi-join by key."""
    return rows.join(offsets.select(key, offset), key, "left").where(F.col(offset).isNull() | (F.col(ed) >= F.col(offset))).drop(offset)


def in_class_order(df: DataFrame, key: list[str], label: str, classes: list[str], *order: str) -> DataFrame:
    """Rows of the listed classes with ``pos``, from 1: by the classes' order, then ``order``, within each key."""
    rank = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label))
    rows = df.where(F.col(label).isin(classes))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*key).orderBy(rank, *order)))


def single_active(df: DataFrame, frame: str, score: str, quality: str, *, least: float = 0.7, stride: int = 1) -> DataFrame:
    """Faces that are the only one with a positive score in their frame and good enough, of every ``stride``-th frame."""
    active = F.count_if(F.col(score) > 0).over(Window.partitionBy(frame))
    rows = df.where(F.col(frame) % stride == 0).withColumn("_active", active)
    return rows.where((F.col("_active") == 1) & (F.col(score) > 0) & (F.col(quality) >= least)).drop("_active")


def confident(df: DataFrame, key: list[str], probability: str, *ties: str, least: float = 0.9, most: int = 10) -> DataFrame:
    """The ``most`` rows of each key with the highest probability, of those at ``least``, with their rank."""
    order = Window.partitionBy(*key).orderBy(F.col(probability).desc(), *ties)
    return df.where(F.col(probability) >= least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def capped(df: DataFrame, most: int, *order: str) -> DataFrame:
    """The first ``most`` rows by ``order``; Spark keeps that many rows of each task only."""
    return df.orderBy(*order).limit(most)


def others(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """``df`` (few names for each key) with every other name of its key as ``other``."""
    return df.join(df.select(*key, F.col(name).alias("other")), key).where(F.col(name) != F.col("other"))


def token_scores(df: DataFrame, truth: str, predicted: str, *, ignore: int = -100) -> DataFrame:
    """One row of accuracy and class 1's precision, recall and f1 over tokens whose truth isn't ``ignore``."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    sums = df.where(F.col(truth) != ignore).agg(F.count_if(F.col(truth) == F.col(predicted)).alias("same"), F.count(F.lit(1)).alias("n"), F.count_if(t & p).alias("both"), F.count_if(p).alias("p"), F.count_if(t).alias("t"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    return sums.select(ratio(F.col("same"), F.col("n")).alias("accuracy"), ratio(F.col("both"), F.col("p")).alias("precision"), ratio(F.col("both"), F.col("t")).alias("recall"), ratio(2 * F.col("both"), F.col("p") + F.col("t")).alias("f1"))


def histogram(df: DataFrame, value: Column, name: str = "offset") -> DataFrame:
    """How often each whole-number offset comes."""
    return df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def running_medians(df: DataFrame, key: list[str], order: list[str], value: str, width: int = 20) -> DataFrame:
    """``df`` with the lower median and the mean of the last ``width`` values."""
    last = Window.partitionBy(*key).orderBy(*order).rowsBetween(1 - width, 0)
    values = F.sort_array(F.collect_list(value).over(last))
    return df.withColumns({"median": F.element_at(values, F.floor((F.size(values) + 1) / 2).cast("int")), "mean": F.avg(value).over(last)})


def clips(df: DataFrame, key: list[str], time: str, label: str) -> DataFrame:
    """First and last time of each key, and the labels there; sums of minima and maxima, so no group is gathered."""
    return df.groupBy(*key).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.min_by(label, F.struct(time, label)).alias("first_label"), F.max_by(label, F.struct(time, label)).alias("last_label"))


def shots(df: DataFrame, frame: str, *, length: int = 50, stride: int = 5) -> DataFrame:
    """Every ``stride``-th frame with the number of its shot of ``length`` frames."""
    return df.where(F.col(frame) % stride == 0).withColumn("shot", F.floor(F.col(frame) / length))


def shots_by_interval(intervals: DataFrame, key: list[str], *, length: int = 50, stride: int = 5, samples: int = 640) -> DataFrame:
    """(key..., seq, shot, first, frames, detected): the shots of each speech interval (key..., seq, st, ed in samples).

    Frames are ``samples`` long; an interval has those from its start's to its end's. Shots of ``length`` frames begin anew
    in each interval, what is left at its end is a shot too. ``first`` is the shot's first frame of the recording,
    ``detected`` are the frames for the detector, every ``stride``-th of the interval.
    """
    begin, end = F.floor(F.col("st") / samples), F.floor(F.col("ed") / samples)
    n = intervals.withColumns({"_b": begin, "_n": end - begin + 1}).where("_n > 0")
    shot = n.withColumn("shot", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / length).cast("int"))))
    first, frames = F.col("_b") + F.col("shot") * length, F.least(F.lit(length), F.col("_n") - F.col("shot") * length)
    every = F.transform(F.sequence(F.lit(0), frames.cast("int") - 1), lambda i: F.struct((F.col("shot") * length + i).alias("at"), (first + i).alias("frame")))
    seen = F.transform(F.filter(every, lambda x: x["at"] % stride == 0), lambda x: x["frame"])
    return shot.select(*key, "seq", "shot", first.alias("first"), frames.alias("frames"), seen.alias("detected"))


def classes_in_time(df: DataFrame, entity: str, time: str, label: str, classes: tuple[int, ...] = (1, 0, 2)) -> DataFrame:
    """Rows of the ``classes`` with ``pos``, from 1 within an entity: by time, at equal times in the order of the classes."""
    rank = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label))
    kept = df.where(F.col(label).isin(*classes))
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy(entity).orderBy(time, rank)))


def enrolments(lines: DataFrame, value: str = "value") -> DataFrame:
    """(enrol, utt) of lines 'enrol utt1 utt2 ...'; lines without utterances give none."""
    f = F.split(F.trim(F.col(value)), r"\s+")
    return lines.select(f[0].alias("enrol"), F.explode(F.slice(f, F.lit(2), F.greatest(F.size(f) - 1, F.lit(0)))).alias("utt"))


def by_priority(df: DataFrame, key: list[str], order: list[str], ranks: dict[str, list[str]], ties: list[str]) -> DataFrame:
    """``df`` with ``pos``, from 1 within each key: by ``order``, then by columns' places in lists of priorities, then ``ties``.

    Values that aren't in their list come after it.
    """
    place = [F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in values]), F.col(c)), F.lit(0)), F.lit(len(values) + 1)) for c, values in ranks.items()]
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*key).orderBy(*order, *place, *ties)))
