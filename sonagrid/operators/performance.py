"""Performance reports of metadata: errors in words and in events, by file, channel, speaker and gender."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alignment import COVERING

ERRORS = ("n_ref", "n_del", "n_ins", "n_sub")
#: Fixed value: the largest percentage that reports show.
MOST = 999.99
#: Levels of the reports: all of a type, and by what.
WORD_LEVELS = ((), ("file",), ("channel",), ("file", "channel"))
EVENT_LEVELS = (*WORD_LEVELS, ("speaker",), ("gender",))


def word_errors(ref: DataFrame, sys: DataFrame, words: DataFrame, key: list[str]) -> DataFrame:
    """(key..., type, idx, n_ref, n_del, n_ins, n_sub): errors of metadata in terms of reference words.

    ``ref`` and ``sys``: key..., type, subtype, w0, w1 (their first and last reference word) and mapped; ``words``:
    key..., idx, scored. An event stands at each of its words, ends of sentence units and interruption points at their
    last word only (the nearest there is), whether that is scored or not. Partners at a word are correct as far as
    subtypes agree, substituted as far as they don't; unmapped ends of the system are always insertions.
    """
    last = words.groupBy(*key).agg(F.max("idx").alias("_last"))
    counts = []
    for side, events in (("r", ref), ("s", sys)):
        e = events.join(last, key)
        covers = F.col("type").isin(*COVERING)
        nearest = F.greatest(F.lit(0), F.least("w1", "_last"))
        first, end = F.when(covers, F.greatest(F.lit(0), "w0")).otherwise(nearest), F.when(covers, F.least("w1", "_last")).otherwise(nearest)
        spread = e.withColumn("_a", first).withColumn("_b", end).where("_b >= _a").withColumn("idx", F.explode(F.sequence("_a", "_b")))
        maps = covers | F.col("mapped")
        counts.append(spread.select(*key, "type", "subtype", "idx", F.lit(side).alias("side"), maps.alias("maps")))
    n = lambda side, maps: F.count_if((F.col("side") == side) & (F.col("maps") == maps))
    by_subtype = reduce(DataFrame.unionByName, counts).groupBy(*key, "type", "idx", "subtype").agg(n("r", True).alias("nr"), n("r", False).alias("nm"), n("s", True).alias("ns"), n("s", False).alias("ni"))
    sums = by_subtype.groupBy(*key, "type", "idx").agg(
        F.sum(F.col("nr") + F.col("nm")).alias("ref"), F.sum("ns").alias("sys"), F.sum("ni").alias("alone"), F.sum(F.least("nr", "ns")).alias("right")
    )
    scored = sums.join(words.select(*key, "idx", "scored"), [*key, "idx"]).where(F.col("scored") | ~F.col("type").isin(*COVERING))
    more = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0))
    return scored.select(
        *key, "type", "idx", F.col("ref").alias("n_ref"), more("ref", "sys").alias("n_del"), (more("sys", "ref") + F.col("alone")).alias("n_ins"),
        (F.least("ref", "sys") - F.col("right")).alias("n_sub"),
    )


def event_errors(aligned: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., ref_subtype, sys_subtype, n_ref, n_del, n_ins, n_sub) of each row of an alignment of metadata.

    ``aligned`` has the subtypes of both sides, null where there is no partner.
    """
    r, s = F.col("ref_subtype"), F.col("sys_subtype")
    one = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    return aligned.select(
        *keep, "ref_subtype", "sys_subtype", one(r.isNotNull()).alias("n_ref"), one(r.isNotNull() & s.isNull()).alias("n_del"),
        one(s.isNotNull() & r.isNull()).alias("n_ins"), one(r != s).alias("n_sub"),
    )


def category(level: Sequence[str]) -> Column:
    """How reports name a level's rows: ALL, or c=channel f=file, s=speaker, g=gender."""
    said = [F.concat(F.lit(f"{name[0]}="), F.col(name).cast("string")) for name in ("channel", "file", "speaker", "gender") if name in level]
    return F.concat_ws(" ", *said) if said else F.lit("ALL")


def with_rates(sums: DataFrame) -> DataFrame:
    """``sums`` of errors with del, ins, sub, d_plus_i and total in percent of n_ref, at most ``MOST``."""
    rate = lambda c: F.least(F.lit(MOST), 100 / F.greatest(F.col("n_ref").cast("double"), F.lit(1e-8)) * c)
    d, i, s = (F.col(c) for c in ERRORS[1:])
    return sums.select("*", rate(d).alias("del"), rate(i).alias("ins"), rate(s).alias("sub"), rate(d + i).alias("d_plus_i"), rate(d + i + s).alias("total"))


def performance(errors: DataFrame, levels: Sequence[Sequence[str]] = WORD_LEVELS, by: Sequence[str] = ("type",)) -> DataFrame:
    """(by..., category, n_ref, n_del, n_ins, n_sub, del, ins, sub, d_plus_i, total): errors summed at every level in one pass.

    Grouping sets: each row of ``errors`` is read once and summed for all levels before the shuffle. A level's columns
    that are null are named unknown.
    """
    names = list(dict.fromkeys(n for level in levels for n in level))
    known = errors.withColumns({n: F.coalesce(F.col(n).cast("string"), F.lit("unknown")) for n in names})
    sets = [[F.col(c) for c in (*by, *level)] for level in levels]
    sums = known.groupingSets(sets, *by, *names).agg(*[F.sum(c).alias(c) for c in ERRORS], F.grouping_id().alias("_g"))
    bit = {n: 1 << (len(names) - 1 - i) for i, n in enumerate(names)}  # a set bit: the column isn't in the level
    named = F.lit(None).cast("string")
    for level in levels:
        named = F.when(F.col("_g") == sum(b for n, b in bit.items() if n not in level), category(level)).otherwise(named)
    return with_rates(sums.select(*by, named.alias("category"), *ERRORS))


def confusion(errors: DataFrame, by: Sequence[str] = ("type",)) -> DataFrame:
    """(by..., ref, sys, n): how many reference events of each subtype the system gave which; {Miss} and {FA} where none."""
    r, s = F.coalesce("ref_subtype", F.lit("{FA}")), F.coalesce("sys_subtype", F.lit("{Miss}"))
    return errors.groupBy(*by, r.alias("ref"), s.alias("sys")).agg(F.count(F.lit(1)).alias("n"))


def offsets(deltas: DataFrame, by: Sequence[str], far: int = 3) -> DataFrame:
    """(by..., offset, n): how many boundaries (delta in words) are off by how much; '<-3' and '>3' beyond ``far``."""
    d = F.col("delta")
    named = F.when(d < -far, f"<-{far}").when(d > far, f">{far}").otherwise(d.cast("string"))
    return deltas.where(d.isNotNull()).groupBy(*by, named.alias("offset")).agg(F.count(F.lit(1)).alias("n"))
