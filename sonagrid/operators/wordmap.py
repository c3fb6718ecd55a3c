"""Rewriting words by rules: the longest rule at each place, leftmost first, and words split with their time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hyphenated words that stay whole.
WHOLE = ("mm-hmm", "uh-huh", "um-hmm")
#: Rules up to which they are broadcast to the words; with more, both sides are sorted and merged.
RULES = 10_000


def hyphen_parts(word: Column) -> Column:
    """A word cut at its last inner hyphen, but for those in ``WHOLE``."""
    return F.when(word.isin(*WHOLE), F.array(word)).otherwise(F.split(F.regexp_replace(word, "^(.+)-(.+)$", "$1\n$2"), "\n"))


def rule_hits(words: DataFrame, rules: DataFrame, key: list[str], idx: str = "idx") -> DataFrame:
    """(key..., idx, length, parts, alternatives): where rules (source, parts, alternatives) apply in words (key..., idx, word).

    At a place the longest rule applies; of those that overlap, what begins first, then what begins after its end. The
    words from each place on, once for each length that a rule has, meet rules by their whole source, so the work grows
    with words and lengths and not with the rules that begin alike. Only runs of overlapping hits are folded one after
    another. Without rules there are no hits. Spark takes words of exploded texts for as small as their file, so which
    side may be broadcast isn't left to it.
    """
    return hits_of(words, rules, rule_lengths(rules), key, idx)


def rule_lengths(rules: DataFrame) -> dict[int, int]:
    """How many rules there are of each length."""
    return {n: rows for n, rows in rules.groupBy(F.size("source").alias("n")).count().where("n > 0").collect()}


def hits_of(words: DataFrame, rules: DataFrame, many: dict[int, int], key: list[str], idx: str) -> DataFrame:
    """``rule_hits`` for rules of which ``rule_lengths`` is ``many``."""
    by = Window.partitionBy(*key).orderBy(idx)
    lengths = sorted(many) or [1]
    ahead = words.select(*key, F.col(idx).alias("at"), "word", F.collect_list("word").over(by.rowsBetween(0, lengths[-1] - 1)).alias("_ahead")).where("word IS NOT NULL")
    some = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.size("_ahead"))
    said = ahead.withColumn("length", F.explode(some)).select(*key, "at", "length", F.slice("_ahead", F.lit(1), F.col("length")).alias("source"))
    of = rules.groupBy("source").agg(F.max(F.struct("parts", "alternatives")).alias("r"))
    of = F.broadcast(of) if sum(many.values()) <= RULES else of.hint("merge")
    found = said.join(of, "source").select(*key, F.struct("at", "length", "r.parts", "r.alternatives").alias("h"))
    longest = F.lag("h.at").over(Window.partitionBy(*key).orderBy("h.at", F.desc("h.length")))
    hits = found.withColumn("_before", longest).where("_before IS NULL OR _before < h.at").drop("_before")
    order = Window.partitionBy(*key).orderBy("h.at")
    reach = F.max(F.col("h.at") + F.col("h.length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = hits.withColumn("_new", (reach.isNull() | (reach <= F.col("h.at"))).cast("int"))
    run = begins.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = run.groupBy(*key, "_run").agg(F.sort_array(F.collect_list("h")).alias("hs"))
    none = F.filter("hs", lambda h: F.lit(False))
    free = lambda acc, h: (F.size(acc) == 0) | (F.element_at(acc, -1)["at"] + F.element_at(acc, -1)["length"] <= h["at"])
    taken = F.when(F.size("hs") == 1, F.col("hs")).otherwise(F.aggregate("hs", none, lambda acc, h: F.when(free(acc, h), F.concat(acc, F.array(h))).otherwise(acc)))
    out = grouped.select(*key, F.explode(taken).alias("h"))
    return out.select(*key, F.col("h.at").alias(idx), "h.length", "h.parts", "h.alternatives")


def standardised(words: DataFrame, rules: DataFrame, key: list[str], *, hyphens: bool = True) -> DataFrame:
    """(key..., idx, part, word, st, ed, alternatives): words (key..., idx without gaps, word, st, ed) rewritten by ``rules``.

    A hit stands at its first word; its parts share the time from the first word's start to the last one's end equally.
    A hit with several alternatives gives the first one's parts and all of them in ``alternatives``, a lattice of what
    may be said there. Words without hit are cut at their last inner hyphen, if ``hyphens``, or stay.
    """
    many = rule_lengths(rules)
    hits = hits_of(words, rules, many, key, "idx")
    spread = hits.select(*key, "length", "parts", "alternatives", F.posexplode(F.sequence(F.col("idx"), F.col("idx") + F.col("length") - 1)).alias("_k", "idx"))
    # the ends of the words from each on, so that no window by hit has to follow the join
    ends = F.collect_list(F.struct("ed")).over(Window.partitionBy(*key).orderBy("idx").rowsBetween(0, max(many, default=1) - 1))
    ahead = words.select(*key, "idx", "word", "st", "ed", ends.alias("_ends"))
    latest = F.when(F.col("_k").isNull(), F.col("ed")).otherwise(F.array_max(F.slice("_ends", F.lit(1), F.col("length"))["ed"]))
    held = ahead.join(spread.hint("merge"), [*key, "idx"], "left").where("_k IS NULL OR _k = 0").withColumn("_ed", latest)
    own = hyphen_parts(F.col("word")) if hyphens else F.array("word")
    ruled = F.when(F.size("parts") > 0, F.col("parts")).otherwise(F.col("alternatives")[0])
    said = held.withColumn("_parts", F.when(F.col("_k").isNotNull(), ruled).otherwise(own))
    several = F.when(F.size("alternatives") > 1, F.col("alternatives"))
    each = (F.col("_ed") - F.col("st")) / F.size("_parts")
    parts = said.select(*key, "idx", "st", each.alias("_each"), several.alias("alternatives"), F.posexplode("_parts").alias("part", "word"))
    st = F.col("st") + F.col("part") * F.col("_each")
    return parts.select(*key, "idx", "part", "word", st.alias("st"), (st + F.col("_each")).alias("ed"), "alternatives")
