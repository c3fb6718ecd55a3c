"""Alignment of reference and system events: pair scores as columns, heaviest chains of pairs, and what follows from them.

An alignment keeps order on both sides, so it is a chain of pairs that rises in both places. With each pair's gain over
leaving both alone, the best alignment is the heaviest chain of pairs with a gain; only events that overlap (give or take
a gap) make pairs. Where all earlier pairs lie before all later ones on both sides the chain can be cut: such a piece,
a few words or events long, is what one call of the dynamic program sees.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals
from .scoring import word_weight

#: Metadata that tags words; the first two cover words, the others end at one.
COVERING, ENDING = ("EDIT", "FILLER"), ("IP", "SU")
ATTRIBUTES = (*COVERING, *ENDING)
#: Seconds of a cell in which words are compared with each other.
WORD_CELL = 4.0


def weighed(words: DataFrame) -> DataFrame:
    """``words`` (word, kind, ...) with what pairs of them need: weight, bare (no hyphens at its ends) and lone.

    lone is what the word scores without partner, in thousandths: minus its weight if lexical, else a fifth of it (of 1 at
    least).
    """
    weight = words.withColumn("weight", word_weight(F.col("word"), F.col("kind"))).withColumn("bare", F.regexp_replace("word", "^-+|-+$", ""))
    lone = F.when(F.col("kind") == "lex", -1000 * F.col("weight")).otherwise(-200 * F.greatest(F.lit(1), "weight"))
    return weight.withColumn("lone", lone.cast("long"))


def word_pair_score(ref: str, sys: str, attributes: Sequence[str] = ()) -> Column:
    """What the words of the structs ``ref`` and ``sys`` (of ``weighed`` words) score as partners, in thousandths.

    Matching words, fragments of each other's word, two filled pauses or two fragments cost nothing; other words of one
    kind that isn't lexical a tenth of the reference word's weight; all others the larger weight. Each of ``attributes``
    that both have gives 20 if they agree in it, else 10.
    """
    r, s = (lambda c: F.col(f"{ref}.{c}")), (lambda c: F.col(f"{sys}.{c}"))
    kinds = lambda a, b: (r("kind") == a) & (s("kind") == b)
    match = (
        ((r("word") == s("word")) & (r("kind") == s("kind")))
        | (kinds("lex", "frag") & (s("bare") != "") & F.contains(r("word"), s("bare")))
        | (kinds("frag", "lex") & (r("bare") != "") & F.contains(s("word"), r("bare")))
        | kinds("fp", "fp")
        | kinds("frag", "frag")
    )
    cost = F.when(match, 0).when((r("kind") == s("kind")) & (r("kind") != "lex"), 100 * F.greatest(F.lit(1), r("weight"))).otherwise(1000 * F.greatest(F.lit(1), r("weight"), s("weight")))
    bonus = [F.when(r(a) == s(a), 20).when(r(a).isNotNull() & s(a).isNotNull(), 10).otherwise(0) for a in attributes]
    return (reduce(lambda a, b: a + b, bonus, F.lit(0)) - cost).cast("long")


def metadata_pair_score(ref: str, sys: str, *, gap: float, su_extent: float, words: bool = False, subtype_bonus: float = 1.1, end_bonus: float = 1.001) -> Column:
    """How well the metadata events of the structs ``ref`` and ``sys`` match, null if they are more than ``gap`` apart.

    The time that both share (of sentence units only their last ``su_extent`` counts), with ``words`` the reference words
    that both span (w0 to w1); instants have a little. It is more if subtypes or last words (w1) agree, and less the
    shorter the reference event is against the gap.
    """
    r, s = (lambda c: F.col(f"{ref}.{c}")), (lambda c: F.col(f"{sys}.{c}"))
    first, last, whole, extent = ("w0", "w1", 1, su_extent - 1) if words else ("st", "ed", 0, su_extent)
    su = r("type") == "SU"
    begin = lambda e: F.when(su, F.greatest(e(first), e(last) - extent)).otherwise(e(first))
    shared = F.least(r(last), s(last)) - F.greatest(begin(r), begin(s)) + whole
    shared = shared + F.when(r("type").isin("IP", "CB"), intervals.TIE).otherwise(0.0) + gap
    duration = r(last) - begin(r) + whole
    score = shared * F.when(r("subtype") == s("subtype"), subtype_bonus).otherwise(1.0) * F.when(r("w1") == s("w1"), end_bonus).otherwise(1.0)
    some = F.greatest(duration, F.lit(intervals.TIE))
    return F.when(shared >= 0, F.when(duration + gap < some, score).otherwise(score * some / (duration + gap)))


def placed(events: DataFrame, key: list[str], order: list[str], place: str) -> DataFrame:
    """``events`` with their places 0, 1, ... by ``order``."""
    return events.withColumn(place, (F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).cast("long"))


def candidates(ref: DataFrame, sys: DataFrame, key: list[str], gap: float = 0.0, *, touching: bool = False, cell: float = 300.0) -> DataFrame:
    """(key..., ref, sys) for events (key..., st, ed, ...) less than ``gap`` apart, each side as a struct of all its columns.

    They meet in cells of time, which should be a few times as long as events: all of a cell are compared with each other.
    """
    far = lambda df: df.select(*key, "st", (F.col("ed") + gap).alias("ed"), F.struct(*df.columns).alias("e"))
    pairs = intervals.overlap_join(far(ref), far(sys), key, cell, closed=touching)
    return pairs.select(*[F.col(f"a.{k}").alias(k) for k in key], F.col("a.e").alias("ref"), F.col("b.e").alias("sys"))


def heaviest_chain(ref: list[int], sys: list[int], gain: list[float]) -> list[tuple[int, float]]:
    """Of pairs ordered by (ref, sys), those of the heaviest chain that rises in both, each with the gain up to it.

    Of chains with equal gains, what ends at the least system place is taken, at every step. Best gains by system place
    are kept in a Fenwick tree of prefix maxima, so n pairs cost n log n.
    """
    if len(ref) == 1:
        return [(0, gain[0])]
    places = sorted(set(sys))
    tree: list[tuple[float, int, int]] = [(0.0, 0, -1)] * (len(places) + 1)  # gain, minus the system place's rank, pair
    best, total, before = [0.0] * (len(places) + 1), [0.0] * len(ref), [-1] * len(ref)
    begin = 0
    while begin < len(ref):
        end = begin
        while end < len(ref) and ref[end] == ref[begin]:
            at, top = bisect_left(places, sys[end]), (0.0, 0, -1)
            while at:
                top = max(top, tree[at], key=lambda x: x[:2])
                at &= at - 1
            total[end], before[end] = top[0] + gain[end], top[2]
            end += 1
        for p in range(begin, end):  # pairs of one reference event don't follow each other
            at = own = bisect_left(places, sys[p]) + 1
            if total[p] > best[own]:
                best[own] = total[p]
                while at < len(tree):
                    tree[at] = max((total[p], -own, p), tree[at], key=lambda x: x[:2])
                    at += at & -at
        begin = end
    p = max(range(len(ref)), key=lambda i: (total[i], -sys[i], -ref[i]))
    chain = []
    while p >= 0:
        chain.append((p, total[p]))
        p = before[p]
    return chain[::-1]


def chains(ref: Column, sys: Column, gain: Column) -> Column:
    """``heaviest_chain`` of arrays: an array of structs of the pair's place (at) and the gain up to it (total)."""
    kind = pa.list_(pa.struct([("at", pa.int32()), ("total", pa.float64())]))

    @F.arrow_udf("array<struct<at:int,total:double>>")
    def run(r: pa.Array, s: pa.Array, g: pa.Array) -> pa.Array:
        found = [heaviest_chain(*x) for x in zip(r.to_pylist(), s.to_pylist(), g.to_pylist(), strict=True)]
        return pa.array([[{"at": a, "total": t} for a, t in c] for c in found], kind)

    return run(ref, sys, gain)


def pieces(pairs: DataFrame, key: list[str]) -> DataFrame:
    """``pairs`` (key..., r, s, gain) with ``piece``: the reference place where the piece that the pair is in begins.

    A piece begins at a reference place if all earlier pairs' system places are less than those from here on.
    """
    up, down = Window.partitionBy(*key).orderBy("r"), Window.partitionBy(*key).orderBy(F.desc("r"))
    sofar = F.max("s").over(up.rangeBetween(Window.unboundedPreceding, -1))
    rest = F.min("s").over(down.rangeBetween(Window.unboundedPreceding, 0))
    cut = pairs.withColumn("_sofar", sofar).withColumn("_rest", rest)
    begins = F.when(F.col("_sofar").isNull() | (F.col("_sofar") < F.col("_rest")), F.col("r"))
    return cut.withColumn("piece", F.max(begins).over(up.rangeBetween(Window.unboundedPreceding, 0))).drop("_sofar", "_rest")


def best_pairs(pairs: DataFrame, key: list[str]) -> DataFrame:
    """(key..., r, s, gain, total, piece): the pairs of the best alignment, ``total`` being the gain from the key's first pair on.

    ``pairs``: key..., r, s (places on both sides), gain over leaving both alone. Pairs without gain can't be in a best
    alignment and are left out at once; among equal ones the alignment with the least system places is taken.
    """
    some = pairs.select(*key, "r", "s", F.col("gain").cast("double").alias("gain")).where("gain > 0")
    of = pieces(some, key).groupBy(*key, "piece").agg(F.sort_array(F.collect_list(F.struct("r", "s", "gain"))).alias("p"))
    hit = F.explode(chains(F.col("p.r"), F.col("p.s"), F.col("p.gain")))
    rows = of.select(*key, "piece", "p", hit.alias("hit")).select(*key, "piece", F.element_at("p", F.col("hit.at") + 1).alias("x"))
    total = F.sum("x.gain").over(Window.partitionBy(*key).orderBy("x.r").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(*key, "x.r", "x.s", "x.gain", total.alias("total"), "piece")


def aligned(ref: DataFrame, sys: DataFrame, chosen: DataFrame, key: list[str]) -> DataFrame:
    """(key..., ref, sys, gain): all events of both sides as structs, partners in one row, null where there is none.

    ``ref`` has its places in r, ``sys`` in s.
    """
    a = ref.select(*key, F.col("r"), F.struct(*ref.columns).alias("ref"))
    b = sys.select(*key, F.col("s"), F.struct(*sys.columns).alias("sys"))
    return a.join(chosen.select(*key, "r", "s", "gain"), [*key, "r"], "left").join(b, [*key, "s"], "full").select(*key, "ref", "sys", "gain")


def shared_part(ref: str, sys: str) -> Column:
    """Shared time over the longer of two events."""
    r, s = (lambda c: F.col(f"{ref}.{c}")), (lambda c: F.col(f"{sys}.{c}"))
    return (F.least(r("ed"), s("ed")) - F.greatest(r("st"), s("st"))) / F.greatest(r("ed") - r("st"), s("ed") - s("st"))


def align(ref: DataFrame, sys: DataFrame, key: list[str], score: Callable[[str, str], Column], gap: float = 0.0, *, touching: bool = False, cell: float = 300.0) -> DataFrame:
    """(key..., ref, sys, gain): the order-keeping alignment of events (key..., seq, st, ed, ...) with most score.

    ``score`` rates a pair of the structs with the given names, null or 0 for pairs that may not be; only events less than
    ``gap`` apart (with ``touching`` at most) are rated. Events are in the order of st and seq; those without a partner
    come with a null on the other side.
    """
    r, s = placed(ref, key, ["st", "seq"], "r"), placed(sys, key, ["st", "seq"], "s")
    pairs = candidates(r, s, key, gap, touching=touching, cell=cell).select(*key, F.col("ref.r").alias("r"), F.col("sys.s").alias("s"), score("ref", "sys").alias("gain"))
    return aligned(r, s, best_pairs(pairs, key), key)


def align_events(ref: DataFrame, sys: DataFrame, key: list[str], score: Callable[[str, str], Column] = shared_part, gap: float = 0.0) -> DataFrame:
    """(key..., ref_seq, sys_seq, score): ``align`` by the events' numbers."""
    out = align(ref, sys, key, score, gap)
    return out.select(*key, F.col("ref.seq").alias("ref_seq"), F.col("sys.seq").alias("sys_seq"), F.col("gain").alias("score"))


def error_counts(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key..., ref, del, ins, matched) of the rows of ``align_events``."""
    r, s = F.col("ref_seq").isNotNull(), F.col("sys_seq").isNotNull()
    return rows.groupBy(*key).agg(F.count_if(r).alias("ref"), F.count_if(r & ~s).alias("del"), F.count_if(s & ~r).alias("ins"), F.count_if(r & s).alias("matched"))


def word_pairs(ref: DataFrame, sys: DataFrame, key: list[str], gap: float = 0.1, attributes: Sequence[str] = ()) -> DataFrame:
    """(key..., ref, sys, pair, gain): ``weighed`` words (key..., st, ed, ...) close enough in time, with their scores in thousandths."""
    pairs = candidates(ref, sys, key, gap, cell=WORD_CELL).withColumn("pair", word_pair_score("ref", "sys", attributes))
    return pairs.withColumn("gain", F.col("pair") - F.col("ref.lone") - F.col("sys.lone"))


def by_middle(words: DataFrame, key: list[str], place: str) -> DataFrame:
    return placed(weighed(words), key, [(F.col("st") + F.col("ed")) / 2, F.col("seq")], place)


def align_words(ref: DataFrame, sys: DataFrame, key: list[str], gap: float = 0.1, attributes: Sequence[str] = ()) -> DataFrame:
    """(key..., ref, sys, gain): the best word alignment of words (key..., seq, word, kind, st, ed, ...) in order of their middles."""
    r, s = by_middle(ref, key, "r"), by_middle(sys, key, "s")
    pairs = word_pairs(r, s, key, gap, attributes).select(*key, "ref.r", "sys.s", "gain")
    return aligned(r, s, best_pairs(pairs, key), key)


def spoken_by(ref: DataFrame, sys: DataFrame, key: list[str], gap: float = 0.1, attributes: Sequence[str] = ()) -> DataFrame:
    """(key..., s, speaker, r, speakers): for each system word with a partner, which speaker's reference word it is.

    Each speaker's words (key..., seq, speaker, word, kind, st, ed, ...) are aligned on their own with all of ``sys``. Of
    several speakers that have a partner for a word, that with the best score up to the word has it, of equal ones the
    last by name. r and s are places in the order of middles, r among the speaker's words. As in the evaluation script,
    the score at a speaker's last word holds the cost of all system words after it as well.
    """
    own = [*key, "speaker"]
    r, s = by_middle(ref, own, "r"), by_middle(sys, key, "s")
    pairs = word_pairs(r, s, key, gap, attributes).select(*key, "ref.speaker", "ref.r", "sys.s", "gain")
    upto = lambda by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    costs = r.select(*own, "r", F.sum("lone").over(upto(own, "r")).alias("cost"), F.lead("r").over(Window.partitionBy(*own).orderBy("r")).isNull().alias("last"))
    rest = s.select(*key, "s", (F.sum("lone").over(Window.partitionBy(*key)) - F.sum("lone").over(upto(key, "s"))).alias("rest"))
    found = best_pairs(pairs, own).join(costs, [*own, "r"]).join(rest, [*key, "s"])
    score = F.col("total") + F.col("cost") + F.when(F.col("last"), F.col("rest")).otherwise(0)
    best = found.withColumn("score", score).groupBy(*key, "s").agg(F.max(F.struct("score", "speaker", "r")).alias("b"), F.count(F.lit(1)).alias("speakers"))
    return best.select(*key, "s", "b.speaker", "b.r", "speakers")


def word_spans(events: DataFrame, words: DataFrame, key: list[str]) -> DataFrame:
    """``events`` (key..., st, ed, ...) with w0 and w1: the first and last word (key..., mid) whose middle they hold, ends included.

    Words count from 0 in order of their middles. An event that holds none has w1 = w0 - 1. Words and boundaries pass in
    one sort by key: running counts of words, no comparison of events with words.
    """
    rows = events.withColumn("_e", F.monotonically_increasing_id())
    e = rows.select(*key, F.struct(*events.columns).alias("_x"), F.explode(F.array(F.struct(F.col("st").alias("t"), F.lit(0).alias("phase")), F.struct(F.col("ed").alias("t"), F.lit(2).alias("phase")))).alias("_b"), "_e")
    e = e.select(*key, F.when(F.col("_b.phase") == 0, F.col("_x")).alias("_x"), "_e", "_b.t", "_b.phase")  # an event passes the sort once, its end without it
    w = words.select(*key, F.col("mid").alias("t"), F.lit(1).alias("phase"))
    seen = F.count_if(F.col("phase") == 1).over(Window.partitionBy(*key).orderBy("t", "phase").rowsBetween(Window.unboundedPreceding, 0))
    counted = e.unionByName(w, allowMissingColumns=True).withColumn("_n", seen).where("phase <> 1")
    return counted.groupBy(*key, "_e").agg(F.any_value("_x", True).alias("_x"), F.min("_n").alias("w0"), (F.max("_n") - 1).alias("w1")).select("_x.*", "w0", "w1")


def tagged_words(words: DataFrame, events: DataFrame, key: list[str]) -> DataFrame:
    """``words`` (key..., idx from 0 by middle, mid, ...) with columns edit, filler, ip and su: the subtypes that tag them.

    EDIT and FILLER events (key..., seq, type, subtype, st, ed) tag all words whose middle they hold, SU and IP the last
    word up to their end. Of several events of a type the last one by middle and seq tags a word. Each event is spread
    over the numbers of the words that it tags, so the work is that of the result.
    """
    some = events.where(F.col("type").isin(*ATTRIBUTES)).select(*key, "seq", "type", "subtype", "st", "ed")
    spans = word_spans(some, words, key).withColumn("w0", F.when(F.col("type").isin(*COVERING), F.col("w0")).otherwise(F.col("w1")))
    hit = spans.where((F.col("w1") >= F.col("w0")) & (F.col("w1") >= 0)).withColumn("idx", F.explode(F.sequence("w0", "w1")))
    order = F.struct((F.col("st") + F.col("ed")) / 2, F.col("seq"))
    last = [F.max_by("subtype", F.when(F.col("type") == a, order)).alias(a.lower()) for a in ATTRIBUTES]
    return words.join(hit.groupBy(*key, "idx").agg(*last), [*key, "idx"], "left")


def in_reference_time(times: DataFrame, words: DataFrame, key: list[str]) -> DataFrame:
    """``times`` (key..., t, ...) of the system with ``rt``: the time in the reference that the word alignment puts them at.

    ``words``: key..., seq, st, ed of system words with a partner, rst, red of the partner. The first word (by start) that
    doesn't end before t and the last one up to it that doesn't begin after t are the anchors: by their beginnings or
    ends, whichever is on t's side. Between anchors times are on a line, beyond the only one they keep their distance;
    a key without such words keeps its times. Two running aggregates over one sort by key each.
    """
    rows = times.withColumn("_id", F.monotonically_increasing_id())
    asks = rows.select(*key, "_id", "t", F.struct(*times.columns).alias("_x"))
    by = Window.partitionBy(*key)
    anchors = words.select(*key, F.struct("st", "ed", "seq", "rst", "red").alias("w"))
    # ends that exceed those of all earlier words: the first word with an end from t on is one of these
    ahead = F.max("w.ed").over(by.orderBy("w").rowsBetween(Window.unboundedPreceding, -1))
    rising = anchors.withColumn("_m", ahead).where(F.col("_m").isNull() | (F.col("w.ed") > F.col("_m"))).select(*key, "w", F.col("w.ed").alias("t"))
    both = asks.unionByName(rising, allowMissingColumns=True)
    after = F.last("w", ignorenulls=True).over(by.orderBy(F.desc("t"), F.col("w").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    right = both.withColumn("after", after).where("_id IS NOT NULL").select(*key, "_id", "t", "_x", "after")
    both = right.unionByName(anchors.select(*key, "w", F.col("w.st").alias("t")), allowMissingColumns=True)
    before = F.last("w", ignorenulls=True).over(by.orderBy("t", F.col("w").isNull(), "w").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("before", before).where("_id IS NOT NULL")
    t, a = F.col("t"), F.col("after")
    b = F.when(a["st"] <= t, a).otherwise(F.col("before"))  # words after the right anchor don't count
    pick = lambda w, inner, outer, first: F.when(inner, w[first]).otherwise(w[outer])
    t2, r2 = pick(a, a["st"] < t, "st", "ed"), pick(a, a["st"] < t, "rst", "red")
    t1, r1 = pick(b, b["ed"] > t, "ed", "st"), pick(b, b["ed"] > t, "red", "rst")
    line = F.when(t == t1, r1).otherwise(r1 + (t - t1) * (r2 - r1) / (t2 - t1))
    rt = F.when(a.isNull() & b.isNull(), t).when(b.isNull(), r2 + (t - t2)).when(a.isNull(), r1 + (t - t1)).otherwise(line)
    return found.withColumn("rt", rt).select("_x.*", "rt")


def word_path(rows: DataFrame) -> DataFrame:
    """``rows`` of ``align_words`` with n_ref, del, ins and sub: the reference word's weight, and the error it stands for.

    A pair or lone word is an error unless it scores better than minus a half, as fragments and filled pauses do.
    """
    r, s = F.col("ref").isNotNull(), F.col("sys").isNotNull()
    wrong = (F.when(r & s, word_pair_score("ref", "sys")).otherwise(F.coalesce("ref.lone", "sys.lone")) <= -500).cast("int")
    weight = F.when(r, F.col("ref.weight")).otherwise(0)
    of = lambda side: F.when(side, wrong).otherwise(0)
    return rows.select("*", weight.alias("n_ref"), of(r & ~s).alias("del"), of(s & ~r).alias("ins"), of(r & s).alias("sub"))
