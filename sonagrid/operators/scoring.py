"""What scoring reports of speakers and events, and time that isn't scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from . import intervals, regions

MISS, FALSE_ALARM = "MISS", "FALSE ALARM"


def mapped_pairs(pairs: DataFrame, mapping: DataFrame, key: list[str]) -> DataFrame:
    """(key..., ref, sys, mapped, ov): the shared time of all pairs of speakers, and whether the mapping has the pair."""
    own = mapping.select(*key, "ref", F.col("sys").alias("_own"))
    rows = pairs.join(own, [*key, "ref"], "left")
    return rows.select(*key, "ref", "sys", F.coalesce(F.col("sys") == F.col("_own"), F.lit(False)).alias("mapped"), "ov")


def map_lines(rows: DataFrame, file: str, channel: Column) -> DataFrame:
    """Lines 'File,Channel,RefSpeaker,SysSpeaker,isMapped,timeOverlap' (value) of ``mapped_pairs``; the time has four places."""
    said = F.when(F.col("mapped"), "mapped").otherwise("notmapped")
    return rows.select(F.concat_ws(",", F.col(file).cast("string"), channel, "ref", "sys", said, F.format_string("%.4f", scalars.sql_round(F.col("ov"), 4))).alias("value"))


def speaker_types(ref: DataFrame, sys: DataFrame, mapping: DataFrame, key: list[str]) -> DataFrame:
    """(ref_type, sys_type, n): how many speakers of each type were mapped to speakers of which type.

    ``ref``: key..., ref, type, time; ``sys`` likewise. Speakers without time don't count; reference speakers without
    a partner stand at MISS, the system's at FALSE ALARM.
    """
    m = mapping.select(*key, "ref", "sys")
    r = ref.where(F.col("time") > 0).select(*key, "ref", F.col("type").alias("ref_type"))
    kinds = sys.select(*key, "sys", F.col("type").alias("sys_type"))
    found = r.join(m, [*key, "ref"], "left").join(kinds, [*key, "sys"], "left")
    taken = r.join(m, [*key, "ref"]).select(*key, "sys")
    alone = sys.where(F.col("time") > 0).join(taken, [*key, "sys"], "left_anti")
    rows = found.select("ref_type", F.coalesce("sys_type", F.lit(MISS)).alias("sys_type"))
    rows = rows.union(alone.select(F.lit(FALSE_ALARM).alias("ref_type"), F.col("type").alias("sys_type")))
    return rows.groupBy("ref_type", "sys_type").agg(F.count(F.lit(1)).alias("n"))


def speaker_type_times(pieces: DataFrame, ref: DataFrame, sys: DataFrame, key: list[str]) -> DataFrame:
    """(ref_type, sys_type, seconds): the time of reference types against system types, MISS and FALSE ALARM where none.

    ``pieces``: those of ``intervals.atoms``; ``ref`` and ``sys``: key..., speaker, type. In each piece types meet for as
    many speakers as both have. The time of more speakers of a type than the whole other side has is missed or false. (The
    evaluation script compares with whichever type of the other side it saw last; with one type a side both agree.)
    """
    at = [*key, "st", "ed"]
    sides = []
    for side, kinds, other in (("ref", ref, "n_sys"), ("sys", sys, "n_ref")):
        rows = pieces.select(*at, F.col(other).alias("_other"), F.explode(side).alias("speaker")).join(kinds.select(*key, "speaker", "type"), [*key, "speaker"])
        sides.append(rows.groupBy(*at, "_other", F.col("type").alias(f"{side}_type")).agg(F.count(F.lit(1)).alias(f"_{side}")))
    r, s = sides
    d = F.col("ed") - F.col("st")
    both = r.drop("_other").join(s.drop("_other"), at).select("ref_type", "sys_type", (F.least("_ref", "_sys") * d).alias("seconds"))
    missed = r.where("_ref > _other").select("ref_type", F.lit(MISS).alias("sys_type"), ((F.col("_ref") - F.col("_other")) * d).alias("seconds"))
    false = s.where("_sys > _other").select(F.lit(FALSE_ALARM).alias("ref_type"), "sys_type", ((F.col("_sys") - F.col("_other")) * d).alias("seconds"))
    return both.union(missed).union(false).groupBy("ref_type", "sys_type").agg(F.sum("seconds").alias("seconds"))


def typed_errors(aligned: DataFrame, key: list[str], ref: str, sys: str) -> DataFrame:
    """(key..., ref, del, ins, sub, correct) of an alignment whose sides' labels are ``ref`` and ``sys``, null if missing.

    Partners with other labels are substitutions. Counts are summed before the shuffle.
    """
    r, s = F.col(ref), F.col(sys)
    n = F.count_if
    return aligned.groupBy(*key).agg(n(r.isNotNull()).alias("ref"), n(r.isNotNull() & s.isNull()).alias("del"), n(s.isNotNull() & r.isNull()).alias("ins"), n(r != s).alias("sub"), n(r == s).alias("correct"))


#: Types and subtypes that named conditions leave out, by what they leave them out of (evaluation or scores)
#: and what is evaluated (metadata or speakers).
UNANNOTATED = {"NOSCORE": ["<na>"], "SU": ["unannotated"]}
CONDITIONS: dict[tuple[str, str], dict[str, dict[str, list[str]]]] = {
    ("evaluation", "metadata"): {"DEFAULT": {"NOSCORE": ["<na>"], "NO_RT_METADATA": ["<na>"]}},
    ("scores", "metadata"): {
        "DEFAULT": {**UNANNOTATED, "LEXEME": ["un-lex"]},
        "MIN": UNANNOTATED,
        "FRAG_UNLEX": {**UNANNOTATED, "LEXEME": ["frag", "un-lex"]},
        "FRAG": {**UNANNOTATED, "LEXEME": ["frag"]},
        "NONE": {},
    },
    ("evaluation", "speakers"): {"DEFAULT": {"NOSCORE": ["<na>"]}},
    ("scores", "speakers"): {"DEFAULT": {"NOSCORE": ["<na>"], "NON-LEX": ["laugh", "breath", "lipsmack", "cough", "sneeze", "other"]}},
}


def condition(left_out_of: str, of: str, name: str | None = None) -> dict[str, list[str]]:
    """The named condition's subtypes by type, for ``token_kind``; an unknown name is an error that says which there are."""
    known = CONDITIONS[left_out_of, of]
    if (name := name or "DEFAULT") not in known:
        said = "; ".join(f"{n}: {', '.join(f'{t} {s}' for t, ss in sorted(c.items()) for s in ss) or 'nothing'}" for n, c in sorted(known.items()))
        raise ValueError(f"no condition {name!r} leaves anything out of {left_out_of} of {of}; there are {said}")
    return known[name]


def token_kind(type_: Column, subtype: Column, excluded: dict[str, list[str]]) -> Column:
    """'LEX' for words that count, 'SEG' for speaker turns, 'NSZ' for types and subtypes that aren't scored, else null.

    ``excluded``: subtypes by type. Speaker turns are never left out.
    """
    out = F.lit(False)
    for name, subtypes in excluded.items():
        out = out | ((type_ == name) & subtype.isin(subtypes))
    out = F.coalesce(out, F.lit(False))
    return F.when((type_ == "LEXEME") & ~out, "LEX").when(type_ == "SPEAKER", "SEG").when(out, "NSZ")


def noscore_zones(tokens: DataFrame, key: list[str], extend: float = 0.5) -> DataFrame:
    """(key..., st, ed): time that isn't scored, from tokens (key..., st, ed, kind) with kinds as in ``token_kind``.

    Each run of open NSZ tokens is a zone. It begins up to ``extend`` earlier, but not before the last word's end or the
    last boundary of a turn, nor at all if a word is open. It lasts ``extend`` longer or up to the next moment when no NSZ
    token and some word is open, or the next boundary of a turn; if neither comes, to the end of time (infinity), or up
    to the next run: runs at most twice ``extend`` apart are then one zone. At equal times ends come before starts, turns
    before words before NSZ. Tokens without time or kind take no part. All of it is windows over one shuffle by key.
    """
    some = tokens.where((F.col("ed") > F.col("st")) & F.col("kind").isin("LEX", "SEG", "NSZ"))
    ends = F.array(F.struct(F.col("st").alias("t"), F.lit(1).alias("step")), F.struct(F.col("ed").alias("t"), F.lit(-1).alias("step")))
    e = some.select(*key, "kind", F.explode(ends).alias("e")).select(*key, "kind", "e.t", "e.step")
    kind, t = F.col("kind"), F.col("t")
    rank = F.when(kind == "SEG", 0).when(kind == "LEX", 1).otherwise(2)
    w = Window.partitionBy(*key).orderBy("t", "step", rank).rowsBetween(Window.unboundedPreceding, 0)
    of = lambda k: F.sum(F.when(kind == k, F.col("step")).otherwise(0)).over(w)
    e = e.withColumns({"lex": of("LEX"), "nsz": of("NSZ")})
    opens = (kind == "NSZ") & (F.col("step") == 1) & (F.col("nsz") == 1)
    word = F.last(F.when((kind == "LEX") & (F.col("lex") == 0), t), ignorenulls=True).over(w)
    turn = F.last(F.when(kind == "SEG", t), ignorenulls=True).over(w)
    e = e.withColumns({"bound": F.greatest(F.lit(0.0), word, turn), "run": F.sum(opens.cast("long")).over(w)}).where("run > 0")
    begin = F.min(F.when(opens, F.struct("t", "lex", "bound"))).alias("b")
    closed = F.min(F.when((F.col("nsz") == 0) & ((F.col("lex") > 0) | (kind == "SEG")), t)).alias("closed")
    runs = e.groupBy(*key, "run").agg(begin, closed, F.max(F.when(kind == "NSZ", t)).alias("last"))
    order = Window.partitionBy(*key).orderBy("run")
    b, last = F.col("b.t"), F.col("last")
    shut, before, after = F.lag("closed").over(order), F.lag("last").over(order), F.lead("b.t").over(order)
    first = before.isNull() | shut.isNotNull()
    st = F.when(first & (F.col("b.lex") > 0), b).when(first, F.greatest(F.col("b.bound"), b - extend)).when(b > before + 2 * extend, b - extend)
    ed = F.when(F.col("closed").isNotNull(), F.least(last + extend, "closed")).when(after.isNull(), float("inf")).when(after > last + 2 * extend, last + extend)
    zones = runs.select(*key, "run", st.alias("st"), ed.alias("ed"))
    zone = F.count("st").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return zones.withColumn("zone", zone).groupBy(*key, "zone").agg(F.min("st").alias("st"), F.max("ed").alias("ed")).drop("zone")


def without_noscore(uem: DataFrame, tokens: DataFrame, key: list[str], extend: float = 0.5) -> DataFrame:
    """``uem`` (key..., st, ed) without the zones of ``tokens`` that aren't scored."""
    return intervals.subtract(uem.select(*key, "st", "ed"), noscore_zones(tokens, key, extend), key)


def without_subtype(ref: DataFrame, sys: DataFrame, key: str, type_: str, subtype: str) -> tuple[DataFrame, DataFrame]:
    """Both sides without what a subtype of events that isn't scored takes along.

    ``ref``: key, st, ed, type, subtype. ``sys``: key, mid, type, partner (its reference partner's subtype, null if it
    has none). The reference loses the subtype's events; the system loses events of the type whose partner has the
    subtype, and those without a partner whose middle lies in such an event, ends included. Nulls elsewhere stay.
    """
    gone = F.coalesce((F.col("type") == type_) & (F.col("subtype") == subtype), F.lit(False))
    of_type = F.coalesce(F.col("type") == type_, F.lit(False))
    spans = ref.where(gone).select(key, F.col("st").alias("rst"), F.col("ed").alias("red"))
    alone = regions.midpoint_in_region(sys.where(of_type & F.col("partner").isNull()), spans, key, "mid", outside=True)
    rest = sys.where(~of_type | (F.col("partner") != subtype))
    return ref.where(~gone), rest.unionByName(alone)


def word_weight(word: Column, kind: Column, *, without: tuple[str, ...] = ("non-lex", "misc"), single: tuple[str, ...] = ("mm-hmm", "uh-huh", "um-hmm")) -> Column:
    """How many words a token counts for: hyphenated ones two, those ``single`` and all others one, kinds ``without`` none.

    Hyphens at the ends don't count, a token of nothing else is two, a null one none; a null kind is none of ``without``.
    """
    bare = F.regexp_replace(word, "^-+|-+$", "")
    none = word.isNull() | F.coalesce(kind.isin(*without), F.lit(False))
    return F.when(none, 0).when(bare.rlike("^[^-]+$") | bare.isin(*single), 1).otherwise(2)


def word_deltas(events: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """``events`` (key, place, ref, sys, ...) with ``delta``: the scored words by which the system's boundary is late.

    ``words`` (key, idx from 0 without gaps, scored). An END stands after its word, a BEG before it; places beyond the
    words are at their ends. A difference of running counts, so no event visits the words between. A null place of a
    word or kind of boundary gives null; a key without words gives 0.
    """
    order = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    counted = words.select(F.col(key).alias("_k"), F.col("idx").alias("_i"), F.count_if(F.col("scored")).over(order).alias("_n"))
    last = words.groupBy(F.col(key).alias("_lk")).agg(F.max("idx").alias("_last"))
    out = events.join(last, F.col(key) == F.col("_lk"), "left").drop("_lk")
    before = F.when(F.col("place") == "END", 0).when(F.col("place") == "BEG", 1)
    for side in ("ref", "sys"):
        out = out.withColumn("_at", F.when(F.col("_last").isNotNull(), F.least(F.col(side) - before, F.col("_last"))))
        at = counted.select("_k", "_i", F.col("_n").alias(f"_{side}"))
        out = out.join(at, (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_i")), "left").drop("_k", "_i", "_at")
    known = before.isNotNull() & F.col("ref").isNotNull() & F.col("sys").isNotNull()
    delta = F.when(known, F.coalesce("_sys", F.lit(0)) - F.coalesce("_ref", F.lit(0)))
    return out.withColumn("delta", delta).drop("_ref", "_sys", "_last")
