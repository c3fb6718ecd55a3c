"""Transcripts: sentences, windows over dialogues, punctuation, speaker attribution."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from .intervals import islands, overlap_join, upto

#: Fixed value: the marks that end a sentence.
ENDS = "。？！"


def sentences(content: Column, ends: str = ENDS) -> Column:
    """The text cut after every end mark; what follows the last one is kept."""
    return F.regexp_extract_all(content, F.lit(f"[^{ends}]*[{ends}]|[^{ends}]+$"), F.lit(0))


def split_sentences(df: DataFrame, content: str = "content", ends: str = ENDS) -> DataFrame:
    """``df`` once for each sentence of ``content``, with its place ``k``."""
    return df.select("*", F.posexplode(sentences(F.col(content), ends)).alias("k", "_s")).withColumn(content, F.col("_s")).drop("_s")


def repair_punctuation(df: DataFrame, key: list[str], order: str, speaker: str, content: str, stop: str = "。", comma: str = "，", marks: str = "。，？！") -> DataFrame:
    """``content`` ended with ``stop`` where the speaker changes next or the key ends, else with ``comma``.

    Texts that end in one of ``marks`` stay as they are.
    """
    nxt = F.lead(speaker).over(Window.partitionBy(*key).orderBy(order))
    mark = F.when(nxt.isNull() | (nxt != F.col(speaker)), stop).otherwise(comma)
    done = F.instr(F.lit(marks), F.substring(content, -1, 1)) > 0
    return df.withColumn(content, F.when(done & (F.length(content) > 0), F.col(content)).otherwise(F.concat(content, mark)))


def windows_of(rows: list[tuple[str, str]], length: int, shift: int) -> list[tuple[int, int, int]]:
    """(number, first, last + 1) of windows over (speaker, sentence) rows.

    From a row on, rows are added until ``length`` characters are reached; the next window begins at the first later
    row by which ``shift`` characters have been passed. The last of these windows is left out; instead one is built
    from the end backwards, whose number skips one.
    """
    n, out, i = len(rows), [], 0
    sizes = [len(t) for _, t in rows]
    while i < n:
        j, size = i, 0
        while j < n and size < length:
            size += sizes[j]
            j += 1
        out.append((len(out), i, j))
        if j >= n and size < length:
            break
        k, moved = i + 1, 0
        while k < n:
            moved += sizes[k]
            if moved >= shift:
                break
            k += 1
        if k >= n:
            break
        i = k
    head = out[:-1]
    j, size = n, 0
    while j > 0 and size < length:
        j -= 1
        size += sizes[j]
    return [*head, (len(head) + 2 if head else 2, j, n)] if n else []


def _grouped(df: DataFrame, key: str, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return df.groupBy(key).applyInPandas(run, schema)


def dialogue_windows(df: DataFrame, utt: str, seq: str, speaker: str, text: str, length: int = 96, shift: int = 32) -> DataFrame:
    """(utt, window, sentence, label): windows of a dialogue's sentences; label: whether more than one speaker talks."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows = list(g.sort_values(seq)[[speaker, text]].itertuples(index=False, name=None))
        out = [(g[utt].iloc[0], k, "".join(t for _, t in rows[a:b]), len({s for s, _ in rows[a:b]}) > 1) for k, a, b in windows_of(rows, length, shift)]
        return pd.DataFrame(out, columns=[utt, "window", "sentence", "label"])

    kind = df.schema[utt].dataType.simpleString()
    return _grouped(df.select(utt, seq, speaker, text), utt, run, f"`{utt}` {kind}, window int, sentence string, label boolean")


def turn_windows(df: DataFrame, utt: str, seq: str, speaker: str, text: str, length: int = 96, shift: int = 32) -> DataFrame:
    """(utt, window, sentence, change_points, n_speakers, speaker_labels): the same windows with what changes where.

    Change points are the places at which another speaker begins; labels, one a character, number speakers as seen.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows = list(g.sort_values(seq)[[speaker, text]].itertuples(index=False, name=None))
        out = []
        for k, a, b in windows_of(rows, length, shift):
            code: dict[str, int] = {}
            points, labels, at = [], [], 0
            for n, (s, t) in enumerate(rows[a:b]):
                if n and s != rows[a + n - 1][0]:
                    points.append(at)
                labels += [code.setdefault(s, len(code))] * len(t)
                at += len(t)
            out.append((g[utt].iloc[0], k, "".join(t for _, t in rows[a:b]), points, len(code), labels))
        return pd.DataFrame(out, columns=[utt, "window", "sentence", "change_points", "n_speakers", "speaker_labels"])

    kind = df.schema[utt].dataType.simpleString()
    return _grouped(df.select(utt, seq, speaker, text), utt, run, f"`{utt}` {kind}, window int, sentence string, change_points array<int>, n_speakers int, speaker_labels array<int>")


def change_labels(text: Column, points: Column, marks: str, length: int | None = None) -> Column:
    """A label for each character, or each of the first ``length``: 1 before a change point, else 0 at a mark, else -100.

    The text is cut into characters once, so that a long text costs in proportion to its length.
    """
    chars = F.split(text, "")
    chars = chars if length is None else F.slice(chars, 1, length)
    at = lambda c, i: F.when(F.array_contains(points, (i + 1).cast("int")), 1).when(F.instr(F.lit(marks), c) > 0, 0).otherwise(-100)
    return F.when(F.length(text) > 0, F.transform(chars, at)).otherwise(F.array().cast("array<int>"))


def with_bars(text: Column, labels: Column) -> Column:
    """The text with a bar after every character whose label is 1.

    Text and labels are cut and made once and meet item by item, so that a long text costs in proportion to its length.
    """
    barred = F.zip_with(F.split(text, ""), F.coalesce(labels, F.array().cast("array<int>")), lambda c, label: F.when(label == 1, F.concat(c, F.lit("|"))).otherwise(c))
    return F.when(F.length(text) > 0, F.array_join(barred, "")).otherwise("")


def overlap_rank(spans: DataFrame, segments: DataFrame, key: list[str], span: list[str]) -> DataFrame:
    """(key..., span..., speaker, ov, rank): speakers by the time in which their segments overlap a span.

    ``segments``: key..., seq, st, ed, speaker. Ties go to the speaker whose segment comes first.
    """
    pairs = overlap_join(spans, segments, key)
    pairs = pairs.select(*[F.col(f"a.{k}").alias(k) for k in [*key, *span]], F.col("b.speaker").alias("speaker"), F.col("b.seq").alias("seq"), "ov")
    sums = pairs.groupBy(*key, *span, "speaker").agg(F.sum("ov").alias("ov"), F.min("seq").alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*key, *span).orderBy(F.col("ov").desc(), "_first"))
    return sums.withColumn("rank", rank).drop("_first")


def attribute_words(words: DataFrame, segments: DataFrame, key: list[str], unknown: str = "0") -> DataFrame:
    """``words`` (key..., sentence, word, st, ed, text) with the speaker of each.

    A word's speaker is its sentence's main speaker if they overlap, else the one who overlaps the word most, else the
    last speaker of the sentences before, and ``unknown`` at first.
    """
    whole = words.groupBy(*key, "sentence").agg(F.min("st").alias("st"), F.max("ed").alias("ed"))
    main = overlap_rank(whole, segments, key, ["sentence"]).where("rank = 1").select(*key, "sentence", F.col("speaker").alias("main"))
    each = overlap_rank(words, segments, key, ["sentence", "word"]).join(main, [*key, "sentence"], "left")
    pick = F.row_number().over(Window.partitionBy(*key, "sentence", "word").orderBy(F.coalesce(F.col("speaker") == F.col("main"), F.lit(False)).desc(), "rank"))
    best = each.withColumn("_p", pick).where("_p = 1").select(*key, "sentence", "word", F.col("speaker").alias("own"))
    rows = words.join(best, [*key, "sentence", "word"], "left")
    ends = rows.groupBy(*key, "sentence").agg(F.max_by(F.struct("own"), "word").alias("x"))
    ahead = Window.partitionBy(*key).orderBy("sentence").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*key, "sentence", F.last(F.col("x.own"), True).over(ahead).alias("carried"))
    return rows.join(ends, [*key, "sentence"]).withColumn("speaker", F.coalesce("own", "carried", F.lit(unknown))).drop("own", "carried")


def merge_words(df: DataFrame, key: list[str], seq: str, speaker: str = "speaker", text: str = "text", max_gap: float = 2.0) -> DataFrame:
    """(key..., speaker, st, ed, text): neighbouring words of one speaker with gaps below ``max_gap`` put together."""
    w = Window.partitionBy(*key).orderBy(seq)
    rows = df.withColumns({"_ps": F.lag(speaker).over(w), "_pe": F.lag("ed").over(w)})
    rows = islands(rows, key, F.col("_ps").isNull() | (F.col("_ps") != F.col(speaker)) | (F.col("st") >= F.col("_pe") + max_gap), seq)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("q"), F.col(text).alias("t")))), lambda s: s["t"]), "")
    out = rows.groupBy(*key, "island", F.col(speaker).alias("speaker")).agg(F.min("st").alias("st"), F.max("ed").alias("ed"), joined.alias("text"))
    return out.drop("island")


def smoothed_scores(df: DataFrame, key: list[str], frame: str, score: str) -> DataFrame:
    """``df`` with the mean score of two frames on either side; a key's last frame is never part of one."""
    last = F.max(frame).over(Window.partitionBy(*key))
    near = Window.partitionBy(*key).orderBy(frame).rowsBetween(-2, 2)
    return df.withColumn("_x", F.when(F.col(frame) < last, F.col(score))).withColumn("smoothed", F.avg("_x").over(near)).drop("_x")


def filled_track(df: DataFrame, key: list[str], frame: str, value: str) -> DataFrame:
    """(key..., frame, value) for every frame from a key's first to its last; missing ones are interpolated."""
    w = Window.partitionBy(*key).orderBy("f0")
    rows = df.select(*key, F.col(frame).alias("f0"), F.col(value).alias("v0"))
    rows = rows.withColumns({"f1": F.lead("f0").over(w), "v1": F.lead("v0").over(w)})
    rows = rows.withColumn(frame, F.explode(F.sequence(F.col("f0"), F.coalesce(F.col("f1") - 1, F.col("f0")))))
    share = (F.col(frame) - F.col("f0")) / (F.col("f1") - F.col("f0"))
    return rows.select(*key, frame, F.coalesce(F.col("v0") + share * (F.col("v1") - F.col("v0")), F.col("v0")).alias(value))


def running_depth(df: DataFrame, key: list[str], time: str, step: str) -> DataFrame:
    return df.withColumn("depth", F.sum(step).over(upto(key, time)))


#: Fixed value: each of these characters ends or joins clauses.
CLAUSE_MARKS = r'[,.!?;:"\-—…、，。！？；：“”‘’]'


def realigned(df: DataFrame, text: str, raw: str, times: str | None = None) -> DataFrame:
    """A row for each word of ``raw`` (blanks between): its ``idx``, ``piece`` of ``text``, ``sentence`` and, of ``times``, its item.

    ``text`` is the same words with capitals and marks. Without blanks and marks both must be equal but for capitals; then
    running sums of word lengths say at which letter a word begins, and a piece goes from there to the next word's first
    letter. Rows that don't fit, texts that begin with a mark, words of marks only, or times that aren't as many as the
    words give none; so do nulls. A sentence ends with a piece whose last character is a mark. Column functions do all of
    it; a row is an utterance, as its words are one array.
    """
    mark = lambda c: F.instr(F.lit(CLAUSE_MARKS), c) > 0
    bare = lambda c: F.translate(F.lower(c), CLAUSE_MARKS + " ", "")
    t = F.col(text)
    words = F.filter(F.split(raw, r"\s+"), lambda w: w != "")
    letters = F.filter(F.transform(F.split(t, ""), lambda c, i: F.when(~mark(c) & (c != " "), i + 1)), lambda i: i.isNotNull())
    begins = F.aggregate(words, F.array(F.lit(0)), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(bare(w)))))
    fits = (bare(t) == bare(F.array_join(words, ""))) & F.forall(words, lambda w: bare(w) != "") & ~mark(F.substring(F.ltrim(t), 1, 1))

    def piece(at: Column, of: Column, i: Column) -> Column:
        first = F.when(i == 0, 1).otherwise(F.get(at, F.get(of, i)))
        return F.substring(t, first, F.coalesce(F.get(at, F.get(of, i + 1)), F.length(t) + 1) - first)

    cut = vectors.let(letters, lambda at: vectors.let(begins, lambda of: F.transform(words, lambda w, i: piece(at, of, i))))
    # a piece with the number of sentences that ended before it
    ended = lambda acc: F.when(F.size(acc) == 0, 0).otherwise(F.element_at(acc, -1)["sentence"] + mark(F.substring(F.element_at(acc, -1)["piece"], -1, 1)).cast("int"))
    none = F.array().cast("array<struct<piece:string,sentence:int>>")
    counted = F.aggregate(cut, none, lambda acc, p: F.concat(acc, F.array(F.struct(p.alias("piece"), ended(acc).cast("int").alias("sentence")))))
    rows = df.where(fits).withColumn("_p", counted)
    if times:
        rows = rows.where(F.size("_p") == F.size(times)).withColumn("_p", F.zip_with("_p", times, lambda p, t: F.struct(p["piece"].alias("piece"), p["sentence"].alias("sentence"), t.alias("time"))))
    keep = [c for c in df.columns if c not in (text, raw, times)]
    return rows.select(*keep, F.posexplode("_p").alias("idx", "_p")).select(*keep, "idx", "_p.*")
