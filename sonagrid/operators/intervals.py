"""Time-interval algebra over rows of (key..., seq, st, ed): windows and joins, no row-at-a-time code.

Times are seconds as doubles. ``seq`` gives rows with equal starts a total order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIE = 1e-8


def keyed(key: list[str]) -> Window:
    return Window.partitionBy(*key)


def before(key: list[str], *order: str) -> Window:
    return keyed(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def upto(key: list[str], *order: str) -> Window:
    return keyed(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def islands(df: DataFrame, key: list[str], begins: Column, *order: str) -> DataFrame:
    """``df`` with ``island``: numbers runs, each from a row for which ``begins`` holds up to the next such row."""
    flagged = df.withColumn("_begins", F.coalesce(begins, F.lit(True)).cast("int"))
    return flagged.withColumn("island", F.sum("_begins").over(upto(key, *order))).drop("_begins")


def merge_intervals(df: DataFrame, key: list[str], mode: str = "max") -> DataFrame:
    """Merged intervals (key..., st, ed) of rows (key..., seq, st, ed).

    ``max``: the union of intervals; those that touch merge. ``last``: a new one begins after a gap to the previous
    row's end, and ends where its last row ends, even if an earlier row ended later. ``last_drop``: the same without
    the last row of each key, so a single row gives nothing.
    """
    if mode == "max":
        reach = F.max("ed").over(before(key, "st", "ed"))
        rows = islands(df.withColumn("_reach", reach), key, F.col("_reach").isNull() | (F.col("_reach") < F.col("st")), "st", "ed")
        return rows.groupBy(*key, "island").agg(F.min("st").alias("st"), F.max("ed").alias("ed")).drop("island")
    if mode not in ("last", "last_drop"):
        raise ValueError(f"unknown mode {mode!r}")
    order = keyed(key).orderBy("st", "seq")
    rows = df
    if mode == "last_drop":
        rows = df.withColumn("_next", F.lead("seq").over(order)).where("_next is not null").drop("_next")
    rows = rows.withColumn("_end", F.lag("ed").over(order))
    rows = islands(rows, key, F.col("_end").isNull() | (F.col("st") > F.col("_end")), "st", "seq")
    place = F.struct("st", "seq")
    return rows.groupBy(*key, "island").agg(F.min("st").alias("st"), F.max_by("ed", place).alias("ed")).drop("island")


def compress_labels(df: DataFrame, key: list[str], label: str = "label") -> DataFrame:
    """Labelled chunks in order of seq put together: (key..., st, ed, label).

    A chunk with the label of the one before it that starts no later than that ends extends it; overlapping chunks of
    different labels are both cut in the middle of the overlap; else a new one begins.
    """
    order = keyed(key).orderBy("seq")
    rows = df.select(*key, "seq", "st", "ed", F.col(label).alias("label"))
    rows = rows.withColumns({"_pe": F.lag("ed").over(order), "_pl": F.lag("label").over(order), "_ns": F.lead("st").over(order), "_nl": F.lead("label").over(order)})
    start = F.when((F.col("_pl") != F.col("label")) & (F.col("st") < F.col("_pe")), (F.col("_pe") + F.col("st")) / 2).otherwise(F.col("st"))
    end = F.when((F.col("_nl") != F.col("label")) & (F.col("_ns") < F.col("ed")), (F.col("ed") + F.col("_ns")) / 2).otherwise(F.col("ed"))
    begins = F.col("_pl").isNull() | (F.col("_pl") != F.col("label")) | (F.col("st") > F.col("_pe"))
    rows = islands(rows.withColumns({"_s": start, "_e": end}), key, begins, "seq")
    out = rows.groupBy(*key, "island", "label").agg(F.min_by("_s", "seq").alias("st"), F.max_by("_e", "seq").alias("ed"))
    return out.select(*key, "st", "ed", "label")


def sliding_chunks(df: DataFrame, dur: float = 1.5, step: float = 0.75) -> DataFrame:
    """``df`` with st and ed of chunks of ``dur`` every ``step`` while ``st + dur < ed + step``, and their number k."""
    span = F.greatest(F.lit(0), F.ceil((F.col("ed") - F.col("st") - dur + step) / step) + 1).cast("int")
    rows = df.withColumn("k", F.explode(F.sequence(F.lit(0), span)))
    at = F.col("st") + F.col("k") * step
    rows = rows.where(at + dur < F.col("ed") + step)
    return rows.withColumns({"ed": F.least(at + dur, F.col("ed")), "st": at})


def chunk_count(dur: Column, seg: float) -> Column:
    return F.greatest(F.lit(1), F.floor(dur / seg)).cast("int")


def fixed_chunks(df: DataFrame, dur: str, seg: float = 3.0) -> DataFrame:
    """``df`` with start and stop of whole chunks of ``seg``; a shorter recording gives one, a remainder none."""
    rows = df.withColumn("k", F.explode(F.sequence(F.lit(0), chunk_count(F.col(dur), seg) - 1)))
    return rows.withColumns({"start": F.col("k") * seg, "stop": F.least(F.col("k") * seg + seg, F.col(dur))})


def stepped_clips(df: DataFrame, dur: str, clip: float = 5.0, step: float = 3.0) -> DataFrame:
    """``df`` with clips [start, start + clip] every ``step`` while ``start < dur - clip``."""
    n = F.greatest(F.lit(0), F.ceil((F.col(dur) - clip) / step) + 1).cast("int")
    rows = df.withColumn("k", F.explode(F.sequence(F.lit(0), n)))
    return rows.withColumn("start", F.col("k") * step).where(F.col("start") < F.col(dur) - clip).withColumn("stop", F.col("start") + clip)


def active_runs(df: DataFrame, key: list[str], frame: str, time: str, count: str) -> DataFrame:
    """Runs of frames with ``count`` above 0: from the first one's time to that of the next frame, or the last one.

    A run that begins at the last frame gives nothing.
    """
    order = keyed(key).orderBy("f")
    rows = df.select(*key, F.col(frame).alias("f"), F.col(time).alias("t"), (F.col(count) > 0).alias("on"))
    rows = rows.withColumns({"_t": F.lead("t").over(order), "_was": F.lag("on").over(order), "_last": F.max("f").over(keyed(key))})
    rows = islands(rows, key, F.col("on") & ~F.coalesce("_was", F.lit(False)), "f").where("on")
    out = rows.groupBy(*key, "island").agg(F.min("t").alias("st"), F.max_by(F.coalesce("_t", "t"), "f").alias("ed"), F.min("f").alias("f0"), F.max("_last").alias("f1"))
    return out.where("f0 < f1").select(*key, "st", "ed")


def frames_to_segments(df: DataFrame, key: list[str], frame: str, time: str, active: str, threshold: float = 0.5) -> DataFrame:
    """Runs with ``active`` above ``threshold``: from the first frame's time to that of the first frame not above it.

    A frame exactly at the threshold neither opens nor closes a run; a run open at the end closes at the last frame.
    """
    rows = df.select(*key, F.col(frame).alias("f"), F.col(time).alias("t"), F.col(active).alias("x"))
    state = F.when(F.col("x") > threshold, 1).when(F.col("x") < threshold, 0)
    rows = rows.withColumn("on", F.coalesce(F.last(state, True).over(upto(key, "f")), F.lit(0)))
    order = keyed(key).orderBy("f")
    rows = rows.withColumns({"_t": F.lead("t").over(order), "_was": F.lag("on").over(order)})
    rows = islands(rows, key, (F.col("on") == 1) & (F.coalesce("_was", F.lit(0)) == 0), "f").where("on = 1")
    out = rows.groupBy(*key, "island").agg(F.round(F.min("t"), 3).alias("st"), F.round(F.max_by(F.coalesce("_t", "t"), "f"), 3).alias("ed"))
    return out.drop("island")


def label_runs(df: DataFrame, key: list[str], time: str, label: str, gap: float) -> DataFrame:
    """Runs of one label among time points, broken by a label change or a gap over ``gap``; (key..., st, ed, label).

    A run shorter than 1e-4 is dropped unless it is the key's last.
    """
    order = keyed(key).orderBy("t")
    rows = df.select(*key, F.col(time).alias("t"), F.col(label).alias("label"))
    rows = rows.withColumns({"_pt": F.lag("t").over(order), "_pl": F.lag("label").over(order)})
    begins = F.col("_pt").isNull() | (F.col("_pl") != F.col("label")) | (F.col("t") - F.col("_pt") > gap + 1e-4)
    runs = islands(rows, key, begins, "t").groupBy(*key, "island", "label").agg(F.min("t").alias("st"), F.max("t").alias("ed"))
    runs = runs.withColumn("_last", F.max("island").over(keyed(key)))
    return runs.where((F.col("ed") - F.col("st") >= 1e-4) | (F.col("island") == F.col("_last"))).select(*key, "st", "ed", "label")


def overlap(a: str = "a", b: str = "b") -> Column:
    return F.least(F.col(f"{a}.ed"), F.col(f"{b}.ed")) - F.greatest(F.col(f"{a}.st"), F.col(f"{b}.st"))


def cells(df: DataFrame, width: float) -> DataFrame:
    """``df`` once for each cell of time that a row touches; equal cells turn a range join into an equi-join."""
    first, last = F.floor(F.col("st") / width), F.floor(F.col("ed") / width)
    return df.withColumn("cell", F.explode(F.sequence(first, F.greatest(first, last))))


def overlap_join(a: DataFrame, b: DataFrame, key: list[str], width: float = 300.0, *, closed: bool = False) -> DataFrame:
    """Pairs of rows of one key that overlap (with ``closed`` also those that touch), as columns aliased a and b, with ov.

    Rows meet in cells of ``width`` seconds, each pair in the cell where its overlap begins, so no key's rows are all
    compared with each other.
    """
    x, y = cells(a, width).alias("a"), cells(b, width).alias("b")
    same = reduce(lambda p, q: p & q, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*key, "cell"]])
    if closed:
        hit = (F.col("a.ed") >= F.col("b.st")) & (F.col("b.ed") >= F.col("a.st"))
    else:
        hit = (F.col("a.ed") > F.col("b.st")) & (F.col("b.ed") > F.col("a.st"))
    once = F.floor(F.greatest(F.col("a.st"), F.col("b.st")) / width) == F.col("a.cell")
    return x.join(y, same & hit & once).withColumn("ov", overlap())


def overlap_speakers(a: DataFrame, v: DataFrame, key: list[str], min_frac: float = 0.5, min_sec: float = 0.5) -> DataFrame:
    """(key..., label, vlabel, ov): speakers of ``v`` that each label of ``a`` overlaps for long enough.

    Long enough is over the lesser of ``min_sec`` and ``min_frac`` of the ``v`` speaker's time.
    """
    total = v.groupBy(*key, F.col("label").alias("vlabel")).agg(F.sum(F.col("ed") - F.col("st")).alias("dur"))
    pairs = overlap_join(a, v, key).select(*[F.col(f"a.{k}").alias(k) for k in key], F.col("a.label").alias("label"), F.col("b.label").alias("vlabel"), "ov")
    sums = pairs.groupBy(*key, "label", "vlabel").agg(F.sum("ov").alias("ov")).join(total, [*key, "vlabel"])
    return sums.where(F.col("ov") > F.least(min_frac * F.col("dur"), F.lit(min_sec))).select(*key, "label", "vlabel", "ov")


def atoms(uem: DataFrame, ref: DataFrame, sys: DataFrame, key: list[str]) -> DataFrame:
    """The evaluated time cut at every boundary of ``uem``, ``ref`` and ``sys`` (key..., st, ed, and speaker but in uem).

    Returns key..., st, ed, n_ref, n_sys and arrays ref and sys of the speakers that are active in each piece. Depths
    come from running sums of signed events; each speaker's time is spread over the numbered pieces between the
    boundaries at which it begins and ends, so nothing is compared with what it doesn't touch.
    """
    marks = [(uem, "u", F.lit("")), (ref, "r", F.col("speaker")), (sys, "s", F.col("speaker"))]
    ends = F.explode(F.array(F.struct(F.col("st").alias("t"), F.lit(1).alias("step")), F.struct(F.col("ed").alias("t"), F.lit(-1).alias("step"))))
    events = []
    for rows, kind, speaker in marks:
        both = rows.select(*key, F.lit(kind).alias("kind"), speaker.alias("speaker"), ends.alias("e"))
        events.append(both.select(*key, "e.t", "kind", "speaker", "e.step"))
    every = reduce(DataFrame.union, events).groupBy(*key, "t", "kind", "speaker").agg(F.sum("step").alias("step"))
    deep = every.withColumn("depth", F.sum("step").over(upto([*key, "kind", "speaker"], "t")))
    deep = deep.withColumn("until", F.lead("t").over(keyed([*key, "kind", "speaker"]).orderBy("t")))
    on = deep.where("depth > 0").select(*key, "kind", "speaker", F.col("t").alias("st"), F.col("until").alias("ed"))
    order = keyed(key).orderBy("t")
    cuts = every.select(*key, "t").distinct().withColumns({"at": F.row_number().over(order), "until": F.lead("t").over(order)})
    place = lambda t, name: cuts.select(*key, F.col("t").alias(t), F.col("at").alias(name))
    spread = on.join(place("st", "a0"), [*key, "st"]).join(place("ed", "a1"), [*key, "ed"])
    spread = spread.select(*key, "kind", "speaker", F.explode(F.sequence(F.col("a0"), F.col("a1") - 1)).alias("at"))
    hits = spread.join(cuts.where(F.col("until") - F.col("t") > TIE), [*key, "at"]).withColumnsRenamed({"t": "st", "until": "ed"})
    of = lambda k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("speaker"))))
    out = hits.groupBy(*key, "st", "ed").agg(F.max((F.col("kind") == "u").cast("int")).alias("u"), of("r").alias("ref"), of("s").alias("sys")).where("u = 1")
    return out.select(*key, "st", "ed", F.size("ref").alias("n_ref"), F.size("sys").alias("n_sys"), "ref", "sys")


def extent(ref: DataFrame, key: list[str]) -> DataFrame:
    """The default evaluated time: from the first start to the last end of each key."""
    return ref.groupBy(*key).agg(F.min("st").alias("st"), F.max("ed").alias("ed"))


def deeper(events: DataFrame, key: list[str], least: int) -> DataFrame:
    """Where the running sum of ``step`` over events (key..., t, step) is at least ``least``: (key..., st, ed)."""
    at = events.groupBy(*key, "t").agg(F.sum("step").alias("step")).withColumn("depth", F.sum("step").over(upto(key, "t")))
    at = at.withColumn("ed", F.lead("t").over(keyed(key).orderBy("t"))).where((F.col("depth") >= least) & F.col("ed").isNotNull())
    return merge_intervals(at.select(*key, F.col("t").alias("st"), "ed", F.lit(0).alias("seq")), key, "max")


def signed(df: DataFrame, key: list[str], weight: int = 1) -> DataFrame:
    up = df.select(*key, F.col("st").alias("t"), F.lit(weight).alias("step"))
    return up.union(df.select(*key, F.col("ed").alias("t"), F.lit(-weight).alias("step")))


def subtract(uem: DataFrame, holes: DataFrame, key: list[str]) -> DataFrame:
    """``uem`` without ``holes``: with holes weighing as much as any depth, what stays at depth one or more."""
    merged, flat = merge_intervals(uem.withColumn("seq", F.lit(0)), key, "max"), merge_intervals(holes.withColumn("seq", F.lit(0)), key, "max")
    return deeper(signed(merged, key).union(signed(flat, key, -1)), key, 1)


def subtract_collars(uem: DataFrame, ref: DataFrame, key: list[str], collar: float) -> DataFrame:
    """``uem`` without ``collar`` seconds around every boundary of ``ref``."""
    ends = ref.select(*key, F.col("st").alias("t")).union(ref.select(*key, F.col("ed").alias("t")))
    return subtract(uem, ends.select(*key, (F.col("t") - collar).alias("st"), (F.col("t") + collar).alias("ed")), key)


def subtract_overlap(uem: DataFrame, ref: DataFrame, key: list[str]) -> DataFrame:
    """``uem`` without the time in which two or more intervals of ``ref`` are open."""
    return subtract(uem, deeper(signed(ref, key), key, 2), key)
