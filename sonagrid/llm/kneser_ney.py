"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

The corpus is dealt into blocks of whole documents. Each block asks for its distinct n-grams once; the answers are
computed by joins of the count tables, sharded by n-gram, and go back to the block, where documents are scored. So what
moves is one row for each n-gram and block, however often the n-gram stands there, and each text once, compressed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, numbered, pick, prepare, released, small, stored, trim

ORDER = 5
#: Marks before and after a text.
BEGIN, END = "\x02", "\x03"
#: Characters handled at once.
PART = 1 << 18
#: One in so many trusted documents is left out of training and sets the thresholds instead.
HELD_OUT = 5
#: Quantile of a language's held-out perplexities up to which documents are kept, and the room beyond it.
QUANTILE, ROOM = 0.995, 1.1
#: Every document counts as if it had so many characters more, of its language's median; so short ones judge little.
PRIOR = 150

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def padded(text: str, order: int) -> str:
    return BEGIN * (order - 1) + text + END


def codes_of(text: str, order: int) -> np.ndarray:
    """A 64-bit code of the n-gram that begins at each place of ``text``."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(x) - order + 1
    h = np.zeros(n, np.uint64)
    for k in range(order):
        h += (x[k : k + n] + np.uint64(k + 1)) * _FACTORS[k]
        h ^= h >> np.uint64(29)
        h *= _MIX
    return h ^ (h >> np.uint64(32))


def parts_of(texts: list[str], order: int) -> Iterator[tuple[int, int, str]]:
    """(first, last + 1, padded texts in one string) of runs of whole texts; a long text is a run of its own."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(padded(t, order))
        size += len(held[-1])
        if size >= PART:
            yield first, i + 1, "".join(held)
            first, held, size = i + 1, [], 0
    if held:
        yield first, len(texts), "".join(held)


class Grams:
    """Distinct n-grams of texts with their numbers in trusted ones."""

    def __init__(self, order: int):
        self.order = order
        self.codes = np.empty(0, np.uint64)
        self.counts = np.empty(0, np.int64)
        self.texts: list[str] = []

    def add(self, texts: list[str], trusted: list[bool]) -> None:
        n = self.order
        for first, last, run in parts_of(texts, n):
            code = codes_of(run, n)
            weight = np.zeros(len(code), np.int64)
            at = 0
            inside = np.zeros(len(code), bool)
            for t, good in zip(texts[first:last], trusted[first:last], strict=True):
                inside[at : at + len(t) + 1] = True
                if good:
                    weight[at : at + len(t) + 1] = 1
                at += len(t) + n
            where = np.flatnonzero(inside)
            number, distinct = pd.factorize(code[where])
            counts = np.bincount(number, weights=weight[where], minlength=len(distinct)).astype(np.int64)
            place = np.empty(len(distinct), np.int64)
            place[number[::-1]] = where[::-1]
            known = pd.Index(self.codes).get_indexer(distinct)
            new = known < 0
            self.counts[known[~new]] += counts[~new]
            self.codes = np.concatenate([self.codes, distinct[new]])
            self.counts = np.concatenate([self.counts, counts[new]])
            self.texts += [run[p : p + n] for p in place[new].tolist()]


def block_grams(docs: DataFrame, order: int) -> DataFrame:
    """block, gram, n: the distinct n-grams of each partition of ``docs`` (text, trusted), with trusted counts."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(order)
        for batch in batches:
            grams.add([t or "" for t in batch.column(0).to_pylist()], [bool(t) for t in batch.column(1).to_pylist()])
        block = TaskContext.get().partitionId()
        table = pa.table({"block": pa.array(np.full(len(grams.texts), block, np.int32)), "gram": pa.array(grams.texts, pa.string()), "n": pa.array(grams.counts, pa.int64())})
        yield from table.sort_by("gram").to_batches(max_chunksize=100_000)  # in order they take half the room

    return docs.select("text", "trusted").mapInArrow(run, "block int, gram string, n long")


def last(gram: Column | str, n: int) -> Column:
    return F.substring(gram, -n, n)


def log_probabilities(grams: DataFrame, order: int) -> DataFrame:
    """gram and logp for every distinct n-gram of ``grams`` (gram, n), from a model of those counts.

    Lower orders count how many different characters come before (continuation counts). Each order has three discounts
    from its counts of counts; what they take off goes to the next lower order, at last to a uniform one over the
    characters seen and one more. All tables are joined by n-gram or context, so they are sharded by it.
    """
    counts = {order: stored(grams.where("n > 0").groupBy("gram").agg(F.sum("n").alias("c")), "counts")}
    for k in range(order - 1, 0, -1):
        counts[k] = stored(counts[k + 1].groupBy(last("gram", k).alias("gram")).agg(F.count(F.lit(1)).alias("c")), "counts")
    sums = [t.agg(F.lit(k).alias("k"), *[F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)], F.count(F.lit(1)).alias("types"), F.sum("c").alias("total")) for k, t in counts.items()]
    table = sums[0]
    for s in sums[1:]:
        table = table.union(s)
    of = {r["k"]: r for r in table.collect()}
    base = -math.log(of[1]["types"] + 1)
    out = stored(grams.select("gram").distinct(), "wanted").withColumn("p", F.lit(math.exp(base)))
    for k in range(1, order + 1):
        n1, n2, n3, n4 = (max(1, of[k][f"n{i}"] or 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(x, 0.05), i + 0.95) for i, x in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3))]
        t = counts[k].withColumn("ctx", F.expr(f"left(gram, {k - 1})"))
        if k == 1:  # one context only, so no join
            total, types = of[1]["total"] or 1, of[1]["types"]
            some = [of[1]["n1"] or 0, of[1]["n2"] or 0]
            back = sum(a * b for a, b in zip(d, [*some, types - sum(some)], strict=True)) / total if types else 1.0
        ctx = t.groupBy("ctx").agg(F.sum("c").alias("total"), *[F.sum(x.cast("long")).alias(f"m{i}") for i, x in enumerate((F.col("c") == 1, F.col("c") == 2, F.col("c") >= 3))])
        ctx = ctx.select("ctx", "total", ((d[0] * F.col("m0") + d[1] * F.col("m1") + d[2] * F.col("m2")) / F.col("total")).alias("back"))
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        seen = counts[k].select(F.col("gram").alias("g"), (F.col("c") - off).alias("own"))
        out = out.withColumn("g", last("gram", k)).withColumn("ctx", F.expr(f"left(g, {k - 1})"))
        out = out.join(seen, "g", "left")
        out = out.withColumns({"total": F.lit(total), "back": F.lit(back)}) if k == 1 else out.join(ctx, "ctx", "left")
        p = F.coalesce(F.col("own") / F.col("total"), F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("p")
        out = out.select("gram", p.alias("p"))
    return out.select("gram", F.log("p").cast("float").alias("logp"))


def packed(docs: DataFrame) -> DataFrame:
    """block, ids, texts: an Arrow batch of each partition of ``docs`` in one compressed row."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        press = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                sink = pa.BufferOutputStream()
                part = batch.slice(at, 1024)
                with pa.ipc.new_stream(sink, part.schema) as w:
                    w.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([press.compress(sink.getvalue().to_pybytes())], pa.binary())], names=["block", "rows"])

    return docs.mapInArrow(run, "block int, rows binary")


def score(texts: list[str], order: int, codes: np.ndarray, logp: np.ndarray) -> list[float]:
    """Mean log-probability of the characters and the end of each text, given sorted codes with their values."""
    out: list[float] = []
    for first, last_, run in parts_of(texts, order):
        code = codes_of(run, order)
        number, distinct = pd.factorize(code)
        at = np.minimum(np.searchsorted(codes, distinct), len(codes) - 1)
        value = np.where(codes[at] == distinct, logp[at], np.nan)[number]
        begin = 0
        for t in texts[first:last_]:
            out.append(float(np.mean(value[begin : begin + len(t) + 1])))
            begin += len(t) + order
    return out


def perplexities(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, lang, trusted, held_out, n_chars and perplexity for rows of doc_id, lang, text, trusted, held_out.

    ``docs`` is scanned twice and must be dealt into partitions alike each time, as a stored table is; if it isn't, the
    block that misses an n-gram fails and nothing wrong comes out.
    """
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", "lang", "text", "trusted", "held_out")
    asked = stored(block_grams(rows.select("text", (F.col("trusted") & ~F.col("held_out")).alias("trusted")), order), "grams")
    answers = asked.select("block", "gram").join(log_probabilities(asked.select("gram", "n"), order), "gram")

    kind = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("trusted", pa.bool_()), ("held_out", pa.bool_()), ("n_chars", pa.int64()), ("perplexity", pa.float64())])

    def run(blocks: pa.Table, model: pa.Table) -> pa.Table:
        code = codes_of("".join(model.column("gram").to_pylist()), order)[::order] if model.num_rows else np.zeros(1, np.uint64)
        value = model.column("logp").to_numpy().astype(float) if model.num_rows else np.full(1, np.nan)
        rank = np.argsort(code, kind="stable")
        code, value = code[rank], value[rank]
        out = []
        for row in blocks.column("rows"):
            with pa.ipc.open_stream(zstandard.decompress(row.as_py())) as r:
                for part in r:
                    texts = [t or "" for t in part.column("text").to_pylist()]
                    mean = np.array(score(texts, order, code, value))
                    if np.isnan(mean).any():
                        raise RuntimeError("a block holds n-grams that it has not asked for: its rows changed between two scans")
                    same = [part.column(n) for n in ("doc_id", "lang", "trusted", "held_out")]
                    out.append(pa.RecordBatch.from_arrays([*same, pa.array([len(t) for t in texts], pa.int64()), pa.array(np.exp(-mean), pa.float64())], schema=kind))
        trim()
        return pa.Table.from_batches(out, schema=kind)

    result = "doc_id long, lang string, trusted boolean, held_out boolean, n_chars long, perplexity double"
    return packed(rows).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, result)


def by_language(probe: DataFrame, column: str, at: float) -> tuple[DataFrame, float | None]:
    """(of, value) by lang, and the value over all languages, of a quantile of ``column``; sketches merge map-side."""
    value = F.percentile_approx(column, at, 10_000).alias("value")
    table = stored(probe.groupBy(F.col("lang").alias("of")).agg(value), "quantiles")
    return small(table, table.count()), probe.agg(value).first()["value"]


def classify(docs: DataFrame, labels: DataFrame, *, order: int = ORDER, quantile: float = QUANTILE, room: float = ROOM) -> DataFrame:
    """Perplexity of each whole text and whether it is kept, one row for each row of ``docs``.

    Needs doc_id, lang and text; ``labels`` needs doc_id, quality and toxic. Trusted are documents that some label
    calls good (quality 1) and none calls bad or toxic. All of them train the model, but for one in HELD_OUT, chosen by
    a hash of doc_id, which set the thresholds. A document's rating is its perplexity with PRIOR characters of its
    language's held-out median; it is kept if that is at most ``room`` times the ``quantile`` of its language's held-out
    ratings. A language (null is one, too) without held-out documents uses those of all; without any, all are kept.
    Returns doc_id, lang, n_chars, perplexity, rating, limit, kept. A null text counts as empty; an empty text is kept,
    with the perplexity of an end alone. Rows with null or repeated doc_ids are scored each; other columns are ignored.
    Without trusted text every perplexity is that of the uniform model.
    """
    tags = pick(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id")
    good = tags.agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0").select(F.col("doc_id").cast("long").alias("good"))
    good = stored(good, "trusted")
    labelled = good.count()
    rows = pick(docs, "doc_id", "lang", "text").select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text")
    rows = rows.join(small(good, labelled), F.col("doc_id") == F.col("good"), "left")
    out_of = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(HELD_OUT)) == 0
    trusted = F.col("good").isNotNull() & (F.coalesce(F.col("text"), F.lit("")) != "")
    rows = rows.select("doc_id", "lang", "text", trusted.alias("trusted"), F.coalesce(out_of, F.lit(False)).alias("held_out"))
    if labelled > BROADCAST_ROWS or "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        rows = stored(rows, "documents")  # after a shuffle the two scans could differ
    scored = stored(perplexities(rows, order), "scored")
    probe = scored.where("trusted and held_out")
    middle, overall = by_language(probe, "perplexity", 0.5)
    scored = scored.join(middle, F.col("lang").eqNullSafe(F.col("of")), "left")
    usual = F.coalesce(F.col("value"), F.lit(overall), F.col("perplexity"))
    n = F.col("n_chars") + 1
    rating = F.exp((F.log("perplexity") * n + F.log(usual) * PRIOR) / (n + PRIOR))
    rated = scored.select("doc_id", "lang", "n_chars", "perplexity", rating.alias("rating"), "trusted", "held_out")
    top, overall = by_language(rated.where("trusted and held_out"), "rating", quantile)
    out = rated.join(top, F.col("lang").eqNullSafe(F.col("of")), "left")
    out = out.withColumn("limit", room * F.coalesce(F.col("value"), F.lit(overall), F.lit(math.inf)))
    return out.select("doc_id", "lang", "n_chars", "perplexity", "rating", "limit", ((F.col("n_chars") == 0) | (F.col("rating") <= F.col("limit"))).alias("kept"))


def filtered(docs: DataFrame, labels: DataFrame, **how: float) -> DataFrame:
    """``docs`` without the documents that ``classify`` rejects; all columns are kept.

    A document goes if every row of its doc_id is rejected; rows with a null doc_id stay. Names of other columns may
    repeat or differ in case only.
    """
    got = stored(classify(docs, labels, **how).select("doc_id", "kept"), "classes")
    gone = got.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias("gone"))
    gone = stored(gone, "gone")
    flat, names = numbered(docs)
    return flat.join(small(gone, gone.count()), F.col(f"c{names.index('doc_id')}").cast("long") == F.col("gone"), "left_anti").toDF(*names)
