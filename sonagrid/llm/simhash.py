"""SimHash fingerprints and permuted block tables, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, small, stored

BITS = 64
#: Terms weigh by their length, up to this: short words are mostly function words that all texts share.
HEAVIEST = 8
#: Rows of one run of neighbouring documents, and the most runs.
RUN_ROWS, MOST_RUNS = 4096, 4096
LANES = 0x0000000100000001


def words_of(text: Column) -> Column:
    """Runs without ASCII white space, and empty strings between them."""
    return F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ")


def votes(term: Column) -> list[Column]:
    """Aggregates of the weighted votes of terms: bit i and bit i + 32 are counted in the halves of one long."""
    weight = F.when(term != "", F.least(F.char_length(term), F.lit(HEAVIEST)).cast("long"))
    code = F.xxhash64(F.lower(term))
    lanes = [F.sum(F.shiftrightunsigned(code, i).bitwiseAND(F.lit(LANES)) * weight).alias(f"_v{i}") for i in range(32)]
    return [*lanes, F.sum(weight).alias("_w")]


def fingerprint() -> Column:
    """The long whose bit i is set if more weight voted for it than against; 0 without terms."""
    terms = []
    for i in range(BITS):
        lane = F.col(f"_v{i % 32}")
        ones = F.shiftrightunsigned(lane, 32) if i >= 32 else lane.bitwiseAND(F.lit(0xFFFFFFFF))
        terms.append(F.when(2 * ones > F.col("_w"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)))
    return reduce(lambda a, b: a.bitwiseOR(b), terms).cast("long")


def as_text(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def bounds_upto(bounds: list[int], value: Column) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``: a binary search, by steps that are powers of two."""
    held = F.array(*[F.lit(b) for b in bounds])
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    further = lambda at, step: F.when(F.coalesce(F.get(held, at + step - 1) <= value, F.lit(False)), at + step).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)


def runs_of(docs: DataFrame, rows: int = RUN_ROWS, most: int = MOST_RUNS) -> DataFrame:
    """doc_id, text, run, ghost: rows dealt into runs of neighbouring doc_ids, so that order needs no single task.

    Bounds come from approximate quantiles. The first row of each run (by descending doc_id) is also sent, as a ghost,
    to the run before it, and the first of all to the last run; so each row finds its next in its own run. The runs'
    first ids, at most ``most`` of them, are the only data that the driver sees and that is broadcast.
    """
    spark = docs.sparkSession
    flat = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n = flat.count()
    parts = max(1, min(most, -(-n // rows)))
    bounds: list[int] = []
    if parts > 1:
        got = flat.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
        bounds = sorted(set(got or []))
    run = F.lit(0)
    if bounds:
        run = bounds_upto(bounds, F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    flat = flat.withColumn("run", run)
    tops = sorted((r["run"], r["top"]) for r in flat.groupBy("run").agg(F.max("doc_id").alias("top")).collect())
    ghosts = [(top, tops[(k + 1) % len(tops)][0]) for k, (_, top) in enumerate(tops)]
    firsts = spark.createDataFrame(ghosts, "top long, target int")
    own = F.struct(F.col("run"), F.lit(0).alias("ghost"))
    other = F.struct(F.col("target").alias("run"), F.lit(1).alias("ghost"))
    dealt = flat.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("top")), "left")
    dealt = dealt.withColumn("at", F.explode(F.when(F.col("target").isNull(), F.array(own)).otherwise(F.array(own, other))))
    return dealt.select("doc_id", "text", F.col("at.run").alias("run"), F.col("at.ghost").alias("ghost"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, one row for each row of ``docs``.

    Needs doc_id and text (null: empty). Order is descending doc_id, equal ones by text, null ones last; after the last
    comes the first. The edited text has its last floor(n_chars / 3) code points replaced by the next text's first as
    many. Returns doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (16 hex digits), near_edited and
    near_next (share of bits in which the fingerprint equals the edited text's and the next document's), and code, the
    fingerprint as a long. Terms are words in lower case, weighted by length and number; a text without any has
    fingerprint 0, equal texts have equal ones. An only document is its own next. Other columns are ignored.

    Texts are shuffled once, into runs of neighbours; words are counted where the runs lie. Rows of one doc_id stay in
    one run. All votes of a text are sums of longs, so long texts need no more memory than short ones.
    """
    runs = runs_of(docs).withColumn("tie", F.xxhash64("text")).withColumn("n_chars", F.char_length("text").cast("long"))
    first = Window.partitionBy("run").orderBy(F.col("ghost"), F.col("doc_id").desc(), F.col("tie"), F.col("text"))
    runs = runs.withColumn("n", F.row_number().over(first)).withColumn("after", F.lead("text").over(first))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("after"), F.lit(1), cut))
    runs = runs.withColumn("edited", F.when(F.col("ghost") == 0, edited))
    runs = runs.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))
    key = ["run", "n", "ghost", "doc_id", "tie", "n_chars", "edited_sha256"]
    texts = runs.select(*key, F.explode(F.when(F.col("ghost") == 0, both).otherwise(F.slice(both, 1, 1))).alias("t"))
    terms = texts.select(*key, F.col("t.kind").alias("kind"), F.explode_outer(words_of(F.col("t.text"))).alias("term"))
    codes = terms.groupBy(*key, "kind").agg(*votes(F.col("term"))).select(*key, "kind", fingerprint().alias("code"))
    codes = codes.groupBy(*key).agg(F.max(F.when(F.col("kind") == 0, F.col("code"))).alias("code"), F.max(F.when(F.col("kind") == 1, F.col("code"))).alias("edited_code"))
    codes = codes.withColumn("next_code", F.lead("code").over(Window.partitionBy("run").orderBy("n"))).where("ghost = 0")
    return codes.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("code")).alias("fingerprint"), as_text(F.col("edited_code")).alias("edited_fingerprint"),
        likeness(F.col("code"), F.col("edited_code")).alias("near_edited"), likeness(F.col("code"), F.col("next_code")).alias("near_next"), "code",
    )


def near_fingerprints(codes: DataFrame, *, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs a < b of different fingerprints within ``radius`` bits of each other, with their distance.

    Needs the column code (long; null ones take no part, equal ones count once). The bits are cut into ``blocks``; two
    fingerprints within the radius agree in some blocks - radius of them, so a table for each such choice, keyed by
    those bits alone, brings every pair together. A pair is reported by the first of its tables only. Keys hold about
    half the bits, so that keys shared by many are shared by true neighbours; Spark can split such keys.
    """
    if not 0 <= radius < blocks:
        raise ValueError("radius must be at least 0 and below the number of blocks")
    ends = [BITS * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(ends, ends[1:], strict=False)]
    masks = [sum(block[i] for i in c) for c in combinations(range(blocks), blocks - radius)]
    masks = [m - (1 << BITS) if m >> 63 else m for m in masks]
    distinct = pick(codes, "code").where("code is not null").distinct()
    keyed = distinct.select("code", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("t", "mask"))
    keyed = keyed.select("code", "t", F.col("code").bitwiseAND(F.col("mask")).alias("key"))
    apart = F.col("a.code").bitwiseXOR(F.col("b.code"))
    earliest = F.array_position(F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: m.bitwiseAND(apart) == 0), True) - 1
    meet = (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.code") < F.col("b.code"))
    pairs = keyed.alias("a").join(keyed.alias("b"), meet & (F.bit_count(apart) <= radius) & (earliest == F.col("a.t")))
    return pairs.select(F.col("a.code").alias("a"), F.col("b.code").alias("b"), F.bit_count(apart).alias("distance"))


def neighbours(codes: DataFrame, *, radius: int = 3, blocks: int = 6) -> DataFrame:
    """code and n_near, the number of different other fingerprints within ``radius`` bits, for codes that have any."""
    pairs = near_fingerprints(codes, radius=radius, blocks=blocks)
    return pairs.select(F.explode(F.array("a", "b")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n_near"))


def with_neighbours(docs: DataFrame, *, radius: int = 3, blocks: int = 6) -> DataFrame:
    """``fingerprints`` and n_near, the number of other fingerprints of the table within ``radius`` bits of the row's."""
    got = stored(fingerprints(docs), "fingerprints")
    near = stored(neighbours(got, radius=radius, blocks=blocks).withColumnRenamed("code", "_code"), "neighbours")
    out = got.join(small(near, near.count()), F.col("code") == F.col("_code"), "left").drop("_code")
    return out.withColumn("n_near", F.coalesce("n_near", F.lit(0)))
