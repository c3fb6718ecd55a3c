"""How filters of documents interact: what each removes, step by step, in every order of applying them."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, pick, stored

#: The filters, bit 0 first.
FILTERS = "ABCDE"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that ``text`` fails: short, repetitive, capitals, marks."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    fails = (
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    )
    return reduce(lambda a, b: a + b, [f.cast("int") * (1 << i) for i, f in enumerate(fails)])


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters that they fail.

    Whether a text has a copy with a smaller doc_id is found without joining copies to each other: all rows of a text
    fail E but those of its smallest doc_id. Sums over all rows, and over each text's first rows, which a minimum by
    digest gives, are made before each shuffle, so copies never meet in one task.
    """
    flat = pick(docs, "doc_id", "text", "source").select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    own = flat.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_failures(F.col("text")).alias("mask"))
    marks = pick(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")
    )
    sums = [F.sum(c).alias(c) for c in COUNTS]
    known = own.join(marks, "doc_id", "left").select(*own.columns, F.lit(1).cast("long").alias("n"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS[1:]])
    rows = stored(known.groupBy("doc_id", "digest", "part", "mask").agg(*sums), "audit-rows")
    # rows that repeat a doc_id, in whatever parts, are that text's first rows together
    first = (
        rows.where("doc_id IS NOT NULL").groupBy("digest", "doc_id", "mask").agg(F.collect_list(F.struct("part", *COUNTS)).alias("of"))
        .groupBy("digest").agg(F.min_by(F.struct("mask", "of"), "doc_id").alias("first")).select("first.mask", F.explode("first.of").alias("of"))
        .select("of.part", "mask", *[F.col(f"of.{c}").alias(c) for c in COUNTS])
    )
    first = first.unionByName(rows.where("doc_id IS NULL").select("part", "mask", *COUNTS))
    copies = 1 << FILTERS.index("E")
    again = rows.select("part", (F.col("mask") + copies).alias("mask"), *COUNTS)
    minus = first.select("part", (F.col("mask") + copies).alias("mask"), *[(-F.col(c)).alias(c) for c in COUNTS])
    return first.unionByName(again).unionByName(minus).groupBy("part", "mask").agg(*sums)


def step_measures(cell: Column, bit: Column, gone: Column) -> Column:
    """What one step does to a cell: its filter's ``bit``, and whether an earlier step has removed the cell's documents."""
    fails = cell["mask"].bitwiseAND(bit) != 0
    of = lambda when, count: F.when(when, cell[count]).otherwise(F.lit(0).cast("long"))
    return F.struct(
        of(~gone & ~fails, "n").alias("kept"),
        of(~gone & fails, "n").alias("removed"),
        of(gone & fails, "n").alias("redundant"),
        of(cell["mask"] == bit, "n").alias("unique_fails"),
        of(~gone & fails, "good").alias("good_lost"),
        of(~gone & fails, "toxic").alias("toxic_lost"),
    )


def folded(cell: Column, orders: Column) -> Column:
    """All steps of all orders for one cell, one struct each: a fold along each order that remembers what is gone."""

    def along(order: Column) -> Column:
        none = F.array().cast("array<struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">>")
        start = F.struct(F.lit(False).alias("gone"), none.alias("steps"))
        step = lambda a, bit: F.struct(
            (a["gone"] | (cell["mask"].bitwiseAND(bit) != 0)).alias("gone"), F.concat(a["steps"], F.array(step_measures(cell, bit, a["gone"]))).alias("steps")
        )
        return F.aggregate(order, start, step, lambda a: a["steps"])

    return F.flatten(F.transform(orders, along))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), 600 rows a part.

    Documents are first counted by part and the set of filters that they fail, at most 32 cells a part. Each cell folds
    across a constant array of all orders; the cells' arrays are added element by element. Null text counts as empty,
    null source as the part ''. A null doc_id has no copy before it and is none; rows that repeat a doc_id count each,
    and don't make copies of each other. Of labels that repeat a doc_id, any 1 counts. Tables may have other columns,
    also with clashing names; a table without rows has no parts. Only the narrow rows (doc_id, digest, part, mask) are
    shuffled.
    """
    permutations = list(itertools.permutations(range(len(FILTERS))))
    steps = len(FILTERS)
    orders = F.array(*[F.array(*[F.lit(1 << i) for i in p]) for p in permutations])
    names = F.array(*[F.lit("".join(FILTERS[i] for i in p)) for p in permutations])
    zero = F.array_repeat(F.struct(*[F.lit(0).cast("long").alias(m) for m in MEASURES]), len(permutations) * steps)
    add = lambda a, b: F.struct(*[(a[m] + b[m]).alias(m) for m in MEASURES])
    by_part = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))
    merged = F.aggregate("cells", zero, lambda acc, cell: F.zip_with(acc, folded(cell, orders), add))
    spread = by_part.select("part", merged.alias("m")).select("part", F.posexplode("m").alias("place", "s"))
    at = (F.col("place") / steps).cast("int")
    rows = spread.select("part", F.element_at(names, at + 1).alias("filter_order"), (F.col("place") % steps + 1).alias("step"), "s.*")
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))
