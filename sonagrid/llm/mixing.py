"""Mixing sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, numbered, pick, small, stored

#: Weights of the sources in order, repeating; the share of all words that the mix takes; the most copies of a document.
WEIGHTS, SHARE, COPIES = (3, 1, 2), 1.5, 2
SEED = "mix-1"
#: Hex digits of a document's place that make a bin.
BIN = 3


def quotas(sizes: list[int], weights: list[float], share: float = SHARE, most: int = COPIES) -> list[float]:
    """Targets by weight that add up to ``share`` of all sizes, none above ``most`` times its size.

    The excess of stopped targets goes to the others by weight until none is above: in the end each target is its
    weight times one level, or stopped; sources stop in the order of their cap over their weight.
    """
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    left, weight = share * sum(sizes), float(sum(weights))
    out = [0.0] * len(sizes)
    for k, i in enumerate(order):
        if left / weight <= most * sizes[i] / weights[i]:
            for j in order[k:]:
                out[j] = weights[j] * (left / weight)
            break
        out[i] = float(most * sizes[i])
        left -= out[i]
        weight -= weights[i]
    return out


class Flow:
    """Min-cost max-flow by shortest augmenting paths, for networks of patterns and sources."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [room, 0]
        self.cost += [cost, -cost]
        return len(self.to) - 2

    def run(self, s: int, t: int) -> None:
        while True:
            best: list[float] = [float("inf")] * len(self.out)
            via = [-1] * len(self.out)
            queued = [False] * len(self.out)
            best[s], queue = 0, deque([s])
            while queue:
                u = queue.popleft()
                queued[u] = False
                for e in self.out[u]:
                    v = self.to[e]
                    if self.room[e] and best[u] + self.cost[e] < best[v]:
                        best[v], via[v] = best[u] + self.cost[e], e
                        if not queued[v]:
                            queued[v] = True
                            queue.append(v)
            if via[t] < 0:
                return
            path, v = [], t
            while v != s:
                path.append(via[v])
                v = self.to[via[v] ^ 1]
            moved = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= moved
                self.room[e ^ 1] += moved


def route(patterns: list[tuple[tuple[int, ...], int]], targets: list[float], most: int = COPIES) -> list[list[int]]:
    """Words that each pattern gives to each of its sources.

    ``patterns``: the sources of a kind of document and its words. The first pass over a pattern's words costs nothing,
    each further one costs one more a word, so repetition is spread and used last; targets are met as far as words go.
    """
    n, m = len(patterns), len(targets)
    net = Flow(n + m + 2)
    s, t = n + m, n + m + 1
    arcs: list[list[int]] = []
    for p, (members, words) in enumerate(patterns):
        for k in range(most):
            net.arc(s, p, words, k)
        arcs.append([net.arc(p, n + i, most * words, 0) for i in members])
    for i, x in enumerate(targets):
        net.arc(n + i, t, round(x), 0)
    net.run(s, t)
    return [[net.room[e ^ 1] for e in row] for row in arcs]


def place(doc_id: Column, seed: str) -> Column:
    """Where a document stands in the seeded order: hex digits, the same on every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def pattern(rows: DataFrame, source: str) -> Column:
    """The sorted sources of a row, without repeats; a column that is no array is one source, which may be null."""
    if rows.schema[source].dataType.typeName() == "array":
        own = F.coalesce(F.col(source).cast("array<string>"), F.array().cast("array<string>"))
        return F.sort_array(F.array_distinct(own), asc=True)
    return F.array(F.col(source).cast("string"))


def sized(docs: DataFrame, seed: str, source: str = "source") -> DataFrame:
    """doc_id, sources (sorted array; of one, which may be null, if the column is no array), size and place."""
    rows = pick(docs, "doc_id", source, "text")
    sources = pattern(rows, source)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return rows.select(F.col("doc_id").cast("long"), sources.alias("sources"), size.alias("size"), place(F.col("doc_id").cast("long"), seed).alias("place"))


def plan(rows: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = COPIES) -> tuple[DataFrame, DataFrame]:
    """What to take from documents that ``sized`` has measured: (plan by pattern, table of sources).

    The plan has, for each pattern (sources), how many whole passes it gives (passes), the last place in seeded order
    that is taken once more (upto) and one further place (extra) that brings the words nearest to the flow's. The
    driver sees sums by pattern and by source and nothing else; places are found from sums over bins of the order, then
    within the one bin that the limit falls in.
    """
    spark = rows.sparkSession
    patterns = [(list(r["sources"]), r["words"]) for r in rows.groupBy("sources").agg(F.sum("size").alias("words")).collect()]
    names = sorted({x for p, _ in patterns for x in p}, key=lambda x: (x is None, (x or "").encode()))
    number = {x: i for i, x in enumerate(names)}
    patterns.sort(key=lambda p: [number[x] for x in p[0]])
    held = [0] * len(names)
    for p, words in patterns:
        for x in p:
            held[number[x]] += words
    by_weight = [float(weights[i % len(weights)]) for i in range(len(names))]
    targets = quotas(held, by_weight, share, most)
    given = [sum(x) for x in route([(tuple(number[x] for x in p), w) for p, w in patterns], targets, most)]
    sources = spark.createDataFrame(list(zip(names, held, targets, strict=True)), "source string, source_size long, target double")
    quota = spark.createDataFrame([(p, g // w if w else 0, g % w if w else 0) for (p, w), g in zip(patterns, given, strict=True)], "sources array<string>, passes long, rest long")
    quota = small(quota, len(patterns))
    same = lambda a, b: F.col(f"{a}.sources").eqNullSafe(F.col(f"{b}.sources"))
    bins = rows.groupBy("sources", F.substring("place", 1, BIN).alias("bin")).agg(F.sum("size").alias("words"))
    through = Window.partitionBy("sources").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("through", F.sum("words").over(through))
    at = bins.alias("b").join(quota.alias("q"), same("b", "q")).where("through > rest")
    at = at.groupBy("b.sources", "rest").agg(F.min(F.struct("bin", (F.col("through") - F.col("words")).alias("before"))).alias("at"))
    at = at.select("sources", "rest", F.col("at.bin").alias("bin"), F.col("at.before").alias("before"))
    at = small(stored(at, "bins"), len(patterns))
    inside = rows.alias("r").join(at.alias("a"), same("r", "a") & (F.substring("place", 1, BIN) == F.col("bin")))
    upwards = Window.partitionBy("r.sources").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.select(F.col("r.sources"), "size", "place", "bin", "before", "rest").alias("r").withColumn("sum", F.col("before") + F.sum("size").over(upwards))
    taken = inside.where("sum <= rest").groupBy("sources").agg(F.max("place").alias("upto"), F.max("sum").alias("sum"))
    limit = at.alias("a").join(taken.alias("t"), same("a", "t"), "left")
    limit = limit.select("a.sources", F.coalesce("upto", "bin").alias("upto"), (F.col("rest") - F.coalesce("sum", "before")).alias("missing"))
    limit = small(stored(limit, "limits"), len(patterns))
    rest = rows.alias("r").join(limit.alias("l"), same("r", "l")).where("place > upto and size > 0 and size < 2 * missing")
    extra = rest.groupBy("r.sources").agg(F.min(F.struct(F.abs(F.col("missing") - F.col("size")), F.col("place"))).alias("x")).select("sources", F.col("x.place").alias("extra"))
    out = quota.alias("q").join(limit.alias("l"), same("q", "l"), "left").join(extra.alias("e"), same("q", "e"), "left")
    out = stored(out.select("q.sources", "passes", "upto", "extra"), "plan")
    return small(out, len(patterns)), sources


def copies(rows: DataFrame, take: DataFrame) -> DataFrame:
    """``rows`` (with sources and place) and how often the plan takes each."""
    joined = rows.join(take.withColumnRenamed("sources", "_of"), F.col("sources").eqNullSafe(F.col("_of")), "left").drop("_of")
    once = F.coalesce(F.col("place") <= F.col("upto"), F.lit(False)) | F.coalesce(F.col("place") == F.col("extra"), F.lit(False))
    return joined.withColumn("copies", F.coalesce("passes", F.lit(0)) + once.cast("long")).drop("passes", "upto", "extra")


def mix(docs: DataFrame, *, seed: str = SEED, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = COPIES) -> DataFrame:
    """Words that the mix takes of each document, one row for each row of ``docs``.

    Needs doc_id, text and source. Returns doc_id, size (words; null text: 0), source_size, target (its source's) and
    taken (words, repeats counted). Sources stand by code point, null last, and weigh ``weights`` in turn. Within a
    source each document is taken as many whole times as fit the target, and once more in a seeded order up to the
    target; one further document is taken if that comes nearer. Documents of one doc_id stand and fall together. Sources
    without words take nothing; an empty table gives no rows; other columns are ignored. Reruns agree.
    """
    rows = stored(sized(docs, seed), "sizes")
    take, sources = plan(rows, weights=weights, share=share, most=most)
    out = copies(rows, take).withColumn("_s", F.get("sources", F.lit(0)))
    out = out.join(small(sources, take.count()), F.col("_s").eqNullSafe(F.col("source")), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, *, seed: str = SEED, **how: object) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; all columns are kept, texts are not shuffled.

    source may be an array of overlapping sources, as in ``plan``; an empty or null array belongs to none and isn't taken.
    """
    rows = stored(sized(docs, seed), "sizes")
    take, _ = plan(rows, **how)
    flat, names = numbered(docs)
    source, doc_id = (f"c{names.index(n)}" for n in ("source", "doc_id"))
    flat = flat.withColumn("sources", pattern(flat, source)).withColumn("place", place(F.col(doc_id).cast("long"), seed))
    dealt = copies(flat, take).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return dealt.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
