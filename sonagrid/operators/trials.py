"""Trial scoring and the metrics of scored trials."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import vectors
from ..shared import stored


#: Runs of ranks in which running maxima are taken first.
RUNS = 4096
#: Rows up to which a table of a few sums may be broadcast; with more, the same join shuffles.
BROADCAST_ROWS = 1_000_000


def score_trials(trials: DataFrame, enrol: DataFrame, test: DataFrame, *, strict: bool = True, carried: tuple[str, ...] = (), rows: int = 1 << 16, pairs: int = 1 << 22, least: int = 4) -> DataFrame:
    """``trials`` (enrol, test, ...) with the cosine score of their vectors; tables have utt_id and embedding.

    An id that a table lacks is an error, unless not ``strict``: then its trials are left out. Columns of the vectors
    named in ``carried`` come along as name_enrol and name_test. Trials and vectors are dealt to cells of a block of
    enrol ids and a block of test ids, each of about ``rows`` vectors at most, so a vector travels once for each block
    of the other side and not once for each trial. There are at least ``least`` blocks on a side, and enough for
    ``pairs`` trials a cell; a task holds two blocks and lets its trials pass. ``trials`` is read twice, with ``strict``
    four times.
    """
    if strict:
        for name, vecs in (("enrol", enrol), ("test", test)):
            lost = trials.join(vecs.select(F.col("utt_id").alias(name)), name, "left_anti").select(name).limit(1).collect()
            if lost:
                raise KeyError(f"no {name} vector for {lost[0][0]!r}")
    spread = math.isqrt(max(0, trials.count() - 1) // pairs) + 1
    n, m = (max(least, spread, -(-vecs.count() // rows)) for vecs in (enrol, test))
    block = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    own = lambda name, vecs: vecs.where(F.col("utt_id").isNotNull()).select(F.col("utt_id").cast(trials.schema[name].dataType).alias(name), F.struct("embedding", *carried).alias("_v"))
    lanes = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    parts = [
        own("enrol", enrol).withColumn("_k", lanes(m)).withColumns({"_cell": block("enrol", n) * m + F.col("_k"), "_side": F.lit(0)}).drop("_k"),
        own("test", test).withColumn("_k", lanes(n)).withColumns({"_cell": F.col("_k") * m + block("test", m), "_side": F.lit(1)}).drop("_k"),
        trials.where(F.col("enrol").isNotNull() & F.col("test").isNotNull()).withColumns({"_cell": block("enrol", n) * m + block("test", m), "_side": F.lit(2)}),
    ]
    dealt = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reversed(parts)).repartitionById(n * m, "_cell").sortWithinPartitions("_cell", "_side")
    # a batch's size is asked row by row, and Arrow then goes over all null lists since the last vector; an empty list ends that
    blank = F.struct(F.array().cast(dealt.schema["_v"].dataType["embedding"].dataType).alias("embedding"), *[F.lit(None).cast(dealt.schema["_v"].dataType[c].dataType).alias(c) for c in carried])
    dealt = dealt.withColumn("_v", F.coalesce("_v", blank))
    kinds = [enrol.schema[c] for c in carried], [test.schema[c] for c in carried]
    fields = [*trials.schema, *[StructField(f"{f.name}_{side}", f.dataType) for side, of in zip(("enrol", "test"), kinds, strict=True) for f in of], StructField("score", DoubleType())]
    names = trials.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, sides = None, ([], []), None
        for batch in batches:
            cell, side = (batch[c].to_numpy() for c in ("_cell", "_side"))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
                if lo == hi:
                    continue
                if cell[lo] != at:
                    at, held, sides = cell[lo], ([], []), None
                piece = batch.slice(lo, hi - lo)
                if side[lo] < 2:
                    held[side[lo]].append((piece[("enrol", "test")[side[lo]]], piece["_v"]))
                elif held[0] and held[1]:
                    sides = sides or [Side(of) for of in held]
                    row, left = sides[0].places(piece["enrol"])
                    more, right = sides[1].places(piece["test"].take(pa.array(row)))
                    row, left = row[more], left[more]
                    score = cosines(sides[0], left, sides[1], right)
                    along = [s.items[c].take(pa.array(i)) for s, i in zip(sides, (left, right), strict=True) for c in carried]
                    yield pa.RecordBatch.from_arrays([*[piece[c].take(pa.array(row)) for c in names], *along, score], names=[f.name for f in fields])

    return dealt.mapInArrow(run, StructType(fields))


class Side:
    """The vectors of a block: rows of a matrix in doubles, filled up with zeros, with their sizes and norms."""

    def __init__(self, pieces: list[tuple[pa.Array, pa.StructArray]]):
        self.ids = pd.Index(pa.concat_arrays([ids for ids, _ in pieces]).to_pandas())
        of = pa.concat_arrays([v for _, v in pieces])
        self.items = dict(zip(of.type.names, of.flatten(), strict=True))
        lists = self.items["embedding"]
        self.size = lists.value_lengths().fill_null(0).to_numpy()
        row, flat = np.repeat(np.arange(len(lists)), self.size), lists.flatten()
        x = np.zeros((len(lists), max(1, self.size.max(initial=0))))
        x[row, np.arange(len(row)) - np.repeat(np.cumsum(self.size) - self.size, self.size)] = flat.cast(pa.float64()).fill_null(0).to_numpy()
        self.null = lists.is_null().to_numpy(zero_copy_only=False)
        self.null[row[flat.is_null().to_numpy(zero_copy_only=False)]] = True
        self.x, self.norm = x, np.sqrt(in_order(x * x))

    def places(self, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(item of ``ids``, row of the matrix) of all matches."""
        ids = ids.to_pandas()
        if self.ids.is_unique:
            at = self.ids.get_indexer(ids)
            return np.flatnonzero(at >= 0), at[at >= 0]
        both = pd.DataFrame({"k": ids.to_numpy(), "i": np.arange(len(ids))}).merge(pd.DataFrame({"k": self.ids.to_numpy(), "j": np.arange(len(self.ids))}), on="k")
        return both["i"].to_numpy(), both["j"].to_numpy()


def in_order(x: np.ndarray) -> np.ndarray:
    """Sums of rows, item after item as ``vectors.total`` adds them."""
    out = np.zeros(len(x))
    for c in range(x.shape[1]):
        out += x[:, c]
    return out


def cosines(a: Side, i: np.ndarray, b: Side, j: np.ndarray) -> pa.Array:
    """Cosines of rows ``i`` of ``a`` and ``j`` of ``b``: 0 with a zero vector, null with a null or with unlike sizes."""
    d = min(a.x.shape[1], b.x.shape[1])
    size = a.norm[i] * b.norm[j]
    with np.errstate(all="ignore"):
        score = np.where(size == 0, 0.0, in_order(a.x[i, :d] * b.x[j, :d]) / size)
    return pa.array(score, pa.float64(), mask=a.null[i] | b.null[j] | ((size != 0) & (a.size[i] != b.size[j])))


def in_blocks(vecs: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, rows: int = 16384, least: int = 4) -> DataFrame:
    """What ``run`` gives for each block of ``vecs`` (utt_id, embedding, label) against each block: all against all.

    Blocks come from a hash of utt_id and have about ``rows`` rows, but there are at least ``least``; each row is sent
    once for each block, on either side. The work is the square of the rows, shared out by pairs of blocks.
    """
    n = max(least, -(-vecs.count() // rows))
    own = vecs.select("utt_id", "embedding", "label", F.pmod(F.xxhash64("utt_id"), F.lit(n)).cast("int").alias("_own"))
    each = F.sequence(F.lit(0), F.lit(n - 1))
    sides = F.concat(*[F.transform(each, lambda k: F.struct(c(k).alias("cell"), F.lit(i).alias("side"))) for i, c in enumerate((lambda k: F.col("_own") * n + k, lambda k: k * n + F.col("_own")))])  # noqa: B023
    dealt = own.withColumn("_s", F.explode(sides)).select("utt_id", "embedding", "label", F.col("_s.cell").alias("_cell"), F.col("_s.side").alias("_side"))
    return dealt.groupBy("_cell").applyInPandas(lambda g: run(g[g["_side"] == 0], g[g["_side"] == 1]), schema)


def slabs(a: pd.DataFrame, b: pd.DataFrame, rows: int = 512) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, their unit vectors, those of b, cosines) for some rows of ``a`` at a time; a zero vector stays zero."""
    if not len(a) or not len(b):
        return
    x, y = (np.stack(t["embedding"].to_numpy()).astype(np.float64) for t in (a, b))
    x, y = (m / np.where((s := np.sqrt((m * m).sum(1, keepdims=True))) > 0, s, 1) for m in (x, y))
    for k in range(0, len(x), rows):
        yield slice(k, k + rows), x[k : k + rows], y, x[k : k + rows] @ y.T


def nearest_apart(vecs: DataFrame) -> DataFrame:
    """(utt_id, apart): each row's distance to the nearest of all other rows, vectors taken at length 1; none if alone."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out, ids = [], b["utt_id"].to_numpy()
        for at, x, y, s in slabs(a, b):
            mine = a["utt_id"].to_numpy()[at]
            far = (y * y).sum(1) - 2 * s
            far[mine[:, None] == ids[None, :]] = np.inf
            best = far.argmin(1)
            apart = np.sqrt(((x - y[best]) ** 2).sum(1))
            some = np.isfinite(far[np.arange(len(best)), best])
            out.append(pd.DataFrame({"utt_id": mine[some], "apart": apart[some]}))
        return pd.concat(out) if out else pd.DataFrame({"utt_id": a["utt_id"].to_numpy()[:0], "apart": np.empty(0)})

    kind = vecs.schema["utt_id"].dataType.simpleString()
    return in_blocks(vecs, run, f"utt_id {kind}, apart double").groupBy("utt_id").agg(F.min("apart").alias("apart"))


def soft_labels(vecs: DataFrame, temperature: float = 0.1) -> DataFrame:
    """(utt_id, p): the share of the softmax over the cosines with all rows, its own too, that falls to the row's label."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out, theirs = [], b["label"].to_numpy()
        for at, _, _, s in slabs(a, b):
            e = np.exp((s - 1) / temperature)
            same = a["label"].to_numpy()[at][:, None] == theirs[None, :]
            out.append(pd.DataFrame({"utt_id": a["utt_id"].to_numpy()[at], "good": (e * same).sum(1), "all": e.sum(1)}))
        return pd.concat(out) if out else pd.DataFrame({"utt_id": a["utt_id"].to_numpy()[:0], "good": np.empty(0), "all": np.empty(0)})

    kind = vecs.schema["utt_id"].dataType.simpleString()
    sums = in_blocks(vecs, run, f"utt_id {kind}, good double, all double").groupBy("utt_id").agg(F.sum("good").alias("good"), F.sum("all").alias("all"))
    return sums.select("utt_id", (F.col("good") / F.col("all")).alias("p"))


def running(df: DataFrame, value: str, sums: dict[str, Column | str], *tie: str, ascending: bool = True, parts: int | None = None) -> DataFrame:
    """``df`` with running sums, in order of ``value`` then ``tie``, and ``rn``, the row's number, without one global sort.

    Rows are dealt by ranges of value and tie, which Spark samples, so crowded and equal values are spread as well, and
    stored, as their sums and the result must see the same ranges. Sums of whole ranges, a row for each, give each range
    its offset, and the rest is a window within the range. Rows in order: ROWS frames. A sum over a column of ``df`` is given
    by the column's name, so that it doesn't travel twice.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(value).asc() if ascending else F.col(value).desc(), *map(F.col, tie)]
    made = {f"_v_{k}": c for k, c in sums.items() if not isinstance(c, str)}
    of = {k: c if isinstance(c, str) else f"_v_{k}" for k, c in sums.items()}
    named = df.withColumns(made)
    rows = stored(named.repartitionByRange(n, *order).withColumn("_bin", F.spark_partition_id()), "ranges")
    totals = rows.groupBy("_bin").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in of.items()], F.count(F.lit(1)).alias("_t_rn"))
    ahead = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bin", *[F.coalesce(F.sum(f"_t_{k}").over(ahead), F.lit(0)).alias(f"_o_{k}") for k in [*sums, "rn"]])
    within = Window.partitionBy("_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(F.broadcast(offsets), "_bin")
    out = {k: F.col(f"_o_{k}") + F.sum(c).over(within) for k, c in of.items()} | {"rn": F.col("_o_rn") + F.row_number().over(within)}
    return rows.withColumns(out).drop("_bin", *made, *[f"_o_{k}" for k in [*sums, "rn"]])


def det_curve(df: DataFrame, score: str = "score", label: str = "label", *tie: str, weight: str | None = None) -> DataFrame:
    """(rn, score, fnr, fpr) by rising score; ``label`` is 1 for targets. Weighted with ``weight``."""
    w = F.col(weight) if weight else F.lit(1)
    rows = df.select(F.col(score).alias("score"), *tie, (w * (F.col(label) == 1).cast("int")).alias("_t"), (w * (F.col(label) != 1).cast("int")).alias("_i"))
    rows = running(rows, "score", {"ct": "_t", "ci": "_i"}, *tie)
    all_ = df.agg(F.sum(w * (F.col(label) == 1).cast("int")).alias("nt"), F.sum(w * (F.col(label) != 1).cast("int")).alias("ni"))
    rows = rows.crossJoin(F.broadcast(all_))
    return rows.select("rn", "score", *tie, (F.col("ct").cast("double") / F.nullif("nt", F.lit(0))).alias("fnr"), (1 - F.col("ci").cast("double") / F.nullif("ni", F.lit(0))).alias("fpr"))


def eer(curve: DataFrame) -> DataFrame:
    """(eer, threshold): where the curve's error rates cross, interpolated between the rows on either side.

    The upper one is the first with fnr >= fpr, the lower one the last with fnr < fpr; null where one class is empty.
    """
    gap = F.col("fnr") - F.col("fpr")
    p = curve.agg(
        F.min_by(F.struct("fnr", "fpr", "score"), F.when(gap >= 0, F.col("rn"))).alias("a"),
        F.max_by(F.struct("fnr", "fpr"), F.when(gap < 0, F.col("rn"))).alias("b"),
    )
    a_n, a_p, b_n, b_p = (F.col(c) for c in ("a.fnr", "a.fpr", "b.fnr", "b.fpr"))
    step = (a_n - a_p) / (b_p - a_p - (b_n - a_n))
    return p.select((a_n + step * (b_n - a_n)).alias("eer"), F.col("a.score").alias("threshold"))


def min_dcf(curve: DataFrame, p_target: float = 0.01, c_miss: float = 1.0, c_fa: float = 1.0, *, normalise: bool = True) -> DataFrame:
    """(p_target, min_dcf): the least detection cost along the curve, over that of the best blind decision."""
    cost = F.min(c_miss * F.col("fnr") * p_target + c_fa * F.col("fpr") * (1 - p_target))
    return curve.agg((cost / (min(c_miss * p_target, c_fa * (1 - p_target)) if normalise else 1.0)).alias("min_dcf")).select(F.lit(p_target).alias("p_target"), "min_dcf")


#: Coefficients of a rational approximation of the normal quantile (relative error below 1.2e-9), numerators
#: and denominators for the middle and the tails, highest power first, and where the tails begin.
MIDDLE = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239), (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
TAILS = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
TAIL = 0.02425


def polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda total, c: total * x + c, coefficients[1:], F.lit(coefficients[0]))


def probit(p: Column) -> Column:
    """The normal quantile of ``p``, by column functions."""
    q = p - 0.5
    middle = q * polynomial(MIDDLE[0], q * q) / polynomial(MIDDLE[1], q * q)
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = polynomial(TAILS[0], t) / polynomial(TAILS[1], t)
    return F.when(F.abs(q) <= 0.5 - TAIL, middle).when(q < 0, tail).otherwise(-tail)


def det_probit(curve: DataFrame) -> DataFrame:
    """The curve with both rates on normal-deviate axes; rates are held within (0, 1)."""
    held = lambda c: F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col(c)))
    return curve.withColumns({"fnr_probit": probit(held("fnr")), "fpr_probit": probit(held("fpr"))})


def norm_counts(df: DataFrame, score: str, lo: float, hi: float, n: int, *, weight: str | None = None) -> DataFrame:
    """(bin, share, cumulative) of scores in ``n`` equal bins of [lo, hi]; those outside count in the first and last."""
    at = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(score) - lo) / (hi - lo) * n))).cast("int")
    rows = df.groupBy(at.alias("bin")).agg(F.sum(F.col(weight) if weight else F.lit(1.0)).alias("w"))
    every = Window.partitionBy()
    return rows.select("bin", (F.col("w") / F.sum("w").over(every)).alias("share"), (F.sum("w").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(every)).alias("cumulative"))


def equalised_weights(df: DataFrame, label: str, parts: list[str], max_tar: float, max_imp: float) -> DataFrame:
    """``df`` with weights by which each part's targets add up to ``max_tar`` and its impostors to ``max_imp``.

    Counts are stored, and rows stay where they are as long as these are few enough to be broadcast.
    """
    n = stored(df.groupBy(*parts, label).agg(F.count(F.lit(1)).alias("_n")), "counts")
    n = F.broadcast(n) if n.count() <= BROADCAST_ROWS else n
    return df.join(n, [*parts, label]).withColumn("weight", F.when(F.col(label) == 1, max_tar).otherwise(max_imp) / F.col("_n")).drop("_n")


def balanced(df: DataFrame, sides: list[str], value: str) -> DataFrame:
    """``df`` with ``value`` divided by its sum over the rows of the same side, for one column of ``sides`` after another.

    Only sums travel: they are made from partial ones and stored, a row with all of its sums for each value of a side, and
    rows stay where they are as long as these tables are small enough to be broadcast. ``df`` is read once for each of
    ``sides`` and once for the result.
    """
    tables: dict[str, DataFrame] = {}

    def divided(n: int) -> DataFrame:
        out = df
        for side, sums in tables.items():
            out = out.join(sums, F.col(side).eqNullSafe(F.col(f"_of_{side}"))).drop(f"_of_{side}")
        return out.select(*[c for c in df.columns if c != value], reduce(lambda v, k: v / F.col(f"_s{k}"), range(n), F.col(value)).alias(value))

    for k, side in enumerate(sides):
        sums = divided(k).groupBy(F.col(side).alias(f"_of_{side}")).agg(F.sum(value).alias(f"_s{k}"))
        if side in tables:
            sums = sums.withColumnRenamed(f"_of_{side}", "_of").join(tables[side], F.col("_of").eqNullSafe(F.col(f"_of_{side}"))).drop("_of")
        sums = stored(sums, "sums")
        tables[side] = F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums
    return divided(len(sides))


def average_precision(df: DataFrame, score: str, label: str, *tie: str) -> DataFrame:
    """(ap): the area under the precision-recall curve whose precision never rises with recall."""
    rows = running(df.select(F.col(score).alias("score"), *tie, F.col(label).cast("long").alias("y")), "score", {"tp": "y"}, *tie, ascending=False)
    # precision at a hit is the largest from there on: the reverse running maximum is taken over hits, by runs of rn
    hits = rows.where("y = 1").select("rn", "tp", (F.col("tp") / F.col("rn")).alias("p"))
    n = df.agg(F.sum(F.col(label).cast("long")).alias("nt"), F.count(F.lit(1)).alias("rows"))
    hits = hits.crossJoin(F.broadcast(n)).withColumn("bin", F.floor((F.col("rn") - 1) * RUNS / F.col("rows")))
    tops = hits.groupBy("bin").agg(F.max("p").alias("top"))
    tops = tops.select("bin", F.max("top").over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    best = F.greatest(F.max("p").over(Window.partitionBy("bin").orderBy(F.desc("rn")).rowsBetween(Window.unboundedPreceding, 0)), F.col("later"))
    return hits.join(F.broadcast(tops), "bin").withColumn("best", best).agg((F.sum("best") / F.max("nt")).alias("ap"))


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(truth, pred, n), and the marginals with a null on the other side: one pass over grouping sets."""
    return df.cube(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def prf(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(class, support, recall, precision, f1) of each true class, with 1e-10 in every denominator."""
    sides = df.select(F.col(truth).alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(pred)).cast("int").alias("hit"))
    sides = sides.union(df.select(F.col(pred), F.lit(0), F.lit(1), F.lit(0)))
    c = sides.groupBy("class").agg(*[F.sum(x).alias(x) for x in ("t", "p", "hit")]).where("t > 0")
    r, q = F.col("hit") / (F.col("t") + 1e-10), F.col("hit") / (F.col("p") + 1e-10)
    return c.select("class", F.col("t").alias("support"), r.alias("recall"), q.alias("precision"), (2 * r * q / (r + q + 1e-10)).alias("f1"))


def binary_scores(df: DataFrame, truth: str, pred: str, *, swap: bool = False) -> DataFrame:
    """(accuracy, precision, recall, f1) of class 1; ``swap`` names precision and recall the other way round."""
    t, p = (F.col(truth) == 1), (F.col(pred) == 1)
    n = lambda c: F.sum(c.cast("long"))
    c = df.agg(n(t & p).alias("tp"), n(p).alias("pp"), n(t).alias("tt"), F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"))
    share = lambda x: F.coalesce(F.col("tp") / F.nullif(x, F.lit(0)), F.lit(0.0))
    precision, recall = share("pp"), share("tt")
    if swap:
        precision, recall = recall, precision
    return c.select("accuracy", precision.alias("precision"), recall.alias("recall"), F.coalesce(2 * F.col("tp") / F.nullif(F.col("pp") + F.col("tt"), F.lit(0)), F.lit(0.0)).alias("f1"))


def topk_accuracy(df: DataFrame, logits: str, target: str, ks: list[int]) -> DataFrame:
    """(k, accuracy): share of rows whose target's logit has fewer than k larger ones (earlier equal ones count)."""
    own = F.element_at(logits, F.col(target) + 1)
    at = F.size(F.filter(F.arrays_zip(F.col(logits).alias("v"), F.sequence(F.lit(0), F.size(logits) - 1).alias("i")), lambda z: (z["v"] > own) | ((z["v"] == own) & (z["i"] < F.col(target)))))
    rows = df.select(at.alias("at"))
    return rows.select("at", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).groupBy("k").agg(F.avg((F.col("at") < F.col("k")).cast("double")).alias("accuracy"))
