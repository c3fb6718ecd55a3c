"""Label post-processing and clustering of vectors by recording."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from . import density, intervals

#: Centroids of one broadcast array, and how many arrays a row may meet.
CENTROIDS, CENTROID_ARRAYS = 8192, 64
#: Vectors of a recording whose similarities are held as a matrix by spectral clustering.
DENSE = 1024
#: Vectors whose similarities average linkage holds as a matrix, and near clusters that it notes of each row beyond.
MATRIX, NEAR = 4096, 64
#: Similarities, or items of vectors, that are held at a time beyond that: 32 MB.
HELD = 1 << 22


def first_seen(df: DataFrame, key: list[str], order: str, label: str, start: int = 0) -> DataFrame:
    """(key..., label, code): dense numbers of labels in the order in which they appear.

    Labels are few; ranks are taken over one row for each label.
    """
    seen = df.groupBy(*key, label).agg(F.min(order).alias("_at"))
    return seen.withColumn("code", F.row_number().over(Window.partitionBy(*key).orderBy("_at")) - 1 + start).drop("_at")


def arrange_labels(df: DataFrame, key: list[str], seq: str, label: str, start: int = 0) -> DataFrame:
    """``df`` with ``label`` renumbered in first-seen order."""
    codes = first_seen(df, key, seq, label, start)
    return df.join(codes, [*key, label]).drop(label).withColumnRenamed("code", label)


def sorted_labels(df: DataFrame, key: list[str], label: str) -> DataFrame:
    """``df`` with ``label`` renumbered in sorted order."""
    codes = df.select(*key, label).distinct().withColumn("code", F.row_number().over(Window.partitionBy(*key).orderBy(label)) - 1)
    return df.join(codes, [*key, label]).drop(label).withColumnRenamed("code", label)


def encode_labels(df: DataFrame, label: str, order: str, *, speed: str | None = None) -> DataFrame:
    """``df`` with ``code``; with ``speed``, an index, each speed gets its own range of codes."""
    out = df.join(first_seen(df, [], order, label), label)  # small label tables are broadcast by their size
    if speed is None:
        return out
    n = df.select(label).distinct().agg(F.count(F.lit(1)).alias("_n"))
    return out.crossJoin(F.broadcast(n)).withColumn("code", F.col("code") + F.col("_n") * F.col(speed)).drop("_n")


def nearest_centroid(df: DataFrame, centroids: DataFrame, key: list[str], emb: str = "embedding") -> DataFrame:
    """``df`` with the label of the centroid of its key with the largest cosine (ties: smaller label), and that cosine.

    A key's centroids travel as one array, so each row meets them without multiplying. Without a key all centroids are
    counted and broadcast in arrays of at most ``CENTROIDS``, which a row meets one after another; more than
    ``CENTROID_ARRAYS`` of them are an error.
    """
    item = F.struct("label", vectors.l2_normalised(F.col("centroid")).alias("c"))
    collected = lambda df: df.agg(F.array_sort(F.collect_list(item)).alias("_cs"))
    if key:
        joined = [df.join(collected(centroids.groupBy(*key)), key)]
    else:
        count = centroids.count()
        arrays = max(1, -(-count // CENTROIDS))
        if arrays > CENTROID_ARRAYS:
            raise ValueError(f"{count} centroids are too many to meet every row: give a key")
        part = lambda k: centroids.where(F.pmod(F.xxhash64("label"), F.lit(arrays)) == k) if arrays > 1 else centroids
        joined = [collected(part(k)) for k in range(arrays)]
    own = vectors.l2_normalised(F.col(emb))
    scores = vectors.let(own, lambda x: F.transform("_cs", lambda c: F.struct(vectors.dot(x, c["c"]).alias("s"), c["label"].alias("label"))))
    larger = lambda a, b: F.when(a.isNull() | (b["s"] > a["s"]) | ((b["s"] == a["s"]) & (b["label"] < a["label"])), b).otherwise(a)
    best = vectors.let(scores, lambda s: F.aggregate(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), F.get(s, F.lit(0)), larger))
    if key:
        out = joined[0].withColumn("_b", best).drop("_cs")
    else:
        out = df
        for k, unit in enumerate(joined):
            met = out.crossJoin(F.broadcast(unit)).withColumn("_n", best).drop("_cs")
            won = F.col("_n") if not k else F.when(F.col("_n").isNull(), F.col("_b")).otherwise(larger(F.col("_b"), F.col("_n")))
            out = met.withColumn("_b", won).drop("_n")
    return out.withColumns({"nearest": F.col("_b.label"), "cosine": F.col("_b.s")}).drop("_b")


def absorb_minor(df: DataFrame, key: list[str], label: str = "label", emb: str = "embedding", min_size: int = 4) -> DataFrame:
    """``df`` with members of labels of at most ``min_size`` rows moved to the nearest larger one's label.

    Centroids are those before any move; a key without larger labels gets label 0 throughout.
    """
    sizes = df.groupBy(*key, label).agg(F.count(F.lit(1)).alias("_n"))
    rows = df.join(sizes, [*key, label])
    major = rows.where(F.col("_n") > min_size)
    centroids = vectors.mean_vectors(major.withColumnRenamed(label, "_l"), [*key, "_l"], emb).withColumnRenamed("_l", "label")
    minor = rows.where(F.col("_n") <= min_size)
    none = minor.join(centroids.select(*key).distinct(), key, "left_anti").withColumn(label, F.lit(0).cast(df.schema[label].dataType)) if key else None
    moved = nearest_centroid(minor.drop(label), centroids, key, emb).withColumnRenamed("nearest", label).drop("cosine")
    out = major.select(*df.columns).union(moved.select(*df.columns))
    return out.union(none.select(*df.columns)) if none is not None else out


def p_prune(sims: DataFrame, key: list[str], pval: float = 0.02, least: int = 6) -> DataFrame:
    """(key..., i, j, sim) with each row's smallest ``min(int((1 - pval) n), n - least)`` similarities set to 0."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key, "i"))
    drop = F.least(F.floor((1 - pval) * n), n - least)
    rank = F.row_number().over(Window.partitionBy(*key, "i").orderBy("sim", "j"))
    return sims.withColumn("sim", F.when(rank <= drop, 0.0).otherwise(F.col("sim")))


def top_active(df: DataFrame, key: list[str], activity: str, speaker: str, count: str) -> DataFrame:
    """Rows of the ``count`` most active speakers of each key that are active at all (ties: smaller speaker)."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(activity).desc(), speaker))
    return df.withColumn("_r", rank).where((F.col("_r") <= F.col(count)) & (F.col(activity) > 0)).drop("_r")


def cosine_matrix(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n == 0, 1, n)
    return u @ u.T


def ahc(x: np.ndarray, threshold: float = 0.4) -> np.ndarray:
    """Average linkage on cosine; clusters merge while their mean similarity is at least ``threshold``.

    Each row keeps its largest similarity and the first place that has it; a merge looks again only at rows whose
    largest one it took away, so the work is about the square of the vectors. More than ``MATRIX`` vectors don't get a
    matrix.
    """
    n = len(x)
    if n > MATRIX:
        return ahc_means(x, threshold)
    sim = cosine_matrix(x)
    np.fill_diagonal(sim, -np.inf)
    size, label = np.ones(n), np.arange(n)
    at = sim.argmax(axis=1)
    top = sim[np.arange(n), at]
    while n > 1:
        i = int(top.argmax())
        j = int(at[i])
        if i == j or top[i] < threshold:
            break
        i, j = min(i, j), max(i, j)
        row = (sim[i] * size[i] + sim[j] * size[j]) / (size[i] + size[j])
        row[[i, j]] = -np.inf
        sim[i], sim[:, i] = row, row
        sim[j], sim[:, j] = -np.inf, -np.inf
        top[j], at[j] = -np.inf, j
        again = np.flatnonzero((at == i) | (at == j))
        again = np.append(again[(again != i) & (again != j)], i)
        better = (row > top) | ((row == top) & (i < at) & (row > -np.inf))
        better[again] = False
        top[better], at[better] = row[better], i
        at[again] = sim[again].argmax(axis=1)
        top[again] = sim[again, at[again]]
        size[i] += size[j]
        label[label == j] = i
        n -= 1
    return np.unique(label, return_inverse=True)[1]


def row_dots(a: np.ndarray, b: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each row of ``a`` its products with the rows of ``b`` that its row of ``of`` names."""
    step = max(1, HELD // max(1, of.shape[1] * a.shape[1]))
    return np.concatenate([np.einsum("kd,ktd->kt", a[k : k + step], b[of[k : k + step]]) for k in range(0, len(a), step)] or [np.zeros(of.shape)])


def ahc_means(x: np.ndarray, threshold: float = 0.4, near: int = NEAR) -> np.ndarray:
    """``ahc`` in memory that grows with the vectors, not with their square.

    The mean cosine of two clusters is the product of their mean unit vectors. It never rises above the larger of both
    by a merge, so all pairs that are nearest to each other merge at once as they would one after another; a row notes
    its ``near`` nearest clusters and a bound for all others, and meets all again only where that bound may be above.
    Rows without a cluster at ``threshold`` or above are done. Only ties may fall otherwise than by the matrix.
    """
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(norm == 0, 1, norm)
    # equal vectors merge before all others, but for those without direction
    equal, seen = threshold < 1 - 1e-9, {}
    of = np.array([seen.setdefault(v.tobytes() if equal and v.any() else k, len(seen)) for k, v in enumerate(u + 0.0)])
    first = np.unique(of, return_index=True)[1]
    n = len(first)
    size = np.bincount(of, minlength=n).astype(float)
    mean = np.ascontiguousarray(u[first])
    into, live = np.arange(n), np.ones(n, bool)
    below = np.nextafter(threshold, -np.inf)
    cand, rest = np.full((n, near), -1, np.int32), np.full(n, below)
    at, top, second = np.zeros(n, int), np.full(n, -np.inf), np.full(n, -np.inf)

    def now(ids: np.ndarray) -> np.ndarray:
        while ((up := into[ids]) != ids).any():
            ids = up
        return ids

    def noted(rows: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Best and second best of the clusters ``ids`` for ``rows``; gives the rows of which others may be nearer."""
        top[rows] = sims.max(axis=1, initial=-np.inf)
        at[rows] = np.where(sims == top[rows][:, None], ids, n).min(axis=1, initial=n)
        second[rows] = np.maximum(np.where(ids == at[rows][:, None], -np.inf, sims).max(axis=1, initial=-np.inf), rest[rows])
        return rows[(top[rows] < rest[rows]) & (rest[rows] >= threshold)]

    def among(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = np.where(ids >= 0, now(np.maximum(ids, 0)), -1)
        sims = row_dots(mean[rows], mean, ids)
        sims[(ids < 0) | ~live[ids] | (ids == rows[:, None])] = -np.inf
        return ids, sims

    def scan(rows: np.ndarray) -> None:
        """``rows`` meet all clusters that are left."""
        ids = np.flatnonzero(live)
        others, step = mean[ids].T, max(1, HELD // max(1, len(ids)))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            sims = mean[part] @ others
            sims[np.arange(len(part)), np.searchsorted(ids, part)] = -np.inf
            r, c = np.nonzero(sims >= threshold)
            ends = np.searchsorted(r, np.arange(len(part) + 1))
            cand[part], rest[part] = -1, below
            best = np.full((len(part), near), -np.inf)
            for row in np.flatnonzero(np.diff(ends)):
                to = c[ends[row] : ends[row + 1]]
                if len(to) > near:
                    order = np.argpartition(sims[row, to], len(to) - near - 1)
                    rest[part[row]] = sims[row, to[order[len(to) - near - 1]]]
                    to = to[order[len(to) - near :]]
                cand[part[row], : len(to)], best[row, : len(to)] = ids[to], sims[row, to]
            noted(part, cand[part], best)

    scan(np.arange(n))
    while True:
        live &= top >= threshold
        left = np.flatnonzero(live)
        if not len(left):
            break
        gone = left[~live[at[left]]]  # rounding: nearer from here than from there
        if len(gone):
            scan(gone)
            continue
        i = left[(at[at[left]] == left) & (left < at[left])]
        if not len(i):  # ties only
            i = left[[top[left].argmax()]]
        i, j = np.minimum(i, at[i]), np.maximum(i, at[i])
        a, b = size[i] / (size[i] + size[j]), size[j] / (size[i] + size[j])
        mean[i] = a[:, None] * mean[i] + b[:, None] * mean[j]
        size[i] += size[j]
        into[j], live[j] = i, False
        rest[i] = a * rest[i] + b * rest[j]
        touched = np.zeros(n, bool)
        touched[i], touched[j] = True, True
        stale = left[touched[at[left]] & ~touched[left]]
        # a merged row's near clusters are those of both; what is no longer noted bounds the rest
        ids, sims = among(i, np.concatenate([cand[i], cand[j]], axis=1))
        order = np.argsort(ids, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        cand[i] = np.where(sims[:, :near] > -np.inf, ids[:, :near], -1)
        rest[i] = np.maximum(rest[i], sims[:, near])
        again = [noted(i, ids[:, :near], sims[:, :near])]
        # what was nearest to others has moved; it stays nearest while no other can be nearer
        at[stale] = now(at[stale])
        top[stale] = np.einsum("kd,kd->k", mean[stale], mean[at[stale]])
        stale = stale[top[stale] < second[stale]]
        again.append(noted(stale, *among(stale, cand[stale])))
        again = np.concatenate(again)
        if len(again):
            scan(again)
    return np.unique(now(np.arange(n))[of], return_inverse=True)[1]


def k_means(x: np.ndarray, k: int, seed: int = 0, rounds: int = 100) -> np.ndarray:
    """Seeded k-means with spread starts: each next centre is the point farthest from those chosen."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        centres.append(x[np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0).argmax()])
    c = np.array(centres)
    label = np.zeros(len(x), int)
    for _ in range(rounds):
        new = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        if (new == label).all() and _:
            break
        label = new
        c = np.array([x[label == i].mean(axis=0) if (label == i).any() else c[i] for i in range(k)])
    return label


def spectral(x: np.ndarray, *, low: int = 1, high: int = 10, pval: float = 0.02, least: int = 6, oracle: int | None = None) -> np.ndarray:
    """Pruned, symmetric cosine graph; its Laplacian's eigengap gives the number of clusters, k-means the labels.

    More than ``DENSE`` vectors don't get a matrix: their kept similarities are taken by slabs of rows, and the lowest
    eigenvectors by iteration.
    """
    n = len(x)
    if n > DENSE:
        from . import graphs

        return graphs.spectral_labels(*graphs.near_laplacian(*graphs.kept_places(x, pval, least)), n, low=low, high=high, oracle=oracle)
    a = cosine_matrix(x)
    drop = min(int((1 - pval) * n), n - least)
    if drop > 0:
        np.put_along_axis(a, np.argsort(a, axis=1, kind="stable")[:, :drop], 0.0, axis=1)
    a = (a + a.T) / 2
    np.fill_diagonal(a, 0)
    values, vecs = np.linalg.eigh(np.diag(np.abs(a).sum(axis=1)) - a)
    k = oracle or low + int(np.argmax(np.diff(values[: min(high + 1, n)][low - 1 :])))
    return k_means(vecs[:, :k], k)


METHODS: dict[str, Callable[..., np.ndarray]] = {"ahc": ahc, "spectral": spectral, "density": density.density}


def minor_absorbed(label: np.ndarray, x: np.ndarray, least: int) -> np.ndarray:
    ids, size = np.unique(label, return_counts=True)
    big = ids[size > least]
    if not len(big):
        return np.zeros(len(x), int)
    order, ends = np.argsort(label, kind="stable"), np.cumsum(size)
    c = np.stack([x[order[e - s : e]].mean(axis=0) for s, e in zip(size, ends, strict=True) if s > least])
    norm = np.maximum(np.linalg.norm(c, axis=1), 1e-12)
    out, minor = label.copy(), np.flatnonzero(~np.isin(label, big))
    for k in range(0, len(minor), step := max(1, HELD // len(big))):
        part = minor[k : k + step]
        out[part] = big[(x[part] @ c.T / norm).argmax(axis=1)]
    return out


def merged_rows(sums: np.ndarray, threshold: float) -> np.ndarray:
    """For each row of ``sums`` the first row it ends up with: the closest two are added up until none reaches ``threshold``."""
    into, total, left = np.arange(len(sums)), sums.astype(float), list(range(len(sums)))
    while len(left) > 1:
        sim = cosine_matrix(total[left])
        sim[np.tril_indices(len(left))] = -np.inf
        i, j = np.unravel_index(sim.argmax(), sim.shape)
        if sim[i, j] < threshold:
            break
        total[left[i]] += total[left[j]]
        into[into == left[j]] = left[i]
        left.pop(j)
    return into


def cosine_merged(label: np.ndarray, x: np.ndarray, threshold: float) -> np.ndarray:
    """The closest pair of centroids is merged, the smaller label kept, until none reaches ``threshold``."""
    ids, of = np.unique(label, return_inverse=True)
    sums = np.zeros((len(ids), x.shape[1]))
    np.add.at(sums, of, x)
    return ids[merged_rows(sums, threshold)][of]


def cluster_embeddings(df: DataFrame, key: list[str], seq: str, emb: str, method: str = "spectral", *, cluster_line: int = 40, mer_cos: float | None = None, min_cluster_size: int = 4, **how: object) -> DataFrame:
    """(key..., seq, label): clusters of each key's vectors.

    One vector gets 0; fewer than ``cluster_line`` are clustered by average linkage, others by ``method``; small
    clusters are absorbed, and with ``mer_cos`` close ones merged. A recording's vectors fit a task.
    """
    if method not in METHODS:
        raise ValueError(f"unsupported method {method!r}: one of {sorted(METHODS)}")
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in [*key, seq])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(seq, ignore_index=True)
        x = np.stack([np.asarray(v, float) for v in group[emb]])
        if len(x) <= 1:
            label = np.zeros(len(x), int)
        else:
            label = ahc(x) if len(x) < cluster_line else METHODS[method](x, **how)
            label = minor_absorbed(label, x, min_cluster_size)
            if mer_cos is not None:
                label = cosine_merged(label, x, mer_cos)
        return group[[*key, seq]].assign(label=label.astype("int32"))

    return df.select(*key, seq, emb).groupBy(*key).applyInPandas(run, f"{kinds}, label int")


def merge_by_cosine(df: DataFrame, key: list[str], label: str, emb: str, threshold: float) -> DataFrame:
    """``df`` with labels whose centroids are close merged, the smaller kept.

    Only a key's sums, one vector for each label, meet in a task; rows get their new label by a join. Rows with a null
    key or label keep it.
    """
    by = [*key, label]
    n = df.groupBy(*by).agg(F.count(emb).alias("_n"))
    sums = vectors.mean_vectors(df, by, emb).join(n, by).select(*by, F.transform("centroid", lambda v: v * F.col("_n")).alias("_s"))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(label, ignore_index=True)
        into = merged_rows(np.stack([np.asarray(v, float) for v in group["_s"]]), threshold)
        return group[by].assign(_to=group[label].to_numpy()[into])

    to = sums.groupBy(*key).applyInPandas(run, f"{kinds}, `_to` {df.schema[label].dataType.simpleString()}")
    return df.join(to, by, "left").withColumn(label, F.coalesce("_to", label)).select(*df.columns)


def refine_overlap(segments: DataFrame, local: DataFrame, counts: DataFrame, key: list[str]) -> DataFrame:
    """(key..., frame, speaker): the speakers of each frame once overlap is known.

    ``segments``: key..., st, ed, speaker (in frames); ``local``: key..., chunk, frame, class, active; ``counts``:
    key..., frame, n. In each chunk classes are matched with speakers by the frames they share; activity is summed by
    speaker, the n most active of a frame are kept, and a frame left without any keeps its segments' speakers.
    """
    from .der import best_mapping

    frames = segments.withColumn("frame", F.explode(F.sequence(F.col("st"), F.col("ed") - 1))).select(*key, "frame", "speaker")
    shared = local.where("active > 0").join(frames, [*key, "frame"]).groupBy(*key, "chunk", F.col("speaker").alias("ref"), F.col("class").cast("string").alias("sys")).agg(F.sum("active").alias("ov"))
    mapping = best_mapping(shared, [*key, "chunk"]).select(*key, "chunk", F.col("ref").alias("speaker"), F.col("sys").cast("int").alias("class"))
    summed = local.join(mapping, [*key, "chunk", "class"]).groupBy(*key, "frame", "speaker").agg(F.sum("active").alias("active"))
    kept = top_active(summed.join(counts, [*key, "frame"]), [*key, "frame"], "active", "speaker", "n").select(*key, "frame", "speaker")
    return kept.union(frames.join(kept.select(*key, "frame").distinct(), [*key, "frame"], "left_anti").select(*key, "frame", "speaker"))


def joint_labels(audio: DataFrame, vision: DataFrame, key: list[str]) -> DataFrame:
    """``audio`` (key..., seq, st, ed, label, embedding) relabelled with the speakers that ``vision`` shows meanwhile.

    ``vision``: key..., st, ed, label, embedding. An audio label that overlaps one visual label for long takes it
    over; one that overlaps several has its rows dealt to the visual label whose mean audio vector, over rows that
    overlap it by more than a second, is nearest; others stay, prefixed to be told from visual ones.
    """
    hits = intervals.overlap_speakers(audio, vision, key)
    n = hits.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("n"), F.min("vlabel").alias("only"))
    rows = audio.join(n, [*key, "label"], "left")
    seen = intervals.overlap_join(audio, vision, key).where("ov > 1")
    seen = seen.select(*[F.col(f"a.{k}").alias(k) for k in key], F.col("b.label").alias("label"), F.col("a.embedding").alias("embedding"))
    centres = vectors.mean_vectors(seen, [*key, "label"], "embedding")
    several = nearest_centroid(rows.where("n > 1"), centres, key).withColumn("joint", F.concat(F.lit("v"), F.col("nearest").cast("string"))).drop("nearest", "cosine")
    rest = rows.where("n is null or n = 1").withColumn("joint", F.when(F.col("n") == 1, F.concat(F.lit("v"), F.col("only").cast("string"))).otherwise(F.concat(F.lit("a"), F.col("label").cast("string"))))
    return rest.unionByName(several).drop("n", "only")
