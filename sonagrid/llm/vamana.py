"""Approximate nearest neighbours: robust-pruned directed graphs over shards, searched with beams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, prepare, stored

#: Vectors of a shard at the mean, edges of a node, beam widths of building and search, and relaxations of the passes.
SHARD, DEGREE, BUILD_BEAM, BEAM, PASSES = 4096, 32, 64, 96, (1.0, 1.2)
#: Points that are inserted at once, and queries of one search task.
BATCH, QUERIES = 256, 4096
INDEX = "dim int, shard int, node int, ids array<long>, vector {}, edges array<int>, entry boolean"


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Greedy search of all ``queries`` at once: (nodes, distances) of each beam, nearest first, and the nodes expanded.

    ``x``: unit vectors; distance: 1 - cosine. In each step every query expands the nearest node of its beam that it
    has not expanded yet, until there is none. Missing places hold -1 and infinity.
    """
    n, q = len(x), len(queries)
    rows = np.arange(q)
    seen = np.zeros((q, n), bool)
    seen[:, entry] = True
    nodes = np.full((q, width), -1, np.int32)
    dist = np.full((q, width), np.inf, np.float32)
    done = np.zeros((q, width), bool)
    nodes[:, 0] = entry
    dist[:, 0] = 1 - queries @ x[entry]
    trail: list[np.ndarray] = []
    while True:
        open_ = np.where(done | (nodes < 0), np.inf, dist)
        at = open_.argmin(axis=1)
        alive = np.isfinite(open_[rows, at])
        if not alive.any():
            return nodes, dist, trail
        who = rows[alive]
        at = at[alive]
        current = nodes[who, at]
        done[who, at] = True
        step = np.full(q, -1, np.int32)
        step[who] = current
        trail.append(step)
        near = edges[current]
        new = (near >= 0) & ~seen[who[:, None], near]
        seen[np.broadcast_to(who[:, None], near.shape)[new], near[new]] = True
        d = np.where(new, 1 - np.einsum("qd,qkd->qk", queries[who], x[near]), np.inf).astype(np.float32)
        all_nodes = np.concatenate([nodes[who], np.where(new, near, -1)], axis=1)
        all_dist = np.concatenate([dist[who], d], axis=1)
        all_done = np.concatenate([done[who], np.zeros(near.shape, bool)], axis=1)
        keep = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
        nodes[who] = np.take_along_axis(all_nodes, keep, 1)
        dist[who] = np.take_along_axis(all_dist, keep, 1)
        done[who] = np.take_along_axis(all_done, keep, 1)


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse edges of each of ``points`` from its row of ``candidates`` (-1: none).

    The nearest candidate becomes an edge and removes every candidate that is ``alpha`` times nearer to it than to the
    point; and so on, up to ``degree`` edges.
    """
    candidates = np.where(candidates == points[:, None], -1, candidates)
    order = np.sort(candidates, axis=1)
    twice = np.zeros_like(order, bool)
    twice[:, 1:] = order[:, 1:] == order[:, :-1]
    cand = np.where(twice, -1, order)
    v = x[cand]
    d = np.where(cand < 0, np.inf, 1 - np.einsum("pd,pkd->pk", x[points], v))
    width = min(cand.shape[1], 3 * degree)
    keep = np.argsort(d, axis=1, kind="stable")[:, :width]
    cand, d = np.take_along_axis(cand, keep, 1), np.take_along_axis(d, keep, 1)
    v = x[cand]
    between = 1 - v @ v.transpose(0, 2, 1)
    rows = np.arange(len(points))
    out = np.full((len(points), degree), -1, np.int32)
    live = np.where(np.isfinite(d), d, np.inf)
    for k in range(degree):
        best = live.argmin(axis=1)
        good = np.isfinite(live[rows, best])
        if not good.any():
            break
        out[good, k] = cand[rows, best][good]
        gone = alpha * between[rows, best] <= d
        gone[rows, best] = True
        live = np.where(gone & good[:, None], np.inf, live)
    return out


def build(x: np.ndarray, degree: int = DEGREE, width: int = BUILD_BEAM, passes: tuple[float, ...] = PASSES, seed: int = 7) -> tuple[np.ndarray, int]:
    """Edges (-1: none) of a graph over the unit vectors ``x``, and its entry, the vector nearest to their mean.

    From random edges on, each pass searches for every point, in random order and in batches, and prunes what the
    search met together with the point's edges; edges are then made mutual, and nodes with too many are pruned.
    """
    n = len(x)
    rng = np.random.default_rng(seed)
    entry = int((x @ x.mean(axis=0)).argmax())
    edges = np.full((n, degree), -1, np.int32)
    if n > 1:
        some = min(degree // 2, n - 1)
        edges[:, :some] = (np.arange(n)[:, None] + rng.integers(1, n, (n, some))) % n
    for alpha in passes:
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            points = order[at : at + BATCH]
            nodes, _, trail = beam_search(x, edges, entry, x[points], width)
            met = np.stack(trail, axis=1) if trail else np.empty((len(points), 0), np.int32)
            edges[points] = robust_prune(x, points, np.concatenate([edges[points], nodes, met], axis=1), degree, alpha)
            back = edges[points]
            target = back.ravel()
            source = np.repeat(points, degree)[target >= 0]
            target = target[target >= 0]
            by = np.argsort(target, kind="stable")
            target, source = target[by], source[by].astype(np.int32)
            hit, first, count = np.unique(target, return_index=True, return_counts=True)
            extra = np.full((len(hit), count.max(initial=1)), -1, np.int32)
            extra[np.repeat(np.arange(len(hit)), count), np.arange(len(target)) - np.repeat(first, count)] = source
            both = np.concatenate([edges[hit], extra], axis=1)
            known = (extra[:, :, None] == edges[hit][:, None, :]).any(axis=2)
            both[:, degree:][known] = -1
            full = (both >= 0).sum(axis=1) > degree
            if full.any():
                edges[hit[full]] = robust_prune(x, hit[full], both[full], degree, alpha)
            rest = both[~full]
            edges[hit[~full]] = np.take_along_axis(rest, np.argsort(rest < 0, axis=1, kind="stable"), 1)[:, :degree]
    return edges, entry


def unit(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.stack(vectors).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def scaled(vectors: list[np.ndarray]) -> np.ndarray:
    """Doubles with the largest component of each below 1; powers of two keep cosines exactly as they were."""
    x = np.stack(vectors).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, vector and dim of the rows that take part, one for each vec_id (of several the least vector)."""
    rows = pick(embeddings, "vec_id", "embedding")
    kind = "array<float>" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("vector"))
    finite = ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(finite & F.exists("vector", lambda v: v != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))


def build_index(vectors: DataFrame, k: int, *, shard: int = SHARD, degree: int = DEGREE, width: int = BUILD_BEAM) -> tuple[DataFrame, int]:
    """(index, shards): a graph for each shard of the different vectors of ``vectors`` (vec_id, vector, dim).

    Equal vectors are one node, with the k + 1 smallest of their ids: no others can be among the k nearest of anything,
    as ties go to the smaller id. Nodes are dealt to shards by a hash, about ``shard`` to each, so a shard's memory is
    bounded and no vector's copies can crowd one.
    """
    prepare(vectors.sparkSession)
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    nodes = vectors.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("vector", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = stored(nodes, "nodes")
    shards = max(1, -(-nodes.count() // shard))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ids", key=lambda s: s.str[0], ignore_index=True)
        edges, entry = build(unit(list(group["vector"])), degree, width)
        group["node"] = np.arange(len(group), dtype=np.int32)
        group["edges"] = [e[e >= 0] for e in edges]
        group["entry"] = group["node"] == entry
        return group[["dim", "shard", "node", "ids", "vector", "edges", "entry"]]

    return nodes.groupBy("dim", "shard").applyInPandas(run, INDEX.format(nodes.schema["vector"].dataType.simpleString())), shards


def search_index(index: DataFrame, queries: DataFrame, k: int, shards: int, *, beam: int = BEAM) -> DataFrame:
    """The k nearest (query_id, rank, vec_id, score) of each of ``queries`` (vec_id, vector, dim), without itself.

    Every shard is searched for every query: queries go to the shards in blocks of a fixed number, and a shard's graph
    is sent to each block. The k best of each shard are ranked together.
    """
    blocks = max(1, -(-queries.count() // QUERIES))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    asked = queries.select("vec_id", "vector", "dim", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    graph = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(nodes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        if nodes.empty or asked.empty:
            return empty
        nodes = nodes.sort_values("node", ignore_index=True)
        raw, least = scaled(list(nodes["vector"])), nodes["ids"].str[0].to_numpy()
        edges = np.full((len(nodes), max(1, max(map(len, nodes["edges"])))), -1, np.int32)
        for i, e in enumerate(nodes["edges"]):
            edges[i, : len(e)] = e
        x, norm = unit(list(nodes["vector"])), np.sqrt((raw * raw).sum(axis=1))
        entry = int(nodes["node"][nodes["entry"]].iloc[0])
        out: list[tuple[int, int, float]] = []
        for at in range(0, len(asked), BATCH):
            part = asked.iloc[at : at + BATCH]
            q = scaled(list(part["vector"]))
            found, _, _ = beam_search(x, edges, entry, unit(list(part["vector"])), max(beam, k + 1))
            dot = np.einsum("qd,qkd->qk", q, raw[found])
            score = np.where(found < 0, -np.inf, dot / (np.sqrt((q * q).sum(axis=1))[:, None] * norm[found]))
            for own, row, values in zip(part["vec_id"], found, score, strict=True):
                best = np.lexsort((least[row], -values))[: k + 1]
                hits = [(values[b], i) for b in best if row[b] >= 0 for i in nodes["ids"][row[b]] if i != own]
                out += [(own, i, s) for s, i in sorted(hits, key=lambda h: (-h[0], h[1]))[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]) if out else empty

    hits = graph.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim", "shard", "block")).applyInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, *, k: int = 5, every: int = 50, beam: int = BEAM, shard: int = SHARD) -> DataFrame:
    """The k nearest vectors by cosine of each vector whose vec_id is divisible by ``every``.

    Needs vec_id and embedding. Returns query_id, rank (from 1, ties to the smaller vec_id), vec_id and score, the
    cosine of the original vectors in double precision; fewer than k if there are fewer candidates. Vectors that are
    null, empty or zero or hold null or non-finite components take no part, nor do null vec_ids; of rows that share a
    vec_id the least vector counts; only vectors of the query's own length are its candidates. Other columns are
    ignored; an empty table gives no rows.
    """
    vectors = stored(valid_vectors(embeddings), "vectors")
    index, shards = build_index(vectors, k, shard=shard)
    return search_index(stored(index, "graph"), vectors.where(F.col("vec_id") % every == 0), k, shards, beam=beam)
