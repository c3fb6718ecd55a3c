"""Spectral clustering of sparse graphs against the dense form."""

import time
import tracemalloc

import numpy as np
import pytest

from sonagrid.operators import graphs, labels


def blobs(n, k, seed, noise=0.25, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, d))
    return np.concatenate([c + noise * rng.normal(size=(n // k + (i < n % k), d)) for i, c in enumerate(centres)])


def pruned(x, pval, least):
    n = len(x)
    sims = labels.cosine_matrix(x)
    m = graphs.kept_rows(n, pval, least)
    best = np.argsort(sims, axis=1, kind="stable")[:, n - m :]
    return np.repeat(np.arange(n), m), best.ravel(), np.take_along_axis(sims, best, 1).ravel()


@pytest.mark.parametrize(("n", "k", "pval"), [(60, 3, 0.1), (150, 5, 0.05), (400, 4, 0.02), (40, 2, 1.0), (7, 1, 0.02)])
def test_lowest_values_are_those_of_the_dense_matrix(n, k, pval):
    x = blobs(n, k, n)
    i, j, w = pruned(x, pval, 6)
    times, bound = graphs.laplacian(i, j, w, n)
    a = np.zeros((n, n))
    a[i, j] = w
    a = (a + a.T) / 2
    np.fill_diagonal(a, 0)
    dense = np.diag(np.abs(a).sum(axis=1)) - a
    assert np.allclose(times(np.eye(n)), dense)
    want, vecs = np.linalg.eigh(dense)
    take = min(n, 11)
    got, own = graphs.lowest(times, bound, n, take)
    assert np.allclose(got, want[:take], atol=1e-6 * bound)
    assert np.allclose(dense @ own, own * got, atol=1e-6 * bound)


def partition(labels_):
    seen = {}
    return [seen.setdefault(v, len(seen)) for v in labels_]


@pytest.mark.parametrize("size", [16, 512])
def test_labels_are_those_of_the_dense_form(spark, size):
    rows, want = [], {}
    for rec, (n, k) in enumerate([(90, 3), (130, 5), (60, 2), (1, 1), (8, 1)]):
        x = blobs(n, k, rec)
        rows += [(rec, f"u{i:04d}", v.tolist()) for i, v in enumerate(x)]
        want[rec] = partition(labels.spectral(x, pval=0.05) if n > 1 else [0])
    df = spark.createDataFrame(rows, "rec int, utt string, embedding array<double>").repartition(5)
    got = graphs.cluster_spectral(df, ["rec"], "utt", "embedding", pval=0.05, size=size).orderBy("rec", "utt").collect()
    for rec in want:
        assert partition(r["label"] for r in got if r["rec"] == rec) == want[rec]


def test_edges_are_the_largest_similarities(spark):
    x = blobs(45, 3, 9)
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "rec int, seq int, e array<double>")
    got = sorted((r["i"], r["j"], round(r["w"], 9)) for r in graphs.edges(graphs.pruned_graph(df, ["rec"], "seq", "e", pval=0.2, least=6, size=10), ["rec"]).collect())
    i, j, w = pruned(x, 0.2, 6)
    assert got == sorted(zip(i.tolist(), j.tolist(), np.round(w, 9).tolist(), strict=True))


def test_separate_parts_and_no_edges():
    i = np.array([0, 1, 2, 3, 4, 5])
    values, vecs = graphs.lowest(*graphs.laplacian(i, np.array([1, 0, 3, 2, 5, 4]), np.ones(6), 6), 6, 4)
    assert np.allclose(values, [0, 0, 0, 2]) and np.allclose(vecs.T @ vecs, np.eye(4))
    assert partition(graphs.spectral_sparse(i, np.array([1, 0, 3, 2, 5, 4]), np.ones(6), 6, oracle=3)) == [0, 0, 1, 1, 2, 2]
    assert graphs.lowest(*graphs.laplacian(i, i, np.ones(6), 6), 6, 2)[0].tolist() == [0, 0]


def grouped_vectors(n, parts=3, size=16, noise=0.12, seed=5):
    rng = np.random.default_rng(seed)
    of = rng.integers(0, parts, n)
    return rng.normal(size=(parts, size))[of] + noise * rng.normal(size=(n, size)), of


def test_average_linkage_is_as_restated_and_about_square():
    rng = np.random.default_rng(1)
    for n in (2, 3, 40, 150):
        x = rng.normal(size=(n, 4)).round(0 if n == 40 else 6)  # ties among rounded ones
        u = x / np.where((s := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, s)
        sim, size, label = u @ u.T, np.ones(n), np.arange(n)
        np.fill_diagonal(sim, -np.inf)
        while True:
            i, j = sorted(np.unravel_index(sim.argmax(), sim.shape))
            if sim[i, j] < 0.4:
                break
            row = (sim[i] * size[i] + sim[j] * size[j]) / (size[i] + size[j])
            sim[i], sim[:, i] = row, row
            sim[i, i], sim[j], sim[:, j] = -np.inf, -np.inf, -np.inf
            size[i] += size[j]
            label[label == j] = i
        assert (labels.ahc(x) == np.unique(label, return_inverse=True)[1]).all()
    x, of = grouped_vectors(4000)
    began = time.monotonic()
    got = labels.ahc(x)
    assert time.monotonic() - began < 15 and partition(got) == partition(of)


def test_average_linkage_of_many_vectors_holds_no_matrix():
    for seed, near in ((0, 3), (1, 64)):
        x = np.random.default_rng(seed).normal(size=(900, 6))
        x[100:130], x[[5, 9]] = x[7], 0
        for threshold in (0.2, 0.4, 0.8):
            assert (labels.ahc_means(x, threshold, near) == labels.ahc(x, threshold)).all()
    x, of = grouped_vectors(5000)
    tracemalloc.start()
    got = labels.ahc(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert partition(got) == partition(of) and peak < 5000 * 5000 * 8 * 0.7


def test_small_clusters_go_to_the_nearest_large_one():
    x, of = grouped_vectors(600, noise=0.8)
    label = np.where(np.arange(600) % 7 == 0, np.arange(600) % 70 + 10, of * 100)
    big = np.array([0, 100, 200])
    c = np.stack([x[label == i].mean(axis=0) for i in big])
    near = big[(x @ c.T / np.linalg.norm(c, axis=1)).argmax(axis=1)]
    assert (labels.minor_absorbed(label, x, 20) == np.where(np.isin(label, big), label, near)).all()


def test_long_recordings_are_clustered_without_a_matrix():
    x, of = grouped_vectors(1600)
    tracemalloc.start()
    got = labels.spectral(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert partition(got) == partition(of) and peak < 2.5 * 1600 * 1600 * 8  # a matrix, its places and its eigenvectors are over 3
    i, j, w = graphs.kept_edges(x, 0.02, 6, size=100)
    sims = labels.cosine_matrix(x)
    best = np.argsort(sims, axis=1, kind="stable")[:, -32:]
    assert (j.reshape(1600, 32) == best).all() and np.allclose(w.reshape(1600, 32), np.take_along_axis(sims, best, 1)) and (i == np.repeat(np.arange(1600), 32)).all()


def test_a_block_is_sent_alone_and_not_as_a_pair(spark):
    x = np.random.default_rng(3).normal(size=(90, 4))
    df = spark.createDataFrame([(0, k, [float(v) for v in row]) for k, row in enumerate(x)], "rec int, utt int, embedding array<double>")
    graph = graphs.pruned_graph(df, ["rec"], "utt", "embedding", pval=0.2, size=16)
    assert "Join" not in graph._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r["i"], r["j"]) for r in graphs.edges(graph, ["rec"]).collect())
    i, j, _ = graphs.kept_edges(x, 0.2, 6)
    assert got == sorted(zip(i.tolist(), j.tolist(), strict=True))


def test_a_block_is_sent_once_for_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(graphs, "PART", 2, raising=False)
    monkeypatch.setattr(graphs, "HELD", 700, raising=False)
    x = np.random.default_rng(4).normal(size=(90, 4)).round(0)  # many equal similarities
    df = spark.createDataFrame([(r, k, [float(v) for v in row]) for r in (0, 1) for k, row in enumerate(x[: 90 - 37 * r])], "rec int, utt int, embedding array<double>")
    assert graphs.met_blocks(df, ["rec"], "utt", "embedding", 16).groupBy("rec").count().orderBy("rec").collect() == [(0, 18), (1, 8)]
    graph = graphs.pruned_graph(df, ["rec"], "utt", "embedding", pval=0.2, size=16)
    assert graph.selectExpr("max(length(i)) AS most").first()["most"] <= 700 * 0.22 * 4  # as many rows as are held at a time, not a block's
    for got in (graphs.edges(graph, ["rec"]), graphs.pruned_edges(df, ["rec"], "utt", "embedding", pval=0.2, size=16)):
        rows = got.collect()
        for r in (0, 1):
            u = graphs.unit_rows(x[: 90 - 37 * r], 90 - 37 * r)
            found = np.array([(e["i"], e["j"], e["w"]) for e in rows if e["rec"] == r])
            i, j = found[:, 0].astype(int), found[:, 1].astype(int)
            m = graphs.kept_rows(len(u), 0.2, 6)
            assert (np.bincount(i) == m).all() and np.allclose(found[:, 2], (u @ u.T)[i, j])
            best = np.sort(u @ u.T, axis=1)[:, -m:]
            assert np.allclose(np.sort(found[np.lexsort((found[:, 2], i)), 2].reshape(-1, m), axis=1), best)


def test_of_equal_similarities_the_later_stay():
    sims = np.random.default_rng(2).integers(0, 4, (60, 40)).astype(float)
    sims[5, 3], sims[6] = np.nan, 1
    for m in (1, 7, 39, 40):
        want = np.zeros(sims.shape, bool)
        np.put_along_axis(want, np.argsort(sims, axis=1, kind="stable")[:, 40 - m :], True, axis=1)
        assert (graphs.largest(sims, m) == want).all()


def test_kept_places_are_the_graph_of_kept_edges(monkeypatch):
    x = np.random.default_rng(8).normal(size=(300, 8))
    x[50:60] = x[3]
    x[70] = 0
    dense = graphs.laplacian(*graphs.kept_edges(x, 0.05, 6), 300)[0](np.eye(300))
    for kept, held in ((1 << 20, 1 << 22), (10, 900)):  # in memory, and a few rows at a time in a file
        monkeypatch.setattr(graphs, "KEPT", kept)
        monkeypatch.setattr(graphs, "HELD", held)
        near, w = graphs.kept_places(x, 0.05, 6)
        assert isinstance(near, np.memmap) == (kept == 10)
        times, bound, degree = graphs.near_laplacian(near, w)
        assert np.allclose(times(np.eye(300)), dense) and np.allclose(degree, np.diag(dense)) and bound == 2 * degree.max()


def test_few_products_give_the_lowest_vectors(monkeypatch):
    """A product goes over all edges, so they are most of the time."""
    x, of = grouped_vectors(3000, noise=0.8)
    products, lowest = [], graphs.lowest

    def counted(times, *rest, **how):
        return lowest(lambda v: (products.append(v.shape[1]), times(v))[1], *rest, **how)

    monkeypatch.setattr(graphs, "lowest", counted)
    got = labels.spectral(x)
    i, j, w = graphs.kept_edges(x, 0.02, 6)
    a = np.zeros((3000, 3000))
    a[i, j] = w
    a = (a + a.T) / 2
    np.fill_diagonal(a, 0)
    values, vecs = np.linalg.eigh(np.diag(np.abs(a).sum(axis=1)) - a)
    k = 1 + int(np.argmax(np.diff(values[:11])))
    assert partition(got) == partition(labels.k_means(vecs[:, :k], k)) and sum(products) < 600


def test_edges_travel_as_places_of_about_a_byte(spark):
    x = np.sort(np.random.default_rng(1).choice(100_000, 2000, replace=False))
    assert (graphs.places(graphs.gaps(x)) == x).all() and len(graphs.gaps(x)) < 1.3 * len(x)
    for some in ([0], [255], [254, 510, 70_000], []):
        assert graphs.places(graphs.gaps(np.array(some, np.int64))).tolist() == some
    v = blobs(300, 3, 5)
    df = spark.createDataFrame([(k % 2 or None, 299 - k, [float(z) for z in row]) for k, row in enumerate(v)], "rec int, utt int, embedding array<double>")
    found = graphs.cluster_spectral(df, ["rec"], "utt", "embedding", size=64)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "near" in plan and "Join" not in plan  # no similarities beside the places
    got = found.orderBy("utt").collect()
    for rec in (None, 1):
        want = partition(labels.spectral(v[1 if rec else 0 :: 2][::-1]))
        assert partition(r["label"] for r in got if r["rec"] == rec) == want
