"""Density clusters against a recursion over components of the whole distance matrix."""

import numpy as np
import pytest

from sonagrid.operators import density, labels


def reach(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d + np.diag(np.full(len(x), -1.0)), axis=1)[:, min(k, len(x) - 1)]
    return np.maximum(np.maximum(d, core[:, None]), core[None])


def components(r, members, below):
    left, out = set(members), []
    while left:
        stack, part = [left.pop()], set()
        while stack:
            v = stack.pop()
            part.add(v)
            near = {u for u in left if r[v, u] < below}
            left -= near
            stack += near
        out.append(part)
    return out


def naive(x, k, least):
    r = reach(x, k)
    weights = sorted({w for w in r[np.triu_indices(len(x), 1)]})
    clusters = []  # [birth, children, stability, fallen points]

    def grow(members, birth):
        own = [birth, [], 0.0, {}]
        clusters.append(own)
        while True:
            # the least weight at which the members still hang together is that of the last merge
            lo, hi = 0, len(weights) - 1
            while lo < hi:
                mid = (lo + hi) // 2
                if len(components(r, members, np.nextafter(weights[mid], np.inf))) == 1:
                    hi = mid
                else:
                    lo = mid + 1
            w = weights[lo]
            parts = components(r, members, w)
            large = [p for p in parts if len(p) >= least]
            if len(large) == 1:
                fallen = members - large[0]
            else:
                fallen = members
            own[2] += len(fallen) * (1 / w - birth)
            if len(large) > 1:
                own[1] = [grow(p, 1 / w) for p in large]
                for p in parts:
                    if len(p) < least:
                        own[3] |= dict.fromkeys(p)
                return own
            own[3] |= dict.fromkeys(fallen)
            if not large:
                return own
            members = large[0]

    def best(c):
        below = sum(best(d)[0] for d in c[1])
        return (max(c[2], below), c[2] >= below)

    def members(c):
        return set(c[3]).union(*map(members, c[1])) if c[1] else set(c[3])

    def choose(c, whole):
        if not whole and best(c)[1]:
            return [members(c)]
        return [s for d in c[1] for s in choose(d, False)]

    return {frozenset(s) for s in choose(grow(set(range(len(x))), 0.0), True)}


@pytest.mark.parametrize("seed", range(12))
def test_clusters_are_those_of_the_recursion(seed):
    rng = np.random.default_rng(seed)
    k, least = int(rng.integers(1, 6)), int(rng.integers(2, 7))
    x = np.concatenate([rng.normal(size=(int(rng.integers(4, 16)), 3)) * rng.uniform(0.1, 1) + rng.normal(size=3) * 4 for _ in range(int(rng.integers(1, 5)))] + [rng.normal(size=(5, 3)) * 6])
    label = density.density(x, neighbours=k, least=least)
    assert {frozenset(np.flatnonzero(label == c).tolist()) for c in set(label.tolist()) - {-1}} == naive(x, k, least)


def test_small_and_equal_inputs():
    assert density.density(np.zeros((0, 3))).tolist() == [] and density.density(np.zeros((1, 3))).tolist() == [-1]
    two = np.repeat(np.array([[0.0, 0.0], [9.0, 9.0]]), 12, axis=0)
    assert density.density(two, neighbours=3, least=5).tolist() == [0] * 12 + [1] * 12
    assert set(density.density(np.random.default_rng(0).normal(size=(600, 8)), neighbours=5, least=300).tolist()) <= {-1, 0, 1}


def test_core_distances_come_in_blocks():
    x = np.random.default_rng(1).normal(size=(700, 5))
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), axis=1)
    assert np.allclose(density.core_distances(x, 7), d[:, 7]) and np.allclose(density.core_distances(x[:4], 9), np.sort(np.sqrt(((x[:4, None] - x[None, :4]) ** 2).sum(axis=2)), axis=1)[:, 3])


def test_by_recording(spark):
    rng = np.random.default_rng(3)
    rows = [(rec, i, (rng.normal(size=4) * 0.2 + 5 * (i % 2)).tolist()) for rec in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "rec int, seq int, e array<double>")
    got = labels.cluster_embeddings(df, ["rec"], "seq", "e", "density", cluster_line=0, neighbours=3, least=10).collect()
    for rec in range(3):
        even = {r["label"] for r in got if r["rec"] == rec and r["seq"] % 2 == 0}
        odd = {r["label"] for r in got if r["rec"] == rec and r["seq"] % 2}
        assert len(even) == len(odd) == 1 and even != odd
