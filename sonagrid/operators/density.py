"""Density clustering of a recording's vectors: mutual reachability, its spanning tree, the condensed tree's stablest clusters."""

from __future__ import annotations

import numpy as np

#: Differences that are held at once, and what a distance of nothing counts as.
HELD, LEAST = 1 << 22, 1e-12


def core_distances(x: np.ndarray, neighbours: int) -> np.ndarray:
    """The distance of each vector to its ``neighbours``-th nearest other one, or to the farthest if there are fewer."""
    out = np.empty(len(x))
    k = min(neighbours, len(x) - 1)
    rows = max(1, HELD // max(1, x.size))
    for a in range(0, len(x), rows):
        d = np.sqrt(((x[a : a + rows, None] - x[None]) ** 2).sum(axis=2))
        d[np.arange(len(d)), np.arange(a, a + len(d))] = -1.0  # a vector is no neighbour of its own
        out[a : a + rows] = np.partition(d, k, axis=1)[:, k]
    return np.maximum(out, 0)


def spanning_tree(x: np.ndarray, neighbours: int) -> np.ndarray:
    """Edges (i, j, weight) of the least spanning tree over mutual reachability, by rising weight.

    Two vectors are as far apart as their distance or either's core distance says, whichever is most. Grown from the
    first vector, one distance row at a time, so memory is that of the vectors.
    """
    n = len(x)
    core = core_distances(x, neighbours)
    best, source, inside = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    edges, at = [], 0
    for _ in range(n - 1):
        inside[at] = True
        far = np.maximum(np.maximum(np.sqrt(((x - x[at]) ** 2).sum(axis=1)), core), core[at])
        nearer = far < best
        best[nearer], source[nearer] = far[nearer], at
        at = int(np.where(inside, np.inf, best).argmin())
        edges.append((source[at], at, best[at]))
    return np.array(sorted(edges, key=lambda e: (e[2], e[0], e[1])), float).reshape(-1, 3)


def merges(edges: np.ndarray, n: int) -> tuple[list[tuple[int, int, float]], list[int]]:
    """The tree of merges along rising edges: (left, right, weight) of nodes n, n + 1, ...; and the sizes of all nodes."""
    root, node, size = list(range(n)), list(range(n)), [1] * n

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    tree = []
    for i, j, w in edges.tolist():
        a, b = find(int(i)), find(int(j))
        tree.append((node[a], node[b], w))
        size.append(size[node[a]] + size[node[b]])
        root[b] = a
        node[a] = n + len(tree) - 1
    return tree, size


def leaves(tree: list[tuple[int, int, float]], n: int, node: int) -> list[int]:
    out, stack = [], [node]
    while stack:
        v = stack.pop()
        if v < n:
            out.append(v)
        else:
            stack += tree[v - n][:2]
    return out


def split(tree: list[tuple[int, int, float]], size: list[int], n: int, node: int, least: int) -> tuple[list[int], list[int]]:
    """What ``node`` comes apart into just below its weight, which several merges may share: large parts, and small ones."""
    weight, stack, parts = tree[node - n][2], [node], []
    while stack:
        v = stack.pop()
        if v >= n and tree[v - n][2] == weight:
            stack += tree[v - n][:2]
        else:
            parts.append(v)
    return [u for u in parts if size[u] >= least], [u for u in parts if size[u] < least]


def density(x: np.ndarray, *, neighbours: int = 20, least: int = 10) -> np.ndarray:
    """Labels of vectors, from 0 in the order of their first members; -1 for those that belong to no cluster.

    As the weight falls from the tree's top, a cluster loses the members that split off in parts of fewer than ``least``
    and ends where larger parts come apart. Its stability is the sum over members of how long (in 1 / weight) they
    stayed. Clusters at least as stable as the best choice below them are taken; the whole is none.
    """
    n = len(x)
    if n < 2:
        return np.full(n, -1)
    tree, size = merges(spanning_tree(np.asarray(x, float), neighbours), n)
    born, parent, stable, left = [0.0], [-1], [0.0], np.zeros(n, int)
    stack = [(2 * n - 2, 0)]
    while stack:
        v, c = stack.pop()
        w = tree[v - n][2]
        at = 1 / max(w, LEAST)
        parts, small = split(tree, size, n, v, least)
        stay = parts[0] if len(parts) == 1 else None
        stable[c] += (size[v] - (size[stay] if stay is not None else 0)) * (at - born[c])
        for u in small:
            left[leaves(tree, n, u)] = c
        for u in parts:
            if stay is None:
                born.append(at)
                parent.append(c)
                stable.append(0.0)
            own = c if stay is not None else len(born) - 1
            if u < n:
                left[u] = own
            else:
                stack.append((u, own))
    count = len(born)
    below, taken = [0.0] * count, [False] * count
    for c in range(count - 1, 0, -1):  # children come after their parents
        taken[c] = stable[c] >= below[c]
        below[parent[c]] += max(stable[c], below[c])
    of = [-1] * count
    for c in range(1, count):
        of[c] = of[parent[c]] if of[parent[c]] >= 0 else c if taken[c] else -1
    label = np.array(of)[left]
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(v, len(seen)) if v >= 0 else -1 for v in label.tolist()])
