"""Distances of small graphs, given as N rows of N weighted edges followed by node features.

All are registered as multivariate distances. Graphs of different order are compared where the
definition allows it, else the distance is null.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import combinations

import numpy as np

from kelpwood.functions import distances as D

ROUNDS = 3


def split(m: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    n = len(m)
    return m[:, :n], (m[:, n:] if m.shape[1] > n else None)


def hamming(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, _: dict) -> np.ndarray:
    """Sum of the absolute differences of all entries; null for different orders."""
    return np.abs(a - b).sum((1, 2)) if a.shape == b.shape else np.full(len(a), np.nan)


def _histogram_gap(p: Counter, q: Counter) -> float:
    return float(np.sqrt(sum((p[k] - q[k]) ** 2 for k in p.keys() | q.keys())))


def path_lengths(m: np.ndarray) -> Counter:
    """How often each shortest path length (to two places) occurs between two nodes; 0 is no edge."""
    adjacency = split(m)[0]
    n = len(adjacency)
    d = np.where(adjacency != 0, adjacency, np.inf)
    np.fill_diagonal(d, np.where(np.diag(adjacency) != 0, np.diag(adjacency), 0))
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    off = d[~np.eye(n, dtype=bool)]
    return Counter(np.floor(off[np.isfinite(off)] * 100 + 0.5) / 100)


def graphlets(m: np.ndarray) -> Counter:
    """Exact counts of the connected kinds of three nodes: triangle, wedge, and one edge."""
    edge = split(m)[0] != 0
    edge = edge | edge.T
    kinds = Counter()
    for three in combinations(range(len(edge)), 3):
        kinds[sum(bool(edge[i, j]) for i, j in combinations(three, 2))] += 1
    return Counter({k: kinds[k] for k in (1, 2, 3)})


def _refined(m: np.ndarray, start: list, linked: np.ndarray, keep_first: bool) -> Counter:
    """Labels of ROUNDS rounds of neighbourhood refinement, as nested tuples that mean the same in any graph."""
    labels, seen = start, Counter(start if keep_first else [])
    for _ in range(ROUNDS):
        labels = [(labels[i], tuple(sorted((labels[j] for j in np.flatnonzero(linked[i])), key=repr))) for i in range(len(labels))]
        seen.update(labels)
    return seen


def refined(m: np.ndarray) -> Counter:
    """Counts of refined labels; features count modulo 10 of their whole part."""
    adjacency, features = split(m)
    start = ["init"] * len(m) if features is None else [tuple(int(np.fmod(int(v), 10)) for v in row) for row in features]
    return _refined(m, start, adjacency != 0, False)


def refined_shares(m: np.ndarray) -> Counter:
    """Shares of initial and refined labels; features lie in 0..1, in bins."""
    adjacency, features = split(m)
    place = lambda v: int(v) if v in (0.0, 1.0) else int(np.floor(v * 9))
    start = ["init"] * len(m) if features is None else [tuple(place(v) for v in np.clip(row, 0, 1)) for row in features]
    seen = _refined(m, start, adjacency > 0, True)
    n = sum(seen.values())
    return Counter({k: v / n for k, v in seen.items()})


def _cosine_gap(p: Counter, q: Counter) -> float:
    norm = np.sqrt(sum(v * v for v in p.values())) * np.sqrt(sum(v * v for v in q.values()))
    return float(1 - sum(v * q.get(k, 0) for k, v in p.items()) / norm) if norm > 0 else 1.0


def _by_counts(count: Callable[[np.ndarray], Counter], gap: Callable[[Counter, Counter], float]) -> Callable:
    """A distance of two graphs' counts; each distinct graph of a batch is counted once."""

    def run(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, _: dict) -> np.ndarray:
        places, counts = [], []
        for x in (a, b):
            distinct, place = np.unique(np.ascontiguousarray(x).reshape(len(x), -1), axis=0, return_inverse=True)
            places.append(place.ravel())
            counts.append([count(m.reshape(x.shape[1:])) for m in distinct])
        pairs, back = np.unique(np.column_stack(places), axis=0, return_inverse=True)
        return np.array([gap(counts[0][i], counts[1][j]) for i, j in pairs.tolist()])[back.ravel()]

    return run


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the cheapest assignment of a matrix with at most as many rows as columns,
    by shortest augmenting paths with potentials."""
    n, m = cost.shape
    u, v, row_of = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        row_of[m] = i
        j, least, back, done = m, np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while row_of[j] >= 0:
            done[j] = True
            r = row_of[j]
            open_ = ~done[:m]
            slack = cost[r] - u[r] - v[:m]
            better = open_ & (slack < least)
            least[better], back[better] = slack[better], j
            step = int(np.flatnonzero(open_)[np.argmin(least[open_])])
            delta = least[step]
            u[row_of[done]] += delta
            v[done] -= delta
            least[open_] -= delta
            j = step
        while j != m:
            row_of[j] = row_of[back[j]]
            j = back[j]
    out = np.full(n, -1)
    for j in range(m):
        if row_of[j] >= 0:
            out[row_of[j]] = j
    return out


def _node_costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    (ga, fa), (gb, fb) = split(a), split(b)
    if fa is not None and fb is not None:
        k = min(fa.shape[1], fb.shape[1])
        return np.sqrt(((fa[:, None, :k] - fb[None, :, :k]) ** 2).sum(2))
    return np.abs(ga.sum(1)[:, None] - gb.sum(1)[None])


def _edit_cost(a: np.ndarray, b: np.ndarray, match: dict[int, int]) -> float:
    """Edges over ordered pairs of matched nodes, and one for each node that is left over."""
    ga, gb = split(a)[0], split(b)[0]
    rows, columns = np.array(list(match), int), np.array(list(match.values()), int)
    x, y = ga[np.ix_(rows, rows)], gb[np.ix_(columns, columns)]
    off = ~np.eye(len(rows), dtype=bool)
    both, one = (x != 0) & (y != 0) & off, ((x != 0) ^ (y != 0)) & off
    return float(np.abs(x - y)[both].sum() + one.sum() + len(a) + len(b) - 2 * len(rows))


def edit_greedy(a: np.ndarray, b: np.ndarray) -> float:
    """Graph edit cost of matching nodes greedily in order."""
    cost, match = _node_costs(a, b), {}
    free = np.ones(len(b), bool)
    for i in range(len(a)):
        if free.any():
            j = int(np.argmin(np.where(free, cost[i], np.inf)))
            match[i], free[j] = j, False
    return _edit_cost(a, b, match)


def edit_assigned(a: np.ndarray, b: np.ndarray) -> float:
    """Graph edit cost under the assignment of nodes that is cheapest over all of them."""
    cost = _node_costs(a, b)
    if len(a) <= len(b):
        return _edit_cost(a, b, dict(enumerate(assignment(cost).tolist())))
    return _edit_cost(a, b, {int(i): j for j, i in enumerate(assignment(cost.T))})


D.register(D.Distance("HammingDistance", hamming, (), True, exact=True, uneven=True))
for _name, _count, _gap in (("ShortestPathDistance", path_lengths, _histogram_gap), ("GraphletDistance", graphlets, _histogram_gap), ("WLDistance", refined, _histogram_gap), ("WLDistance2", refined_shares, _cosine_gap)):
    D.register(D.Distance(_name, _by_counts(_count, _gap), (), True, exact=True, uneven=True))
for _name, _fn in (("ApproximateGraphEditDistance", edit_greedy), ("GraphEditDistance", edit_assigned)):
    D.register(D.Distance(_name, D.each(_fn), (), True, exact=True, uneven=True))
