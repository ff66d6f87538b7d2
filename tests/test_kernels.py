from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpwood.functions import distances as D
from kelpwood.functions import graphs as G
from kelpwood.functions import kernels as K

numbers = st.floats(-5, 5).map(lambda v: round(v, 3))
series = st.lists(numbers, min_size=3, max_size=8)


def naive_dtw(a, b, w=-1, weight=lambda k: 1.0):
    inf = math.inf
    d = [[inf] * len(b) for _ in a]
    for i in range(len(a)):
        for j in range(len(b)):
            if w >= 0 and abs(i - j) > w:
                continue
            before = 0 if i == j == 0 else min(d[i - 1][j - 1] if i and j else inf, d[i - 1][j] if i else inf, d[i][j - 1] if j else inf)
            d[i][j] = weight(abs(i - j)) * (a[i] - b[j]) ** 2 + before
    return d[-1][-1]


def one(name, a, b, **p):
    return D.evaluate(name, [a], [b], {k: np.array([float(v)]) for k, v in p.items()})[0]


@settings(max_examples=60, deadline=None)
@given(series, series)
def test_dtw_family(a, b):
    assert np.isclose(one("dtw", a, b), math.sqrt(naive_dtw(a, b)))
    weight = lambda k: 1 / (1 + math.exp(-0.3 * (k - max(len(a), len(b)) / 2)))
    assert np.isclose(one("wdtw", a, b, g=0.3), naive_dtw(a, b, weight=weight))
    total, steps, i, j = K.dtw_paths(np.array([[a]]), np.array([[b]]), np.array([len(a)]), np.array([len(b)]))
    path_cost, path = total[0], list(zip(i[0].tolist(), j[0].tolist(), strict=True))[::-1]
    assert len(path) == steps[0]
    assert np.isclose(path_cost, one("dtw", a, b)) and path[0] == (0, 0) and path[-1] == (len(a) - 1, len(b) - 1)
    assert np.isclose(sum((a[i] - b[j]) ** 2 for i, j in path), path_cost**2)


@settings(max_examples=60, deadline=None)
@given(st.integers(3, 8).flatmap(lambda n: st.tuples(*[st.lists(numbers, min_size=n, max_size=n)] * 2)))
def test_properties(pair):
    a, b = pair
    assert np.isclose(one("dtwcv", a, b, w=0) ** 2, one("euclidean", a, b))
    steps = [one("dtwcv", a, b, w=w) for w in range(len(a))]
    assert all(x >= y - 1e-9 for x, y in zip(steps, steps[1:], strict=False))
    for name in ("euclidean", "manhattan", "dtw", "ddtw", "wdtw", "erp", "msm", "twe", "lcss"):
        assert np.isclose(one(name, a, a), 0), name
        if name != "lcss":
            assert np.isclose(one(name, a, b), one(name, b, a)), name
        assert np.isclose(one(f"{name}_i", [a], [b]), one(name, a, b), equal_nan=True), name
    assert np.isclose(one("dtw_d", [a], [b]), one("dtw", a, b)) and 0 <= one("lcss", a, b, epsilon=0.5) <= 1


def test_ragged_and_missing():
    got = D.evaluate("dtw", [[1.0, 2.0, 3.0], None, [], [1.0, float("nan")], [1.0]], [[1.0, 3.0], [1.0], [1.0], [1.0, 2.0], [4.0]])
    assert np.isclose(got[0], 1.0) and np.isnan(got[1:4]).all() and got[4] == 3.0
    assert np.isnan(D.evaluate("euclidean", [[1.0, 2.0]], [[1.0]])[0])
    try:
        D.get("smoothDTW")
        raise AssertionError
    except ValueError as e:
        assert "unknown distance" in str(e)
    assert len(D.MSM_GRID) == 100 and D.MSM_GRID[0] == 0.01 and D.MSM_GRID[-1] == 100


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5).flatmap(lambda n: st.lists(st.lists(st.integers(0, 9), min_size=n, max_size=n), min_size=1, max_size=n)))
def test_assignment_is_cheapest(rows):
    cost = np.array(rows, float)
    got = G.assignment(cost)
    best = min(sum(cost[i, p[i]] for i in range(len(cost))) for p in permutations(range(cost.shape[1]), len(cost)))
    assert len(set(got)) == len(got) and np.isclose(cost[np.arange(len(cost)), got].sum(), best)


def test_graphs():
    triangle = np.array([[0, 1, 1], [1, 0, 1], [1, 1, 0]], float)
    path = np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0]], float)
    between = lambda name, a, b: D.evaluate(name, [a.tolist()], [b.tolist()])[0]
    assert between("HammingDistance", triangle, path) == 2 and between("GraphletDistance", triangle, path) == math.sqrt(2)
    assert between("ShortestPathDistance", triangle, path) == math.sqrt(2**2 + 2**2) and between("WLDistance", path, path) == 0
    assert G.edit_greedy(triangle, path) == 2 and G.edit_assigned(path, path) == 0 and 0 < between("WLDistance2", triangle, path) <= 1
    # graphs of different order
    assert between("GraphEditDistance", triangle, path[:2, :2]) == 1 and np.isnan(between("HammingDistance", triangle, path[:2, :2]))
    assert between("ShortestPathDistance", triangle, path[:2, :2]) == 4 and between("WLDistance", triangle, path[:2, :2]) > 0
    many = D.evaluate("WLDistance", [triangle.tolist(), path.tolist(), triangle.tolist()], [path.tolist()] * 3)
    assert many[0] == many[2] > 0 == many[1]


def test_user_distances(tmp_path):
    (tmp_path / "mine.py").write_text("def Distance(a, b):\n    return sum(abs(x - y) for x, y in zip(a, b))\n\n\ndef other(a, b):\n    return 7\n")
    assert D.evaluate(f"python:{tmp_path}/mine.py", [[1.0, 2.0], None], [[3.0, 5.0], [1.0]]).tolist()[0] == 5
    assert D.evaluate(f"python:{tmp_path}/mine.py:other", [[1.0]], [[2.0]])[0] == 7
    D.register_distance("late", lambda a, b: len(a))
    assert D.evaluate("late", [[1.0, 2.0]], [[2.0]])[0] == 2


def test_first_component():
    from kelpwood.functions.series import first_component

    line = np.array([0.0, 1.0, 4.0, 2.0])
    got = first_component.func(pa.array([[(2 * line + 1).tolist(), (-line).tolist()], [[1.0, 2.0], [1.0]], None, [[1.0, None]], []], pa.list_(pa.list_(pa.float64())))).to_pylist()
    assert np.allclose(got[0], (line - line.mean()) * np.sqrt(5)) and got[1:] == [None] * 4
