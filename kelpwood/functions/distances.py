"""Registry of pairwise distances: names, parameters, and how two array columns are compared.

One-dimensional distances take array<double>, multivariate ones array<array<double>> (channel-major).
``_i`` names average a one-dimensional distance over the channels, ``_d`` names warp all channels on
one path. Plain sums are Column expressions that stay in the JVM; dynamic programs run as batched
numpy kernels in Arrow. A pair with a null, empty or (where lengths must agree) unequal series has a
null distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpwood.functions import kernels as K
from kelpwood.functions import series as S
from kelpwood.functions.arrays import Channels, lists

PARAMS = ("w", "g", "c", "nu", "lam", "epsilon", "delta")
#: The grids that the costs of msm and twe are drawn from.
MSM_GRID = (
    0.01, 0.01375, 0.0175, 0.02125, 0.025, 0.02875, 0.0325, 0.03625, 0.04, 0.04375,
    0.0475, 0.05125, 0.055, 0.05875, 0.0625, 0.06625, 0.07, 0.07375, 0.0775, 0.08125,
    0.085, 0.08875, 0.0925, 0.09625, 0.1, 0.136, 0.172, 0.208, 0.244, 0.28,
    0.316, 0.352, 0.388, 0.424, 0.46, 0.496, 0.532, 0.568, 0.604, 0.64,
    0.676, 0.712, 0.748, 0.784, 0.82, 0.856, 0.892, 0.928, 0.964, 1,
    1.36, 1.72, 2.08, 2.44, 2.8, 3.16, 3.52, 3.88, 4.24, 4.6,
    4.96, 5.32, 5.68, 6.04, 6.4, 6.76, 7.12, 7.48, 7.84, 8.2,
    8.56, 8.92, 9.28, 9.64, 10, 13.6, 17.2, 20.8, 24.4, 28,
    31.6, 35.2, 38.8, 42.4, 46, 49.6, 53.2, 56.8, 60.4, 64,
    67.6, 71.2, 74.8, 78.4, 82, 85.6, 89.2, 92.8, 96.4, 100,
)
TWE_NU = (0.00001, 0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1)
TWE_LAMBDA = (0, 0.011111111, 0.022222222, 0.033333333, 0.044444444, 0.055555556, 0.066666667, 0.077777778, 0.088888889, 0.1)
DEFAULT_POOL = ("euclidean", "dtw", "dtwcv", "ddtw", "ddtwcv", "wdtw", "wddtw", "lcss", "erp", "twe", "msm")


@dataclass(frozen=True)
class Distance:
    """A distance of pairs of series as arrays (pairs, channels, length) with their lengths and parameters.

    ``exact`` ones take only pairs of the same two lengths together and no padding; ``average`` ones are the mean of
    a one-dimensional distance over the channels.
    """

    name: str
    run: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]], np.ndarray]
    params: tuple[str, ...] = ()
    multi: bool = False
    column: Callable[[Column, Column], Column] | None = None
    defaults: dict[str, float] = field(default_factory=dict)
    exact: bool = False
    average: bool = False
    uneven: bool = False  # compares different numbers of channels
    abandons: bool = False  # gives up pairs that are sure to be farther than a limit


REGISTRY: dict[str, Distance] = {}


def register(d: Distance, *aliases: str) -> Distance:
    for name in (d.name, *aliases):
        REGISTRY[name.lower()] = d
    return d


def each(fn: Callable[[np.ndarray, np.ndarray], float], multi: bool = True) -> Callable:
    """Pair by pair, for distances that are Python functions of two arrays."""
    own = (lambda x: x) if multi else (lambda x: x[0])
    return lambda a, b, la, lb, _: np.array([float(fn(own(x), own(y))) for x, y in zip(a, b, strict=True)])


def register_distance(name: str, fn: Callable[[object, object], float], multi: bool = False) -> Distance:
    """A user's own Python distance of two numpy arrays, by name like the built-in ones."""
    return register(Distance(name, each(fn, multi), (), multi, exact=True))


def from_file(path: str, function: str = "Distance", multi: bool = False) -> Distance:
    """A user's own Python distance from a file: ``function`` of two arrays; known as python:path:function. The function
    travels to the executors by value."""
    with open(path, encoding="utf-8") as f:
        source = f.read()

    def run(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, p: dict) -> np.ndarray:
        space: dict = {"__name__": "user_distance"}
        exec(compile(source, path, "exec"), space)  # noqa: S102
        return each(space[function], multi)(a, b, la, lb, p)

    return register(Distance(f"python:{path}:{function}", run, (), multi, exact=True))


def get(name: str) -> Distance:
    if name.lower() not in REGISTRY and name.startswith("python:"):
        path, _, function = name.removeprefix("python:").partition(":")
        return from_file(path, function or "Distance")
    if name.lower() not in REGISTRY:
        raise ValueError(f"unknown distance {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name.lower()]


def _keogh(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return K.keogh(x, n), n


def _diff(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.diff(x, axis=2), n - 1


def _warping(kernel: Callable, params: tuple[str, ...], change: Callable | None = None, root: bool = False) -> Callable:
    def run(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
        if change:
            (a, la), (b, lb) = change(a, la), change(b, lb)
        d = kernel(a, b, la, lb, *(p[k] for k in params), **({"limit": p["limit"]} if "limit" in p else {}))
        return np.sqrt(d) if root else d

    return run


def _aligned(fn: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable:
    """A distance of series of one length, (pairs, length); others have none."""
    return lambda a, b, la, lb, _: fn(a[:, 0], b[:, 0]) if a.shape[2] == b.shape[2] else np.full(len(a), np.nan)


def _cos(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))
    return np.where(n > 0, 1 - (x * y).sum(1) / np.where(n > 0, n, 1), 1.0)


def _cid(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    cx, cy = (np.sqrt((np.diff(v, axis=1) ** 2).sum(1)) for v in (x, y))
    d, least = np.sqrt(((x - y) ** 2).sum(1)), np.minimum(cx, cy)
    return np.where(least > 0, d * np.maximum(cx, cy) / np.where(least > 0, least, 1), np.where(d == 0, 0.0, np.inf))


def _of_histograms(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if not x.shape[1] or not y.shape[1]:
        return np.zeros(len(x))
    full = lambda h: np.full(len(h), h.shape[1])
    return K.dtw(x[:, None], y[:, None], full(x), full(y))


def _hog_1d(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, _: dict) -> np.ndarray:
    one = lambda x: K.gradients_histogram(np.diff(x[:, 0], axis=1), int(np.sqrt(max(0, x.shape[2] - 1))))
    return _of_histograms(one(a), one(b))


def _hog_multi(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, _: dict) -> np.ndarray:
    one = lambda x: K.gradients_histogram(np.diff(x, n=2, axis=2).reshape(len(x), -1), int(np.sqrt(max(0, x.shape[2] - 1))))
    return _of_histograms(one(a), one(b))


_dtw = _warping(K.dtw, ())
_W = {"w": -1.0}
for _name, _run, _params, _column, _defaults, _exact in (
    ("euclidean", _aligned(lambda x, y: ((x - y) ** 2).sum(1)), (), S.squared_euclidean, {}, True), ("manhattan", _aligned(lambda x, y: np.abs(x - y).sum(1)), (), S.manhattan, {}, True),
    ("cosine", _aligned(_cos), (), S.cosine_distance, {}, True), ("cid", _aligned(_cid), (), S.cid_distance, {}, True), ("sbd", _aligned(K.sbd), (), None, {}, True), ("shapeHoG1dDTW", _hog_1d, (), None, {}, True),
    ("dtw", _dtw, (), None, {}, False), ("dtwcv", _warping(K.dtw, ("w",)), ("w",), None, _W, False), ("ddtw", _warping(K.dtw, (), _keogh), (), None, {}, False), ("ddtwcv", _warping(K.dtw, ("w",), _keogh), ("w",), None, _W, False),
    ("wdtw", _warping(K.wdtw, ("g",)), ("g",), None, {"g": 0.05}, False), ("wddtw", _warping(K.wdtw, ("g",), _keogh), ("g",), None, {"g": 0.05}, False),
    ("lcss", _warping(K.lcss, ("epsilon", "delta")), ("epsilon", "delta"), None, {"epsilon": 0.5, "delta": -1.0}, False), ("erp", _warping(K.erp, ("g", "w")), ("g", "w"), None, {"g": 0.0, "w": -1.0}, False),
    ("msm", _warping(K.msm, ("c",)), ("c",), None, {"c": 1.0}, False), ("twe", _warping(K.twe, ("nu", "lam")), ("nu", "lam"), None, {"nu": 0.001, "lam": 0.1}, False),
):
    register(Distance(_name, _run, _params, False, _column, _defaults, _exact, abandons=not _exact))
    register(Distance(f"{_name}_i", _run, _params, True, None, _defaults, _exact, True))
for _name, _run, _params, _defaults in (
    ("dtw_d", _dtw, (), {}), ("ddtw_d", _warping(K.dtw, (), _diff), (), {}), ("wdtw_d", _warping(K.wdtw, ("g",), None, True), ("g",), {"g": 0.05}), ("wddtw_d", _warping(K.wdtw, ("g",), _diff, True), ("g",), {"g": 0.05}),
):
    register(Distance(_name, _run, _params, True, None, _defaults))
register(Distance("shapeHoGdtw_d", _hog_multi, (), True, exact=True), "shapeHoGdtw")


PAIRS, CELLS = 2048, 4_000_000  # pairs and numbers of one batch at most


def _batches(la: np.ndarray, lb: np.ndarray, channels: int, exact: bool) -> Iterator[np.ndarray]:
    """Places of pairs of similar lengths (of the same lengths, if ``exact``)."""
    order = np.lexsort((lb, la))
    at = 0
    while at < len(order):
        end = min(len(order), at + PAIRS)
        if exact:
            change = np.flatnonzero((la[order[at + 1 : end]] != la[order[at]]) | (lb[order[at + 1 : end]] != lb[order[at]]))
            end = at + 1 + int(change[0]) if len(change) else end
        while end - at > 1 and (end - at) * channels * int(la[order[at:end]].max() + 3 * lb[order[at:end]].max()) > CELLS:
            end = at + (end - at) // 2
        yield order[at:end]
        at = end


def _given(d: Distance, n: int, params: dict[str, np.ndarray] | None, limit: np.ndarray | None) -> dict[str, np.ndarray]:
    """Parameters of n pairs, with the distance's own where none are given."""
    given = params or {}
    filled = {k: np.asarray(given[k] if k in given else np.full(n, np.nan), float) for k in d.params}
    filled = {k: np.where(np.isnan(v), d.defaults.get(k, 0.0), v) for k, v in filled.items()}
    return filled | ({"limit": limit} if limit is not None and d.abandons else {})


def alike(*columns: pa.Array) -> list[np.ndarray] | None:
    """One-dimensional series as tables (rows, length) of one length, if all are whole and of that length, else None."""
    held = [Channels(lists(c, 1), False) for c in columns]
    length = next((int(h.size[0, 0]) for h in held if len(h.size)), 0)
    if length < 1 or not all((h.size == length).all() and h.whole().all() for h in held):
        return None
    return [h.values.reshape(-1, length) for h in held]


def evaluate_alike(d: Distance, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, params: dict[str, np.ndarray] | None = None, limit: np.ndarray | None = None) -> np.ndarray:
    """As ``evaluate``, for the pairs (a[i], b[j]) of two tables of series of one length."""
    out, length = np.empty(len(i)), a.shape[1]
    filled = _given(d, len(i), params, limit)
    dense = lambda x: np.ascontiguousarray(x.T)[:, None].transpose(2, 1, 0)
    for at in range(0, len(i), PAIRS):
        part = slice(at, at + PAIRS)
        size = np.full(len(i[part]), length)
        out[part] = d.run(dense(a[i[part]]), dense(b[j[part]]), size, size, {k: v[part] for k, v in filled.items()})
    return out


def evaluate(name: str | Distance, a: object, b: object, params: dict[str, np.ndarray] | None = None, limit: np.ndarray | None = None) -> np.ndarray:
    """Distances of pairs of series, Arrow columns or lists; NaN where two series can't be compared. With a ``limit``, those
    above it may be infinite."""
    d = get(name) if isinstance(name, str) else name
    x, y = (Channels(lists(v, 2 if d.multi else 1), d.multi) for v in (a, b))
    n = len(x.counts)
    out = np.full(n, np.nan)
    filled = _given(d, n, params, limit)
    fit = x.whole() & y.whole() & (d.uneven | (x.counts == y.counts))
    if not d.average:  # channels of one length
        for s in (x, y):
            fit &= ((s.size == s.size[:, :1]) | (np.arange(s.channels) >= s.counts[:, None])).all(1) if s.channels else False
    rows = np.flatnonzero(fit)
    if d.average:
        counts = x.counts[rows]
        own, first = np.repeat(rows, counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        groups = [(1, 1, own, first)]
    else:
        kinds, which = np.unique(np.column_stack([x.counts[rows], y.counts[rows]]), axis=0, return_inverse=True)
        groups = [(*kind, rows[which.ravel() == g], 0) for g, kind in enumerate(kinds.tolist())]
    total = np.zeros(n)
    for channels, others, own, first in groups:
        at = np.broadcast_to(np.asarray(first), own.shape)
        la, lb = x.size[own, at], y.size[own, at]
        for part in _batches(la, lb, max(channels, others), d.exact):
            m = own[part]
            left = x.dense(m, channels, int(la[part].max()), at[part], 0.0)
            right = y.dense(m, others, int(lb[part].max()), at[part], 0.0)
            np.add.at(total, m, d.run(left, right, la[part], lb[part], {k: v[m] for k, v in filled.items()}))
    out[rows] = total[rows] / x.counts[rows] if d.average else total[rows]
    return out


def distance(name: str, a: Column, b: Column, **params: float | Column) -> Column:
    """Column of the distance of two series columns, null where they can't be compared."""
    d = get(name)
    unknown = set(params) - set(d.params)
    if unknown:
        raise ValueError(f"{name} has no parameters {sorted(unknown)}")
    if d.column is not None:
        return d.column(a, b)
    given = [k for k in d.params if k in params]

    @F.arrow_udf(T.DoubleType())
    def run(x: pa.Array, y: pa.Array, *rest: pa.Array) -> pa.Array:
        return pa.array(evaluate(d, x, y, {k: r.to_numpy(zero_copy_only=False) for k, r in zip(given, rest, strict=True)}), from_pandas=True)

    return run(a, b, *[F.lit(params[k]).cast("double") if isinstance(params[k], (int, float)) else params[k].cast("double") for k in given])


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())])))
def alignment_path(a: pa.Array, b: pa.Array) -> pa.Array:
    """Alignment of two series on their DTW path; null where they can't be compared."""
    x, y = Channels(lists(a, 1), False), Channels(lists(b, 1), False)
    rows = np.flatnonzero(x.whole() & y.whole())
    la, lb = x.size[rows, 0], y.size[rows, 0]
    steps, parts = np.zeros(len(x.counts), np.int64), []
    for part in _batches(la * lb, lb, 1, False):  # the table of a batch holds all its cells
        for at in range(0, len(part), 512):
            own = part[at : at + 512]
            m = rows[own]
            _, n, i, j = K.dtw_paths(x.dense(m, 1, int(la[own].max()), 0, 0.0), y.dense(m, 1, int(lb[own].max()), 0, 0.0), la[own], lb[own])
            steps[m] = n
            back = n[:, None] - 1 - np.arange(i.shape[1])[None]  # from the start on
            kept = back >= 0
            parts.append((np.repeat(m, n), *(np.take_along_axis(v, np.maximum(back, 0), 1)[kept] for v in (i, j))))
    row, i, j = (np.concatenate(v) for v in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 3
    order = np.argsort(row, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(steps)]).astype(np.int32)
    fields = pa.StructArray.from_arrays([pa.array(v[order].astype(np.int32)) for v in (i, j)], names=["i", "j"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(steps == 0, False)), fields)


def masked(a: Column, b: Column, expression: Callable[[Column, Column], Column]) -> Column:
    """A column distance over the positions observed in both series; infinite if there are none."""
    both = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda z: z["x"].isNotNull() & z["y"].isNotNull())
    x, y = F.transform(both, lambda z: z["x"]), F.transform(both, lambda z: z["y"])
    return F.when(F.size(both) > 0, expression(x, y)).otherwise(F.lit(float("inf")))
