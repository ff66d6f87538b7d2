"""Series transforms and plain distances as Column expressions; they stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once a row, also where ``then`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _same(a: Column, b: Column, value: Column) -> Column:
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), value)


def squared_euclidean(a: Column, b: Column) -> Column:
    return _same(a, b, total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _same(a, b, total(F.zip_with(a, b, lambda x, y: F.abs(x - y))))


def cosine_similarity(a: Column, b: Column) -> Column:
    norm = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return _same(a, b, F.when(norm > 0, total(F.zip_with(a, b, lambda x, y: x * y)) / norm).otherwise(F.lit(0.0)))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def difference(x: Column) -> Column:
    """First-order difference, one shorter; empty for fewer than two entries."""
    n = F.size(x)
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(F.zip_with(F.slice(x, 2, F.greatest(n - 1, F.lit(0))), F.slice(x, 1, F.greatest(n - 1, F.lit(0))), lambda p, q: p - q))


def difference_2d(x: Column) -> Column:
    return F.transform(x, difference)


def keogh_derivative(x: Column) -> Column:
    """Keogh's derivative, same length; the ends copy their neighbours (n < 3: the series itself)."""
    n = F.size(x)
    at = lambda i: F.get(x, i)
    inner = lambda i: ((at(i) - at(i - 1)) + (at(i + 1) - at(i - 1)) / 2) / 2
    return F.when(n < 3, x).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: inner(F.least(F.greatest(i, F.lit(1)), n - 2))))


def gradients_histogram(x: Column, bins: Column | None = None) -> Column:
    """Counts of the differences in equal bins; as many bins as the root of the length by default."""
    bins = F.floor(F.sqrt(F.size(x))).cast("int") if bins is None else bins

    def places(steps: Column, k: Column) -> Column:
        span = F.struct(F.array_min(steps).alias("low"), ((F.array_max(steps) - F.array_min(steps)) / k).alias("wide"))
        return let(span, lambda r: F.transform(steps, lambda g: F.when(r["wide"] == 0, F.lit(0)).otherwise(F.least(F.floor((g - r["low"]) / r["wide"]).cast("int"), k - 1))))

    def counts(steps: Column, k: Column) -> Column:
        return let(places(steps, k), lambda at: F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), lambda n: F.size(F.filter(at, lambda p: p == n)).cast("double")))

    none = F.array().cast("array<double>")
    both = F.struct(difference(x).alias("steps"), bins.alias("k"))
    return let(both, lambda r: F.when((F.size(r["steps"]) == 0) | (r["k"] <= 0), none).otherwise(counts(r["steps"], r["k"])))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def first_component(x: pa.Array) -> pa.Array:
    """The channels of a series (of one length) projected on their first principal axis, of which the loading that is
    greatest in size is positive; null where channels differ in length or entries are missing."""
    from kelpwood.functions.arrays import Channels

    s = Channels(x)
    even = s.whole() & ((s.size == s.size[:, :1]) | (np.arange(s.channels) >= s.counts[:, None])).all(1) if s.channels else np.zeros(len(s.counts), bool)
    out: list[np.ndarray | None] = [None] * len(s.counts)
    rows = np.flatnonzero(even)
    for c, n in np.unique(np.column_stack([s.counts[rows], s.size[rows, 0]]), axis=0).tolist() if len(rows) else []:
        own = rows[(s.counts[rows] == c) & (s.size[rows, 0] == n)]
        m = s.dense(own, c, n)
        m = m - m.mean(2, keepdims=True)
        axis = np.linalg.eigh(m @ m.transpose(0, 2, 1))[1][:, :, -1]
        turn = np.sign(np.take_along_axis(axis, np.abs(axis).argmax(1)[:, None], 1))
        for r, v in zip(own.tolist(), np.einsum("rc,rcn->rn", axis * turn, m), strict=True):
            out[r] = v
    return pa.array(out, pa.list_(pa.float64()))


def gradients_histogram_2d(x: Column, strategy: str = "concatenate") -> Column:
    """Histogram of the gradients of all channels: ``concatenate`` counts the differences of all channels
    as one series, ``per_channel`` sets the channels' histograms side by side, ``average`` counts the mean
    difference of the channels (of one length), ``pca`` the differences of the channels' first principal
    component. As many bins as the root of the first channel's length."""
    bins = F.floor(F.sqrt(F.size(F.get(x, F.lit(0))))).cast("int")
    if strategy == "concatenate":
        return let(F.flatten(difference_2d(x)), lambda g: gradients_histogram(g, bins))
    if strategy == "per_channel":
        return F.flatten(F.transform(difference_2d(x), lambda g: gradients_histogram(g, bins)))
    if strategy == "pca":
        return let(difference(first_component(x)), lambda g: gradients_histogram(g, bins))
    if strategy != "average":
        raise ValueError(f"unknown strategy {strategy!r}")
    steps = difference_2d(x)
    places = F.sequence(F.lit(0), F.greatest(F.size(F.get(steps, F.lit(0))), F.lit(1)) - 1)
    mean_step = let(steps, lambda all_: F.transform(places, lambda i: total(F.transform(all_, lambda c: F.get(c, i))) / F.size(all_)))
    return let(mean_step, lambda g: gradients_histogram(g, bins))


def mean(x: Column) -> Column:
    return F.try_divide(total(x), F.size(x))


def z_normalised(x: Column) -> Column:
    """Mean 0 and population deviation 1; a constant series becomes 0."""
    centred = let(mean(x), lambda m: F.transform(x, lambda v: v - m))
    return let(centred, lambda c: let(F.sqrt(F.try_divide(total(F.transform(c, lambda v: v * v)), F.size(c))), lambda sd: F.transform(c, lambda v: F.when(sd > 0, v / sd).otherwise(v))))


def complexity(x: Column) -> Column:
    return F.sqrt(total(F.transform(difference(x), lambda v: v * v)))


def cid_distance(a: Column, b: Column) -> Column:
    parts = F.struct(complexity(a).alias("a"), complexity(b).alias("b"), F.sqrt(squared_euclidean(a, b)).alias("d"))
    ratio = lambda r: F.greatest(r["a"], r["b"]) / F.least(r["a"], r["b"])
    return let(parts, lambda r: F.when(F.least(r["a"], r["b"]) > 0, r["d"] * ratio(r)).when(r["d"] == 0, F.lit(0.0)).otherwise(F.when(r["d"].isNotNull(), F.lit(float("inf")))))


def logistic_weights(n: Column, g: Column) -> Column:
    """Weight of each distance 0..n-1 from the diagonal."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: 1 / (1 + F.exp(-g * (k - n / 2))))


def missing_positions(x: Column) -> Column:
    return F.filter(F.transform(x, lambda v, i: F.when(v.isNull() | F.isnan(v), i)), lambda i: i.isNotNull())


def dense_to_sparse(x: Column, above: float = 1e-6) -> Column:
    """Map of position to value of the entries greater than ``above``."""
    pairs = F.transform(x, lambda v, i: F.struct(i.alias("key"), v.alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"] > above))
