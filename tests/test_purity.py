from __future__ import annotations

import statistics

import numpy as np

from kelpwood.operators import purity as P
from kelpwood.session import broadcast_if_small


def test_medians(spark):
    random = np.random.default_rng(2)
    rows = [("hot", float(v)) for v in random.integers(0, 40, 3000)] + [("a", 1.0), ("b", 2.0), ("b", 5.0), (None, 3.0), (None, None), ("none", None)]
    rows += [("x", float(v)) for v in random.normal(size=501)]
    got = {r["k"]: r["median"] for r in P.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    want = {k: statistics.median(v for q, v in rows if q == k and v is not None) for k in ("hot", "a", "b", None, "x")}
    assert got == want
    assert P.medians(spark.createDataFrame([], "k string, v double"), ["k"], "v").count() == 0


def test_broadcasts_are_bounded_by_bytes(spark):
    wide = spark.range(10).selectExpr("id", "sequence(1L, 1000L) as x", "repeat('a', 1000) as t")
    hinted = lambda df: "UnresolvedHint (strategy=broadcast)" in df._jdf.queryExecution().toString() or "ResolvedHint (strategy=broadcast)" in df._jdf.queryExecution().toString()
    assert hinted(broadcast_if_small(wide, 10)) and not hinted(broadcast_if_small(wide, 9)) and not hinted(broadcast_if_small(wide, 10, 30_000))
