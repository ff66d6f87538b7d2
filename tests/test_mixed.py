from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpwood.functions import distances as D
from kelpwood.functions import mixed
from kelpwood.operators import forest as FO
from kelpwood.operators import impute
from kelpwood.sources.delimited import tagged


def frame(spark, rows):
    raw = spark.createDataFrame([(i, label, tokens) for i, (label, tokens) in enumerate(rows)], "idx long, label string, tokens array<string>")
    return raw.select("idx", "label", F.transform("tokens", tagged).alias("series"))


def test_distance(spark):
    rows = frame(spark, [("a", ["1", "true", "red"]), ("a", ["3", "true", "blue"]), ("b", ["x", "false", "red"])])
    got = {r["idx"]: r["series"] for r in mixed.encoded(rows).collect()}
    pair = lambda i, j: D.evaluate("mixed", [got[i]], [got[j]])[0]
    assert pair(0, 0) == 0 and np.isclose(pair(0, 1), (1 + 0 + 1) / 3) and np.isclose(pair(0, 2), 2 / 3)


def test_forest_refuses_mixed_entries_and_takes_encoded_ones(spark):
    random = np.random.default_rng(3)
    rows = frame(spark, [("ab"[k % 2], [f"{random.normal(3 * (k % 2)):.2f}", "true" if k % 2 else "false", random.choice(["red", "blue"])]) for k in range(40)])
    cfg = FO.ForestConfig(n_trees=3, n_candidates=2, distances=("mixed",))
    with pytest.raises(ValueError, match="numbers"):
        FO.fit(rows, cfg)
    ready = mixed.encoded(rows)
    predicted = {r["idx"]: r["prediction"] for r in FO.fit(ready, cfg).transform(ready).collect()}
    assert sum(p == "ab"[i % 2] for i, p in predicted.items()) >= 38


def test_modes_and_the_iteration(spark):
    random = np.random.default_rng(5)
    rows, gaps = [], set()
    for k in range(60):
        own = [f"{random.normal(5 * (k % 2), 0.3):.2f}", "true" if k % 2 else "false", "red" if k % 2 else "blue", None]
        if k % 6 == 0 or k % 6 == 5:
            own[2] = None
            gaps.add(k)
        rows.append(("ab"[k % 2], own))
    data = frame(spark, rows + [("b", ["5.0", "true", "red", None])])
    first = {r["idx"]: r["series"] for r in impute.mixed_mode(data).collect()}
    assert {first[k][2]["str"] for k in gaps} == {"red"} and first[0][3] is None
    test = data.filter("idx >= 50")
    _, train, other = impute.forest_impute_mixed(data.filter("idx < 50"), FO.ForestConfig(n_trees=5, n_candidates=2, impute_iterations=2), test)
    got = {r["idx"]: r["series"] for r in train.unionByName(other).collect()}
    assert len(got) == 61 and all(got[k][2]["str"] == ("red" if k % 2 else "blue") for k in gaps)
    assert got[1][0]["num"] is not None and got[0][3]["str"] == ""
