from __future__ import annotations

import numpy as np

from kelpwood.functions.hilbert import hilbert
from kelpwood.llm.neighbours import close_pairs, nearest
from kelpwood.operators.knn import exact_nearest


def test_curve_visits_every_cell_by_steps_of_one():
    cells = np.array([(i, j, k) for i in range(4) for j in range(4) for k in range(4)])
    place = hilbert(cells, 2)
    assert sorted(place) == list(range(64))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_recall_and_copies(spark):
    random = np.random.default_rng(3)
    centres = random.normal(size=(40, 8)) * 4
    x = np.concatenate([centres[random.integers(0, 40, 900)] + random.normal(size=(900, 8)) * 0.2, np.repeat(centres[:1], 300, 0)])
    rows = [(i, [float(v) for v in r], i, "clash") for i, r in enumerate(x)]
    rows += [(5000, None, 0, ""), (5001, [1.0] * 7, 0, ""), (5002, [None] + [1.0] * 7, 0, ""), (5003, [float("nan")] * 8, 0, ""), (None, [1.0] * 8, 0, ""), rows[3]]
    frame = spark.createDataFrame(rows, "idx long, series array<double>, id long, place string")
    found = nearest(frame, "idx", "series", dim=8, window=40).toPandas()
    assert (found.groupby("idx").size() == 5).all() and found["idx"].nunique() == 1200
    exact = exact_nearest(frame.filter("idx % 10 = 0 and idx < 1200"), frame.filter("idx < 1200").dropDuplicates(["idx"])).toPandas()
    pairs = lambda f: set(zip(f["idx"], f["neighbour"], strict=True))
    assert len(pairs(exact) & pairs(found)) / len(exact) > 0.98
    crowd = found[(found["idx"] >= 1190)].sort_values(["idx", "place"])
    assert (crowd["distance"] == 0).all() and list(crowd[crowd["idx"] == 1199]["neighbour"]) == [900, 901, 902, 903, 904]
    near = close_pairs(spark.createDataFrame(found), 0.1).toPandas()
    assert (near["idx_a"] < near["idx_b"]).all() and (near["distance"] <= 0.1).all()


def test_few_rows(spark):
    frame = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 3.0])], "idx long, series array<double>")
    assert sorted((r["idx"], r["neighbour"], r["distance"]) for r in nearest(frame, "idx", "series", dim=2).collect()) == [(1, 2, 2.0), (2, 1, 2.0)]
    assert nearest(frame.limit(1), "idx", "series", dim=2).count() == 0
    assert nearest(frame.limit(0), "idx", "series", dim=2).count() == 0
