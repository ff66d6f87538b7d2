from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpwood.functions import distances as D
from kelpwood.operators import forest as FO
from kelpwood.operators import impute, proximity
from kelpwood.operators import purity as P


@pytest.fixture(scope="module")
def rows(spark):
    random = np.random.default_rng(0)
    data = [(i, [float(v) for v in random.normal(3.0 * (i % 3), 0.5, 6)], "abc"[i % 3]) for i in range(45)]
    data += [(100, [3.0, None, 3.0, 3.0, 3.0, 3.0], None), (101, None, "a"), (None, [1.0] * 6, "a")]
    return spark.createDataFrame(data, "idx long, series array<double>, label string")


@pytest.fixture(scope="module")
def model(rows):
    return FO.fit(rows, FO.ForestConfig(n_trees=3, n_candidates=2, distances=("euclidean", "dtw"), seed=5))


def test_forest(spark, rows, model, tmp_path):
    m = model.membership.toPandas()
    assert (m.groupby("tree")["mult"].sum() == 45).all() and (m.groupby("tree").size() == 45).all() and (m["oob"] == (m["mult"] == 0)).all()
    predicted = model.transform(rows.filter("label is not null and series is not null"))
    score = P.accuracy(predicted.join(rows.select("idx", "label"), "idx")).first()
    assert score["accuracy"] > 0.9 and np.isclose(score["accuracy"] + score["error_rate"], 1)
    routed = model.route(rows.filter("label is not null")).alias("r").join(model.membership.alias("m"), ["tree", "idx"]).filter("r.node <> m.node").count()
    assert routed == 0  # a training row is routed to the leaf it was trained into
    model.save(str(tmp_path / "m"))
    again = FO.ForestModel.load(spark, str(tmp_path / "m"))
    assert again.config == model.config and again.transform(rows).exceptAll(model.transform(rows)).count() == 0
    other = FO.fit(rows.repartition(3), model.config)
    assert other.nodes.exceptAll(model.nodes).count() == 0  # partitioning doesn't matter
    stats = model.tree_stats().collect()
    assert all(r["n_nodes"] == r["n_leaves"] + r["n_inner"] for r in stats)


def test_proximities(rows, model):
    prox = proximity.train_proximities(model)
    p = prox.toPandas()
    assert np.allclose(p.groupby("i")["prox"].sum(), 1) and (p["i"] != p["j"]).all()
    bag, out = model.membership.filter("not oob").toPandas(), model.membership.filter("oob").toPandas()
    i = int(out["idx"].iloc[0])
    want: dict = {}
    own = out[out["idx"] == i]
    for t, node in zip(own["tree"], own["node"], strict=True):
        leaf = bag[(bag["tree"] == t) & (bag["node"] == node)]
        for j, c in zip(leaf["idx"], leaf["mult"], strict=True):
            want[j] = want.get(j, 0) + c / leaf["mult"].sum() / len(own)
    got = dict(p[p["i"] == i][["j", "prox"]].itertuples(index=False, name=None))
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)
    grid = proximity.dense(prox, rows.filter("idx < 45"), rows.filter("idx < 45"))
    assert grid.count() == 45 and len(grid.first()["prox"]) == 45
    sym = proximity.symmetric(prox)
    assert sym.alias("a").join(sym.alias("b"), (F.col("a.i") == F.col("b.j")) & (F.col("a.j") == F.col("b.i"))).filter("abs(a.prox - b.prox) > 1e-12").count() == 0
    assert proximity.outlier_scores(prox, rows).count() == 46


def test_regression_and_limits(spark, rows):
    reg = rows.filter("series is not null").withColumn("label", F.get("series", F.lit(0)))
    model = FO.fit(reg, FO.ForestConfig(task="regression", purity="mad", regression_agg="median", n_trees=2, n_candidates=2, distances=("manhattan",), max_depth=2))
    assert P.r_squared(model.transform(reg).join(reg, "idx")).first()["r2"] > 0.5 and model.nodes.agg(F.max("depth")).first()[0] <= 2
    one = FO.fit(rows.filter("label = 'a'"), FO.ForestConfig(n_trees=1))
    assert one.nodes.count() == 1 and one.nodes.first()["is_leaf"]
    none = FO.fit(rows.limit(0), FO.ForestConfig(n_trees=1))
    assert none.nodes.count() == 0 and none.transform(rows).count() == 0


def test_own_distance_and_impute(rows):
    D.register_distance("first_entry", lambda x, y: abs(x[0] - y[0]))
    gaps = rows.filter("series is not null and idx < 30").withColumn("series", F.transform("series", lambda v, i: F.when((F.col("idx") % 7 != 0) | (i != 2), v)))
    cfg = FO.ForestConfig(n_trees=2, n_candidates=1, distances=("first_entry",), impute_iterations=1, max_depth=3)
    _, filled, test = impute.forest_impute(gaps, cfg, gaps.filter("idx < 10"))
    got = {r["idx"]: r["series"] for r in filled.collect()}
    assert all(None not in s for s in got.values()) and test.count() == 10
    for r in gaps.collect():
        assert all(v is None or v == got[r["idx"]][k] for k, v in enumerate(r["series"]))  # observed values stay


def test_imputers_edge_cases(spark):
    frame = spark.createDataFrame([(1, [None, 1.0, None, 3.0, 3.0, None]), (2, [None, None]), (3, [])], "idx long, series array<double>")
    got = {n: {r["idx"]: r["series"] for r in impute.IMPUTERS[n](frame).collect()} for n in ("mean", "median", "mode", "linear", "global_mean", "knn")}
    assert got["linear"][1] == [1.0, 1.0, 2.0, 3.0, 3.0, 3.0] and got["median"][1][0] == 3.0 and got["mode"][1][0] == 3.0 and got["mode"][2] == [None, None]
    assert got["mean"][2] == got["linear"][2] == [0.0, 0.0] and got["global_mean"][2] == [0.0, 1.0] and got["knn"][1][0] == 0.0 and all(v[3] == [] for v in got.values())


def test_nearest_exemplars_by_giving_up_far_pairs():
    random = np.random.default_rng(3)
    rows, shapes = np.cumsum(random.normal(size=(30, 12)), axis=1), np.cumsum(random.normal(size=(7, 12)), axis=1)
    shapes[4] = shapes[2]  # a tie
    own, at = np.repeat(np.arange(30), 7), np.tile(np.arange(7), 30)
    params = {"w": 3.0, "g": 0.3, "c": 0.1, "nu": 0.001, "lam": 0.1, "epsilon": 0.5, "delta": 3.0}
    given_up = 0
    for name in D.DEFAULT_POOL:
        d = D.get(name)
        used = {p: np.full(len(own), params[p]) for p in d.params}
        whole = D.evaluate(d, [list(rows[i]) for i in own], [list(shapes[j]) for j in at], used).reshape(30, 7)
        got = FO._to_exemplars(d, rows, shapes, own, at, used).reshape(30, 7)
        near = whole == whole.min(1, keepdims=True)
        assert (got[near] == whole[near]).all() and (got[~near] > np.broadcast_to(whole.min(1, keepdims=True), whole.shape)[~near]).all(), name
        given_up += (np.isinf(got) & np.isfinite(whole)).sum()
    assert given_up > 0


def test_rows_out_of_the_bag_only_meet_the_chosen_exemplars(rows):
    met = rows.sparkSession.sparkContext.accumulator(0)

    def counted(x, y):
        met.add(1)
        return float(abs(x[0] - y[0]))

    D.register_distance("counted", counted)
    model = FO.fit(rows, FO.ForestConfig(n_trees=2, n_candidates=4, distances=("counted",), max_depth=1, seed=5))
    m = model.membership.toPandas()
    # three exemplars a candidate: four candidates for the rows in the bag, one for the others
    assert met.value == 3 * (4 * (~m["oob"]).sum() + m["oob"].sum())


def test_outlier_scores_without_pairs(rows, model, monkeypatch):
    want = {r["idx"]: r for r in proximity.outlier_scores(proximity.train_proximities(model), rows).collect()}

    def same(scores):
        got = {r["idx"]: r for r in scores.collect()}
        assert got.keys() == want.keys()
        for idx, r in got.items():
            assert r["label"] == want[idx]["label"] and np.isclose(r["raw"], want[idx]["raw"], rtol=1e-12)
            assert np.isclose(r["score"], want[idx]["score"], rtol=1e-9)

    with monkeypatch.context() as m:
        m.setattr(proximity, "SURE", 30)  # rows in leaves of 10 and more over three trees go by pairs
        same(proximity.forest_outlier_scores(model, rows))
        m.setattr(proximity, "SURE", 0)
        same(proximity.forest_outlier_scores(model, rows))
    monkeypatch.setattr(proximity, "_proximities", None)  # no table of pairs else
    same(proximity.forest_outlier_scores(model, rows))


def test_update_without_pairs(rows, model, monkeypatch):
    gaps = rows.filter("series is not null and idx is not null").withColumn("series", F.transform("series", lambda v, i: F.when((F.col("idx") + i) % 4 != 0, v)))
    train, other = gaps.filter("idx < 45"), gaps.filter("idx % 3 = 0").withColumn("idx", F.col("idx") + 1000)
    filled, filled_other = impute.IMPUTERS["mean"](train), impute.IMPUTERS["mean"](other)
    values = lambda found: {r["idx"]: r["series"] for r in found.collect()}
    want = values(impute.proximity_update(filled, train, proximity.train_proximities(model)))
    want_other = values(impute.proximity_update(filled_other, other, proximity.test_proximities(model, filled_other), train))

    def same():
        got, got_other = (values(f) for f in (impute.refine(model, filled, train, model.config), impute.refine_others(model, filled_other, other, train, filled, model.config)))
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)
        assert got_other.keys() == want_other.keys() and all(np.allclose(got_other[k], want_other[k], rtol=1e-12) for k in want_other)

    with monkeypatch.context() as m:
        m.setattr(proximity, "SURE", 30)  # some rows by pairs
        same()
    monkeypatch.setattr(proximity, "_proximities", None)  # no table of pairs else
    same()
