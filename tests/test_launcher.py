from __future__ import annotations

import numpy as np

from kelpwood import launcher


def test_train_and_predict(spark, tmp_path):
    random = np.random.default_rng(2)
    line = lambda k, gap: f"{'ab'[k % 2]}," + ",".join("NA" if gap and t == 3 else f"{v:.3f}" for t, v in enumerate(random.normal(4 * (k % 2), 0.3, 6)))
    (tmp_path / "train.csv").write_text("\n".join(line(k, k % 5 == 0) for k in range(20)))
    (tmp_path / "test.csv").write_text("\n".join(line(k, k % 4 == 0) for k in range(8)))
    out = str(tmp_path / "out")
    got = launcher.train(spark, str(tmp_path / "train.csv"), str(tmp_path / "test.csv"), output_directory=out, num_trees=2, r=1, distances=["euclidean"], impute_training_data=True, impute_iterations=1, return_predictions=True, return_proximities=True, return_training_outlier_scores=True, return_imputed_training=True, return_imputed_testing=True)
    assert got["metrics"]["accuracy"] == 1 and spark.read.parquet(f"{out}/predictions").count() == 8
    assert set(got["seconds"]) == {"train", "predict", "proximities"} and got["seconds"]["train"] > 0
    assert "NA" not in "".join(r["value"] for r in spark.read.text(f"{out}/imputed_training").collect()) and spark.read.parquet(f"{out}/outlier_scores").count() == 20
    again = launcher.predict(spark, "PF", str(tmp_path / "test.csv"), output_directory=out, impute_testing_data=True, impute_iterations=1, DTWImpute=True, return_predictions=True)
    assert again["metrics"]["accuracy"] == 1


def test_two_dimensions(spark, tmp_path):
    rows = ["5.2,5.1,5.3,5.0,5.2:7.1,,7.3,7.0,7.2", "3.1,3.0,3.2,3.1:9.5,9.4,9.6,9.1", "5.1,5.0,5.2,5.3,5.1:7.2,7.1,,7.3,7.0", "3.0,3.3,3.1,3.2:9.3,9.6,9.2,9.4", "3.2,3.1,3.0,3.3:,9.2,9.5,9.3"]
    (tmp_path / "d.txt").write_text("\n".join(rows) + "\n")
    (tmp_path / "l.txt").write_text("wide\ntall\nwide\ntall\ntall\n")
    got = launcher.train(spark, str(tmp_path / "d.txt"), train_labels=str(tmp_path / "l.txt"), data_dimension=2, output_directory=str(tmp_path / "o"), num_trees=2, r=1, distances=["dtw_i"], impute_training_data=True, impute_iterations=1, DTWImpute=True)
    series = {r["idx"]: r["series"] for r in got["model"].train.collect()}
    assert series[0][0] == [5.2, 5.1, 5.3, 5.0, 5.2] and series[0][1][1] is not None and len(series[1][0]) == 4


def test_mixed_entries(spark, tmp_path):
    random = np.random.default_rng(4)
    line = lambda k, gap: f"{'ab'[k % 2]},{random.normal(4 * (k % 2), 0.3):.2f},{random.normal(9 - 4 * (k % 2), 0.3):.2f},{'?' if gap else ['blue', 'red'][k % 2]},{'true' if k % 3 else 'false'}"
    (tmp_path / "train.csv").write_text("\n".join(line(k, k % 7 == 0) for k in range(30)))
    (tmp_path / "test.csv").write_text("\n".join(line(k, k % 4 == 0) for k in range(12)))
    options = dict(output_directory=str(tmp_path / "out"), numeric_data=False, missing_indicators=("?",))
    got = launcher.train(spark, str(tmp_path / "train.csv"), str(tmp_path / "test.csv"), num_trees=9, r=2, impute_training_data=True, impute_iterations=1, return_imputed_training=True, return_imputed_testing=True, **options)
    assert got["metrics"]["accuracy"] == 1
    text = [r["value"] for r in spark.read.text(str(tmp_path / "out" / "imputed_training")).collect()]
    assert len(text) == 30 and not any("?" in x or ",," in x for x in text) and sum(",red," in x for x in text) == 15
    assert launcher.predict(spark, "PF", str(tmp_path / "test.csv"), impute_testing_data=True, impute_iterations=2, **options)["metrics"]["accuracy"] == 1
