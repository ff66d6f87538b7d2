"""One call from files to results: train a forest (and test it), or score with a saved one.

The keywords are those that users of command-line distance forests know; ``python -m kelpwood.launcher
train|predict --key value`` takes the same. Results are written below ``output_directory`` as parquet
tables (predictions, proximities, outlier scores) and text (imputed series), and returned as a dict, with the
seconds that training, prediction and proximities took; verbosity 1 prints these, 2 the progress of training.
Keywords that only steer one machine's threads or memory are accepted and have no effect.
"""

from __future__ import annotations

import argparse
import ast
import inspect
import logging
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpwood.functions import distances as D
from kelpwood.functions import mixed
from kelpwood.operators import forest as FO
from kelpwood.operators import impute, proximity
from kelpwood.operators import purity as P
from kelpwood.session import checkpointed
from kelpwood.sources import delimited as S

MISSING = ("", "NA", "NaN", "null", "nan", "NAN")


def _read(spark: SparkSession, path: str, labels: str | None, data_dimension: int, numeric_data: bool, entry_separator: str, array_separator: str, file_has_header: bool, target_column: str, missing: tuple[str, ...], gaps: bool) -> DataFrame:
    if data_dimension not in (1, 2):
        raise ValueError("data_dimension is 1 or 2")
    inline = "none" if labels or data_dimension == 2 else target_column
    layout = S.Layout(entry_separator, array_separator, missing if gaps else (), data_dimension == 2, numeric_data, None, None, inline, file_has_header)
    rows, failed = S.read_delimited(spark, path, layout, labels)
    bad = failed.limit(1).collect()
    if bad:
        raise ValueError(f"{path}: line {bad[0]['idx']} fails to parse: {bad[0]['reason']}")
    return rows


def _predictions(model: FO.ForestModel, rows: DataFrame) -> tuple[DataFrame, dict]:
    predicted = model.transform(rows).join(rows.select("idx", "label"), "idx")
    if model.config.task == "regression":
        predicted = predicted.withColumn("label", F.col("label").try_cast("double"))
        return predicted, P.r_squared(predicted).first().asDict()
    return predicted, P.accuracy(predicted).first().asDict()


def _filled(train: DataFrame, other: DataFrame) -> DataFrame:
    """Training and other mixed rows (``own`` or not) with missing entries as modes."""
    both = train.select("idx", "label", "series", F.lit(True).alias("own")).unionByName(other.select("idx", "label", "series", F.lit(False).alias("own")))
    # the two files number their rows alike
    return impute.mixed_mode(both.withColumn("idx", F.when(F.col("own"), -1 - F.col("idx")).otherwise(F.col("idx"))))


def _scaled(train: DataFrame, other: DataFrame) -> DataFrame:
    """Other mixed rows, encoded in the deviations of training and other rows together."""
    return mixed.encoded(_filled(train, other)).filter("not own").drop("own")


def train(
    spark: SparkSession, train_file: str, test_file: str | None = None, train_labels: str | None = None, test_labels: str | None = None, exists_testlabels: bool = False,
    return_predictions: bool = False, return_proximities: bool = False, save_model: bool = True, model_name: str = "PF", output_directory: str = "", repeats: int = 1,
    num_trees: int = 11, r: int = 5, on_tree: bool = True, max_depth: int = 0, shuffle: bool = False, export: int = 1, verbosity: int = 1, file_has_header: bool = False,
    target_column: str = "first", distances: list[str] | None = None, memory: str = "", parallel_trees: bool = False, parallel_predict: bool = False, parallel_prox: bool = False,
    impute_training_data: bool = False, impute_testing_data: bool = False, impute_iterations: int = 5, return_imputed_training: bool = False, return_imputed_testing: bool = False,
    knn_distances: list[str] | None = None, data_dimension: int = 1, numeric_data: bool = True, entry_separator: str = ",", array_separator: str = ":",
    return_training_outlier_scores: bool = False, initial_imputer: str = "mean", regressor: bool = False, purity: str = "gini", purity_threshold: float = 1e-6,
    regressor_aggregation: str = "mean", DTWImpute: bool = False, missing_indicators: tuple[str, ...] = MISSING, seed: int = 0,  # noqa: N803
) -> dict:
    """Train on files; on_tree: a new measure for every candidate, else one a tree."""
    del exists_testlabels, shuffle, export, memory, parallel_trees, parallel_predict, parallel_prox
    if verbosity > 1:
        logging.basicConfig()
        FO.LOG.setLevel(logging.INFO)  # every level of the trees
    read = lambda path, labels, gaps: _read(spark, path, labels, data_dimension, numeric_data, entry_separator, array_separator, file_has_header, target_column, tuple(missing_indicators), gaps)
    rows = read(train_file, train_labels, impute_training_data)
    other = read(test_file, test_labels, impute_testing_data or impute_training_data) if test_file else None
    if not numeric_data and data_dimension == 2:
        raise ValueError("mixed entries are read in two dimensions, but there is no distance of them")
    pool = tuple(distances or ("mixed",) if not numeric_data else distances or (D.DEFAULT_POOL if data_dimension == 1 else ("dtw_i", "dtw_d")))
    cfg = FO.ForestConfig("regression" if regressor else "classification", num_trees, r, pool, "node" if on_tree else "tree", purity, purity_threshold, max_depth, regressor_aggregation, seed, initial_imputer, impute_iterations, "dtw" if DTWImpute else "position", tuple(knn_distances or ("euclidean",)), tuple(missing_indicators), repeats)
    out: dict = {}
    for n in range(repeats):
        own, base = replace(cfg, seed=seed + n), output_directory + (f"/repeat={n}" if repeats > 1 else "")
        began = time.monotonic()
        if impute_training_data:
            model, filled, filled_other = (impute.forest_impute if numeric_data else impute.forest_impute_mixed)(rows, own, other)
        else:
            model, filled, filled_other = FO.fit(rows if numeric_data else mixed.encoded(rows), own), rows, other
        out = {"model": model, "config": own, "seconds": {"train": time.monotonic() - began}}
        if save_model:
            model.save(f"{base}/{model_name}")
            rows.write.mode("overwrite").parquet(f"{base}/{model_name}/original")
        if return_imputed_training:
            S.write_series(filled.select("idx", "series"), f"{base}/imputed_training", data_dimension == 2, entry_separator, array_separator)
        if filled_other is not None:
            ready = filled_other if numeric_data else _scaled(filled, filled_other)
            began = time.monotonic()
            predicted, out["metrics"] = _predictions(model, ready)
            out["seconds"]["predict"] = time.monotonic() - began
            out["predictions"] = predicted
            if return_predictions:
                S.write_table(predicted, f"{base}/predictions")
            if return_imputed_testing:
                S.write_series(filled_other.select("idx", "series"), f"{base}/imputed_testing", data_dimension == 2, entry_separator, array_separator)
        if return_proximities or return_training_outlier_scores:
            began = time.monotonic()
            prox = out["training_proximities"] = checkpointed(proximity.train_proximities(model))
            out["seconds"]["proximities"] = time.monotonic() - began
            if return_proximities:
                S.write_table(prox, f"{base}/training_proximities")
                if filled_other is not None:
                    out["test_proximities"] = proximity.test_proximities(model, ready)
                    S.write_table(out["test_proximities"], f"{base}/test_proximities")
            if return_training_outlier_scores:
                out["outlier_scores"] = proximity.outlier_scores(prox, model.train)
                S.write_table(out["outlier_scores"], f"{base}/outlier_scores")
        if verbosity > 0:
            print(", ".join(f"{k}: {v:.1f} s" for k, v in out["seconds"].items()))
    return out


def predict(
    spark: SparkSession, model_name: str, testfile: str, test_labels: str | None = None, exists_testlabels: bool = False, return_predictions: bool = False, return_proximities: bool = False,
    output_directory: str = "", shuffle: bool = False, export: int = 1, verbosity: int = 1, file_has_header: bool = False, target_column: str = "first", parallel_trees: bool = False,
    parallel_prox: bool = False, parallel_predict: bool = False, memory: str = "", data_dimension: int = 1, numeric_data: bool = True, entry_separator: str = ",", array_separator: str = ":",
    impute_testing_data: bool = False, impute_iterations: int = 5, return_imputed_testing: bool = False, initial_imputer: str = "mean", DTWImpute: bool = False,  # noqa: N803
    knn_distances: list[str] | None = None, distances: list[str] | None = None, missing_indicators: tuple[str, ...] = MISSING,
) -> dict:
    """Score a file with the forest saved at output_directory/model_name."""
    del exists_testlabels, shuffle, export, verbosity, memory, parallel_trees, parallel_predict, parallel_prox, distances
    path = f"{output_directory}/{model_name}"
    model = FO.ForestModel.load(spark, path)
    rows = _read(spark, testfile, test_labels, data_dimension, numeric_data, entry_separator, array_separator, file_has_header, target_column, tuple(missing_indicators), impute_testing_data)
    filled = rows
    if not numeric_data:
        original = spark.read.parquet(f"{path}/original")
        shown = _filled(original, rows).filter("not own").drop("own")
        for _ in range(impute_iterations if impute_testing_data else 0):
            shown = checkpointed(impute.mixed_update(shown, rows, proximity.test_proximities(model, _scaled(original, shown)), original))
        filled = _scaled(original, shown)
    elif impute_testing_data:
        cfg = replace(model.config, initial_imputer=initial_imputer, alignment="dtw" if DTWImpute else "position", knn_distances=tuple(knn_distances or ("euclidean",)))
        filled, original = impute.IMPUTERS[initial_imputer](rows), spark.read.parquet(f"{path}/original")
        for _ in range(impute_iterations):
            filled = impute.refine_others(model, filled, rows, original, model.train, cfg)
    out: dict = {"model": model}
    out["predictions"], out["metrics"] = _predictions(model, filled)
    if return_predictions:
        S.write_table(out["predictions"], f"{output_directory}/predictions_saved")
    if return_imputed_testing:
        S.write_series((filled if numeric_data else shown).select("idx", "series"), f"{output_directory}/imputed_testing", data_dimension == 2, entry_separator, array_separator)
    if return_proximities:
        out["test_proximities"] = proximity.test_proximities(model, filled)
        S.write_table(out["test_proximities"], f"{output_directory}/test_proximities")
    return out


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="kelpwood.launcher")
    commands = parser.add_subparsers(dest="command", required=True)
    for fn in (train, predict):
        sub = commands.add_parser(fn.__name__)
        for name, p in list(inspect.signature(fn).parameters.items())[1:]:
            sub.add_argument(f"--{name}", required=p.default is p.empty, default=None)

    given = vars(parser.parse_args(args))
    fn = {"train": train, "predict": predict}[given.pop("command")]
    kinds = {n: p.default for n, p in inspect.signature(fn).parameters.items()}
    value = lambda n, v: v if isinstance(kinds[n], str) or kinds[n] is inspect.Parameter.empty or (kinds[n] is None and not v.startswith("[")) else ast.literal_eval(v)
    spark = SparkSession.builder.appName("kelpwood").getOrCreate()
    print(fn(spark, **{n: value(n, v) for n, v in given.items() if v is not None}).get("metrics"))


if __name__ == "__main__":
    main()
