"""Distances by a model's predictions: predict once per row, then compare two plain columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpwood.functions.series import cosine_distance


def with_predictions(rows: DataFrame, predict: Callable[[pd.Series], pd.Series], kind: str, name: str = "predicted") -> DataFrame:
    """rows with a model's prediction for each series; the model sees Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{name: predict(frame["series"])})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, `{name}` {kind}")


def with_file_predictions(rows: DataFrame, predictions: DataFrame, value: str, name: str = "predicted") -> DataFrame:
    """rows with predictions given by idx; a row without one has null."""
    return rows.join(predictions.dropDuplicates(["idx"]).select("idx", F.col(value).alias(name)), "idx", "left")


def class_mismatch(a: Column, b: Column) -> Column:
    """1 if the predicted classes differ, else 0; null if either is unknown."""
    return (a != b).cast("double")


def probability_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two arrays of class probabilities."""
    return cosine_distance(a, b)


def regression_distance(a: Column, b: Column) -> Column:
    return F.abs(a - b)
