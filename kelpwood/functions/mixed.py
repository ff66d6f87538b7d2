"""Instances of mixed entries: numbers, true/false and texts, each entry a struct (num, bool, str), null if missing.

``encoded`` turns them into two channels of numbers, which the distance ``mixed`` compares: the numbers, in
deviations of their position over all rows, and a code of everything else. Two numbers differ by the square
of their difference, at most 1, other entries by 0 or 1, entries of different kinds by 1; the distance is
the mean over the positions. Instances of different lengths have none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpwood.functions import distances as D


def code(entry: Column) -> Column:
    """A number that stands for a true/false or text entry; 0 for a number."""
    text = F.concat(F.when(entry["bool"].isNotNull(), F.lit("b")).otherwise(F.lit("s")), F.coalesce(entry["bool"].cast("string"), entry["str"], F.lit("")))
    return F.when(entry["num"].isNotNull(), 0.0).otherwise((F.pmod(F.xxhash64(text), F.lit((1 << 52) - 1)) + 1).cast("double"))


def encoded(rows: DataFrame) -> DataFrame:
    """rows (idx, series, ..) with ``series`` of two channels; missing entries must be filled before."""
    at = rows.select(F.posexplode("series").alias("pos", "e")).select("pos", F.col("e.num").alias("v")).filter("v is not null")
    spread = at.groupBy("pos").agg(F.stddev_pop("v").alias("s")).agg(F.map_from_entries(F.collect_list(F.struct("pos", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s")))).alias("__spread"))  # one entry a position
    numbers = F.transform("series", lambda e, i: F.coalesce(e["num"] / F.coalesce(F.element_at("__spread", i), F.lit(1.0)), F.lit(0.0)))
    return rows.crossJoin(F.broadcast(spread)).withColumn("series", F.array(numbers, F.transform("series", code))).drop("__spread")


def _mixed(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, _: dict) -> np.ndarray:
    if a.shape != b.shape or a.shape[1] != 2:
        return np.full(len(a), np.nan)
    numbers = (a[:, 1] == 0) & (b[:, 1] == 0)
    return np.where(numbers, np.minimum((a[:, 0] - b[:, 0]) ** 2, 1), a[:, 1] != b[:, 1]).mean(1)


D.register(D.Distance("mixed", _mixed, (), True, exact=True))
