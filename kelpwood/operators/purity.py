"""Purities of groups of labels, weighted purity of splits, and other small statistics, as aggregates.

Class purities take counts per class, so that they cost one pre-aggregated shuffle; empty groups have
Gini 1 and entropy 0, groups without numbers have null variance and mean deviation 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpwood.session import stored


def class_counts(rows: DataFrame, keys: list[str], label: str = "label", weight: Column | None = None) -> DataFrame:
    return rows.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.sum(F.lit(1) if weight is None else weight).alias("n"))


def class_purity(counts: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """(keys..., n, purity) of counts per class."""
    total = F.sum("n").over(Window.partitionBy(*keys))
    p = F.col("n") / total
    if kind == "gini":
        value = 1 - F.sum(F.col("p") * F.col("p"))
    elif kind == "entropy":
        value = -F.sum(F.col("p") * F.log2("p"))
    else:
        raise ValueError(f"{kind} is no purity of classes")
    return counts.withColumn("p", p).groupBy(*keys).agg(F.sum("n").alias("n"), value.alias("purity"))


def numeric_purity(rows: DataFrame, keys: list[str], label: str, kind: str, weight: Column | None = None) -> DataFrame:
    """(keys..., n, purity): population variance or mean absolute deviation of numeric labels."""
    w = F.lit(1) if weight is None else weight
    rows = rows.filter(F.col(label).isNotNull()).withColumn("__w", w)
    mean = rows.groupBy(*keys).agg(F.sum("__w").alias("n"), (F.sum(F.col("__w") * F.col(label)) / F.sum("__w")).alias("mean"))
    off = rows.join(mean, keys)
    gap = F.col(label) - F.col("mean")
    value = {"variance": gap * gap, "mad": F.abs(gap)}[kind]
    return off.groupBy(*keys).agg(F.first("n").alias("n"), (F.sum(F.col("__w") * value) / F.sum("__w")).alias("purity"))


def weighted_purity(children: DataFrame, parent: list[str], branches: int | None = None) -> DataFrame:
    """Sum over the children of n_child / n_parent * purity; children have n and purity."""
    total = children.groupBy(*parent).agg(F.sum("n").alias("__n"), F.sum(F.col("n") * F.col("purity")).alias("__p"), F.count("*").alias("n_branches"))
    return total.select(*parent, "n_branches", F.col("__n").alias("n"), (F.col("__p") / F.col("__n")).alias("weighted_purity"))


def pooled_deviation(rows: DataFrame, keys: list[str], series: str = "series") -> DataFrame:
    """Population deviation of all points of a group's series, and the longest length."""
    points = F.aggregate(series, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + v * v).alias("q")))
    each = rows.select(*keys, points.alias("a"), F.size(series).alias("n"))
    out = each.groupBy(*keys).agg(F.sum("a.s").alias("s"), F.sum("a.q").alias("q"), F.sum("n").alias("n"), F.max("n").alias("longest"))
    return out.select(*keys, F.sqrt(F.greatest(F.try_divide("q", "n") - F.pow(F.try_divide("s", "n"), 2), F.lit(0.0))).alias("sigma"), "longest")


def accuracy(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of rows with a label that are predicted right, and 1 - that; NaN without labels."""
    right = F.avg(F.when(F.col(label).isNotNull(), (F.col(label) == F.col(prediction)).cast("int")))
    return predicted.agg(F.coalesce(right, F.lit(float("nan"))).alias("accuracy"), F.coalesce(1 - right, F.lit(float("nan"))).alias("error_rate"), F.count(label).alias("n"))


def r_squared(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """1 - SSres / SStot and the mean absolute error."""
    rows = predicted.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    mean = F.broadcast(rows.agg(F.avg(label).alias("__m")))
    gap = F.col(label) - F.col(prediction)
    return rows.crossJoin(mean).agg((1 - F.try_divide(F.sum(gap * gap), F.sum(F.pow(F.col(label) - F.col("__m"), 2)))).alias("r2"), F.avg(F.abs(gap)).alias("mae"), F.count("*").alias("n"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the running sum of __n within it."""
    from pyspark import TaskContext

    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        if batch.num_rows:
            upto = pc.add(pc.cumulative_sum(batch["__n"]), total)
            total = upto[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, upto, pa.array([part] * batch.num_rows, pa.int32())], names=[*batch.schema.names, "__upto", "__part"])


def medians(rows: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(keys.., name): exact median of each group's values; groups of any size.

    Equal values are counted first; the counts are range-partitioned by (keys, value), so that no group is ranked by
    one task, and ranks come from running sums. Null values don't count; null keys form a group.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema.fields)
    order = [*keys, "__v"]
    ranked = stored(counts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_running, f"{kinds}, __upto bigint, __part int"))
    parts = ranked.groupBy("__part").agg(F.max("__upto").alias("__all")).withColumn("__before", F.sum("__all").over(Window.orderBy("__part")) - F.col("__all"))
    placed = ranked.join(F.broadcast(parts.select("__part", "__before")), "__part").withColumn("__upto", F.col("__upto") + F.col("__before"))  # one row a partition
    named = [F.col(k).alias(f"__{k}") for k in keys]
    groups = placed.groupBy(*named).agg(F.min(F.col("__upto") - F.col("__n")).alias("__first"), F.sum("__n").alias("__size"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    met = placed.join(groups, same)
    holds = lambda place: (F.col("__first") + place >= F.col("__upto") - F.col("__n")) & (F.col("__first") + place < F.col("__upto"))
    low, high = holds(F.floor((F.col("__size") - 1) / 2)), holds(F.floor(F.col("__size") / 2))
    middle = met.filter(low | high).groupBy(*keys).agg((F.max(F.when(low, F.col("__v"))) / 2 + F.max(F.when(high, F.col("__v"))) / 2).alias(name))
    return middle
