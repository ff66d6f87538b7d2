"""Initial imputers of series, and their refinement by forest proximities.

Series hold null for missing entries. Per-series imputers are Column expressions (map them over the
channels of a multivariate series with ``per_channel``); global ones aggregate by position. Observed
values never change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpwood.functions import distances as D
from kelpwood.functions.series import let, total
from kelpwood.operators import forest as FO
from kelpwood.operators import knn, proximity
from kelpwood.operators import purity as P
from kelpwood.session import at_most, checkpointed, stored

STRIDE = 1 << 24  # cell number = channel * STRIDE + position


def with_nulls(series: Column) -> Column:
    """NaN entries as null."""
    return F.transform(series, lambda v: F.when(~F.isnan(v), v))


def observed(series: Column) -> Column:
    return F.filter(series, lambda v: v.isNotNull())


def fill(series: Column, value: Column) -> Column:
    return let(value, lambda new: F.transform(series, lambda v: F.coalesce(v, new)))


def mean(series: Column) -> Column:
    """Missing entries become the mean of the observed; 0 if there are none."""
    return fill(series, let(observed(series), lambda seen: F.coalesce(F.when(F.size(seen) > 0, total(seen) / F.size(seen)), F.lit(0.0))))


def median(series: Column) -> Column:
    def middle(seen: Column) -> Column:
        at = lambda i: F.get(seen, F.floor(i).cast("int"))
        return F.coalesce(F.when(F.size(seen) > 0, (at((F.size(seen) - 1) / 2) + at(F.size(seen) / 2)) / 2), F.lit(0.0))

    return fill(series, let(F.array_sort(observed(series)), middle))


def mode(series: Column) -> Column:
    """The most frequent value, ties to the smallest; null if there is none."""
    usual = lambda seen: -F.array_max(F.transform(F.array_distinct(seen), lambda v: F.struct(F.size(F.filter(seen, lambda o: o == v)).alias("n"), (-v).alias("less"))))["less"]
    return fill(series, let(observed(series), usual))


def linear(series: Column) -> Column:
    """Straight between the nearest observed entries; the ends copy the nearest; 0 if there are none."""
    places = F.filter(F.transform(series, lambda v, i: F.when(v.isNotNull(), i)), lambda i: i.isNotNull())

    def between(i: Column, r: Column) -> Column:
        a, b = F.get(series, r["lo"]), F.get(series, r["hi"])
        return F.coalesce(F.when(r["lo"].isNull(), b).when(r["hi"].isNull(), a).otherwise(a + (b - a) * (i - r["lo"]) / (r["hi"] - r["lo"])), F.lit(0.0))

    def at(v: Column, i: Column, seen: Column) -> Column:
        near = F.struct(F.array_max(F.filter(seen, lambda p: p < i)).alias("lo"), F.array_min(F.filter(seen, lambda p: p > i)).alias("hi"))
        return F.when(v.isNotNull(), v).otherwise(let(near, lambda r: between(i, r)))

    return let(places, lambda seen: F.transform(series, lambda v, i: at(v, i, seen)))


def per_channel(imputer: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda series: F.transform(series, imputer)


def two_dimensional(rows: DataFrame) -> bool:
    return isinstance(rows.schema["series"].dataType.elementType, T.ArrayType)


def entries(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep.., channel, pos, v): one row an entry; one-dimensional series are channel 0."""
    return channels(rows, *keep).select(*keep, "channel", F.posexplode("x").alias("pos", "v"))


def channels(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep.., channel, x): one row a channel."""
    if two_dimensional(rows):
        return rows.select(*keep, F.posexplode("series").alias("channel", "x"))
    return rows.select(*keep, F.lit(0).alias("channel"), F.col("series").alias("x"))


def cell(channel: Column, pos: Column) -> Column:
    return channel.cast("bigint") * STRIDE + pos


def _put(rows: DataFrame, new: Callable[[Column, Column, Column], Column]) -> Column:
    """The series with new(cell, entry, position) for each entry."""
    if two_dimensional(rows):
        return F.transform("series", lambda x, c: F.transform(x, lambda v, i: new(cell(c, i), v, i)))
    return F.transform("series", lambda v, i: new(cell(F.lit(0), i), v, i))


def global_fill(rows: DataFrame, kind: str) -> DataFrame:
    """rows with missing entries filled by the mean, median or mode of their channel and position over all
    rows (mode ties to the smallest); 0 where none is observed."""
    at = ["channel", "pos"]
    cells = entries(rows).filter("v is not null")
    if kind == "mode":
        values = cells.groupBy(*at, "v").agg(F.count("*").alias("n")).groupBy(*at).agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("value"))
    elif kind == "median":
        values = P.medians(cells, at, "v", "value")
    else:
        values = cells.groupBy(*at).agg(F.avg("v").alias("value"))
    table = values.agg(F.map_from_entries(F.collect_list(F.struct(cell(F.col("channel"), F.col("pos")).alias("cell"), "value"))).alias("__by"))  # one entry a position
    return rows.crossJoin(F.broadcast(table)).withColumn("series", _put(rows, lambda k, v, _: F.coalesce(v, F.element_at("__by", k), F.lit(0.0)))).drop("__by")


def missing_of(rows: DataFrame) -> DataFrame:
    """(idx, channel, pos) of the missing entries, to be kept from before any filling."""
    return entries(rows, "idx").filter("v is null").select("idx", "channel", "pos")


def put(rows: DataFrame, values: DataFrame) -> DataFrame:
    """rows (idx, series, ..) with the values (idx, channel, pos, value) put in."""
    new = values.filter("value is not null").groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct(cell(F.col("channel"), F.col("pos")).alias("cell"), "value"))).alias("__new"))
    return rows.join(new, "idx", "left").withColumn("series", _put(rows, lambda k, v, _: F.coalesce(F.element_at("__new", k), v))).drop("__new")


def knn_fill(rows: DataFrame, k: int = 5, distances: tuple[str, ...] = ("euclidean",)) -> DataFrame:
    """Missing entries become the mean of the k nearest rows that observe them; 0 if none does. The
    channels of multivariate series are compared one after the other as one long series."""
    two = two_dimensional(rows)
    gaps = missing_of(rows)
    flat = rows.select("idx", (F.flatten("series") if two else F.col("series")).alias("series"))
    near = knn.exact_nearest(flat.join(gaps.select("idx").distinct(), "idx", "left_semi"), flat, k, distances).filter("distance < double('infinity')")
    seen = near.select("idx", "neighbour").join(rows.select(F.col("idx").alias("neighbour"), F.col("series").alias("theirs")), "neighbour")
    theirs = F.get(F.get("theirs", F.col("channel")), F.col("pos")) if two else F.get("theirs", F.col("pos"))
    values = gaps.join(seen, "idx", "left").groupBy("idx", "channel", "pos").agg(F.coalesce(F.avg(theirs), F.lit(0.0)).alias("value"))
    return put(rows, values)


def knn_mode(missing: DataFrame, known: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(idx, value): categorical values missing in (idx), the most frequent of the neighbours' known (idx,
    value); ties to the smaller value. neighbours: (idx, neighbour), as exact_nearest gives them."""
    seen = missing.select("idx").join(neighbours.select("idx", "neighbour"), "idx").join(known.select(F.col("idx").alias("neighbour"), "value"), "neighbour")
    return seen.groupBy("idx", "value").agg(F.count("*").alias("n")).groupBy("idx").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))


def _weighted(met: DataFrame) -> DataFrame:
    return met.groupBy("idx", "channel", "pos").agg((F.sum(F.col("prox") * F.col("v")) / F.sum("prox")).alias("value"))


def proximity_update(filled: DataFrame, original: DataFrame, prox: DataFrame, donors: DataFrame | None = None) -> DataFrame:
    """Each entry missing in ``original`` becomes the proximity-weighted mean of the donors (the rows of
    ``original`` themselves by default) that observe its position; it stays as filled where none does."""
    gaps = missing_of(original).join(prox.select(F.col("i").alias("idx"), "j", "prox"), "idx")
    seen = entries(original if donors is None else donors, "idx").filter("v is not null").withColumnRenamed("idx", "j")
    return put(filled, _weighted(gaps.join(seen, ["j", "channel", "pos"])))


def aligned_update(filled: DataFrame, original: DataFrame, prox: DataFrame, donors: DataFrame | None = None, filled_donors: DataFrame | None = None) -> DataFrame:
    """As proximity_update, but a neighbour's values come from where its DTW path with the row passes,
    channel by channel."""
    lacking = missing_of(original)
    donors, filled_donors = original if donors is None else donors, filled if filled_donors is None else filled_donors
    pairs = prox.filter("i <> j").join(lacking.select(F.col("idx").alias("i"), "channel").distinct(), "i")
    own = channels(filled, "idx").select(F.col("idx").alias("i"), "channel", F.col("x").alias("a"))
    other = channels(filled_donors, "idx").select(F.col("idx").alias("j"), "channel", F.col("x").alias("b"))
    path = pairs.join(own, ["i", "channel"]).join(other, ["j", "channel"]).select("i", "j", "channel", "prox", F.explode(D.alignment_path("a", "b")).alias("at")).select(F.col("i").alias("idx"), "j", "channel", "prox", F.col("at.i").alias("pos"), F.col("at.j").alias("to"))
    seen = entries(donors, "idx").filter("v is not null").select(F.col("idx").alias("j"), "channel", F.col("pos").alias("to"), "v")
    return put(filled, _weighted(path.join(lacking, ["idx", "channel", "pos"]).join(seen, ["j", "channel", "to"])))


def weighted_mode(missing: DataFrame, known: DataFrame, prox: DataFrame) -> DataFrame:
    """(idx, value): categorical values missing in (idx), the proximity-weighted mode of known (idx, value);
    ties to the smaller value."""
    votes = missing.select(F.col("idx").alias("i")).join(prox, "i").join(known.select(F.col("idx").alias("j"), "value"), "j").groupBy("i", "value").agg(F.sum("prox").alias("w"))
    return votes.groupBy(F.col("i").alias("idx")).agg(F.min_by("value", F.struct(-F.col("w"), F.col("value"))).alias("value"))


IMPUTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    **{n: (lambda rows, f=f: rows.withColumn("series", (per_channel(f) if two_dimensional(rows) else f)(F.col("series")))) for n, f in {"mean": mean, "median": median, "mode": mode, "linear": linear}.items()},
    **{f"global_{k}": (lambda rows, k=k: global_fill(rows, k)) for k in ("mean", "median", "mode")},
    "knn": knn_fill,
}


def _started(config: FO.ForestConfig) -> Callable[[DataFrame], DataFrame]:
    return IMPUTERS[config.initial_imputer] if config.initial_imputer != "knn" else (lambda rows: knn_fill(rows, 5, config.knn_distances))


def forest_impute(train: DataFrame, config: FO.ForestConfig, test: DataFrame | None = None) -> tuple[FO.ForestModel, DataFrame, DataFrame | None]:
    """Fill (idx, series, label) by the initial imputer, refine it ``impute_iterations`` times by the
    proximities of a forest trained on it, and train the final forest: (model, train, test)."""
    start = _started(config)
    filled, other = checkpointed(start(train)), None if test is None else checkpointed(start(test))
    for _ in range(config.impute_iterations):
        model = FO.fit(filled, config)
        new, other = refine(model, filled, train, config), None if test is None else refine_others(model, other, test, train, filled, config)
        filled = new
    return FO.fit(filled, config), filled, other


def forest_impute_others(train: DataFrame, config: FO.ForestConfig, test: DataFrame) -> DataFrame:
    """The filled test rows of forest_impute. They don't depend on the last update of the training rows and on the final
    forest, which aren't made."""
    filled, other = (checkpointed(_started(config)(rows)) for rows in (train, test))
    for left in reversed(range(config.impute_iterations)):
        model = FO.fit(filled, config)
        other = refine_others(model, other, test, train, filled, config)
        filled = refine(model, filled, train, config) if left else filled
    return other


def _position_update(filled: DataFrame, original: DataFrame, model: FO.ForestModel, places: DataFrame, donors: DataFrame, prox: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As proximity_update by the forest's proximities of the rows in places (tree, node, i), from sums of leaves;
    ``prox`` of rows (idx) is only asked for rows in leaves too large for that."""
    means, unsure = proximity.weighted_means(model, places, donors, entries)
    new = put(filled, missing_of(original).join(means, ["idx", "channel", "pos"]))
    if at_most(unsure, 0):
        return new
    few = lambda rows: rows.join(unsure, "idx", "left_semi")
    paired = proximity_update(few(filled), few(original), prox(unsure), donors)
    return new.join(unsure, "idx", "left_anti").unionByName(paired)


def _lacking(original: DataFrame) -> DataFrame:
    """(idx) of the rows with missing entries; no other is changed by an update."""
    return stored(missing_of(original).select("idx").distinct())


def refine(model: FO.ForestModel, filled: DataFrame, original: DataFrame, config: FO.ForestConfig) -> DataFrame:
    """One update of training rows by the forest's own proximities."""
    lacking = _lacking(original)
    if config.alignment == "dtw":
        return checkpointed(aligned_update(filled, original, proximity.train_proximities(model, lacking)))
    places = proximity.train_places(model).join(lacking.withColumnRenamed("idx", "i"), "i", "left_semi")
    return checkpointed(_position_update(filled, original, model, places, original, lambda of: proximity.train_proximities(model, of)))


def refine_others(model: FO.ForestModel, filled: DataFrame, original: DataFrame, train: DataFrame, filled_train: DataFrame, config: FO.ForestConfig) -> DataFrame:
    """One update of other rows by their proximities to the training rows."""
    rows = filled.join(_lacking(original), "idx", "left_semi")
    if config.alignment == "dtw":
        return checkpointed(aligned_update(filled, original, proximity.test_proximities(model, rows), train, filled_train))
    places = model.route(rows).select("tree", "node", F.col("idx").alias("i"))
    return checkpointed(_position_update(filled, original, model, places, train, lambda of: proximity.test_proximities(model, rows.join(of, "idx", "left_semi"))))


def recode(train: DataFrame, label: str = "label") -> DataFrame:
    """(label, code): codes 0, 1, .. in the order in which labels are first seen by idx. Join others to it
    from the left: an unseen label has no code."""
    first = train.filter(F.col(label).isNotNull()).groupBy(label).agg(F.min("idx").alias("first"))
    return first.select(label, (F.row_number().over(Window.orderBy("first", label)) - 1).alias("code"))  # one row a label


# --- mixed entries: structs (num, bool, str) ---------------------------------------------------


def _cells(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.posexplode("series").alias("pos", "e"))


def _most(votes: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """(keys.., value): the entry of the greatest weight (to nine places), ties to the smaller entry."""
    return votes.groupBy(*keys).agg(F.min_by("e", F.struct(-F.round(weight, 9), F.col("e"))).alias("value"))


def _put_entries(rows: DataFrame, values: DataFrame) -> DataFrame:
    """Entries that are null become the values (idx, pos, value)."""
    new = values.groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("__new"))
    return rows.join(new, "idx", "left").withColumn("series", F.transform("series", lambda e, i: F.coalesce(e, F.element_at("__new", i)))).drop("__new")


def mixed_mode(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Missing entries become the most frequent entry of their position (within ``keys``), ties to the smaller; they
    stay missing where none is observed."""
    seen = _cells(rows, *keys).filter("e is not null").groupBy(*keys, "pos", "e").agg(F.count("*").alias("n"))
    best = _most(seen, [*keys, "pos"], "n")
    gaps = _cells(rows, "idx", *keys).filter("e is null")
    return _put_entries(rows, gaps.join(best, [*keys, "pos"]).select("idx", "pos", "value"))


def mixed_update(filled: DataFrame, original: DataFrame, prox: DataFrame, donors: DataFrame | None = None) -> DataFrame:
    """Each entry missing in ``original`` becomes the proximity-weighted mode of what the donors (the rows of
    ``original`` themselves by default) observe at its position; it stays as filled where none does."""
    gaps = _cells(original, "idx").filter("e is null").select("idx", "pos")
    seen = _cells(original if donors is None else donors, "idx").filter("e is not null").withColumnRenamed("idx", "j")
    votes = gaps.join(prox.filter("i <> j").select(F.col("i").alias("idx"), "j", "prox"), "idx").join(seen, ["j", "pos"]).groupBy("idx", "pos", "e").agg(F.sum("prox").alias("w"))
    bare = original.select("idx", F.col("series").alias("__raw")).join(_most(votes, ["idx", "pos"], "w").groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("__new")), "idx")
    return filled.join(bare, "idx", "left").withColumn("series", F.transform("series", lambda e, i: F.when(F.get("__raw", i).isNull(), F.coalesce(F.element_at("__new", i), e)).otherwise(e))).drop("__raw", "__new")


def forest_impute_mixed(train: DataFrame, config: FO.ForestConfig, test: DataFrame | None = None) -> tuple[FO.ForestModel, DataFrame, DataFrame | None]:
    """As forest_impute for mixed entries: modes of the positions first, then proximity-weighted modes, from forests on
    the ``mixed`` distance: (model, train, test). idx counts from 0. A position that no row observes becomes an empty text."""
    from dataclasses import replace

    from kelpwood.functions.mixed import encoded

    cfg = replace(config, distances=("mixed",))
    nothing = F.struct(F.lit(None).cast("double").alias("num"), F.lit(None).cast("boolean").alias("bool"), F.lit("").alias("str"))
    # the two may number their rows alike: test rows count from -1 down meanwhile
    turned = lambda rows: rows.withColumn("idx", -1 - F.col("idx"))
    test = None if test is None else turned(test.select(*train.columns))
    both = train if test is None else train.unionByName(test)
    started = checkpointed(mixed_mode(both).withColumn("series", F.transform("series", lambda e: F.coalesce(e, nothing))))
    filled, other = started.filter("idx >= 0"), None if test is None else started.filter("idx < 0")
    for _ in range(config.impute_iterations):
        # one scale for both: test rows are encoded together with the training rows
        scaled = checkpointed(encoded(filled if other is None else filled.unionByName(other)))
        model = FO.fit(scaled.filter("idx >= 0"), cfg)
        new = checkpointed(mixed_update(filled, train, proximity.train_proximities(model)))
        if other is not None:
            other = checkpointed(mixed_update(other, test, proximity.test_proximities(model, scaled.filter("idx < 0")), train))
        filled = new
    scaled = encoded(filled if other is None else filled.unionByName(other))
    return FO.fit(scaled.filter("idx >= 0"), cfg), filled, None if other is None else turned(other)
