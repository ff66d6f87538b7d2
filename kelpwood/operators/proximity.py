"""Proximities of a forest (geometry- and accuracy-preserving), and outlier scores from proximities.

p(i, j) of two training rows is the mean over the trees that left i out of c_j / |M_i|, where j is in
the in-bag multiset M_i of i's leaf with multiplicity c_j. For other rows all trees count. The result
is a long table (i, j, prox); rows with no tree have none. A leaf's pairs are the result itself, so
the table grows with the square of the largest leaf; restrict ``of`` where that is too much. Sums over j
need no table: ``forest_outlier_scores`` and ``weighted_means`` take them from sums of leaves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpwood.operators.forest import ForestModel
from kelpwood.operators.purity import medians
from kelpwood.session import at_most, stored

LEAST = 1e-6
SURE = 0.999 / LEAST  # in a leaf with fewer rows than this over the trees that count, no proximity is as small as LEAST
MOST_COLUMNS = 100_000  # of a dense table


def _proximities(places: DataFrame, model: ForestModel) -> DataFrame:
    """places: (tree, node, i)."""
    bag = model.membership.filter("not oob")
    size = bag.groupBy("tree", "node").agg(F.sum("mult").alias("size"))
    trees = places.groupBy("i").agg(F.count("*").alias("n_trees"))
    share = bag.join(size, ["tree", "node"]).select("tree", "node", F.col("idx").alias("j"), (F.col("mult") / F.col("size")).alias("share"))
    met = places.join(share, ["tree", "node"]).groupBy("i", "j").agg(F.sum("share").alias("total"))
    return met.join(trees, "i").select("i", "j", (F.col("total") / F.col("n_trees")).alias("prox")).filter(F.col("prox") > LEAST)


def _leaves(model: ForestModel) -> tuple[DataFrame, DataFrame]:
    """(tree, node, j, mult) in the bag and (tree, node, size)."""
    bag = model.membership.filter("not oob").select("tree", "node", F.col("idx").alias("j"), "mult")
    return bag, bag.groupBy("tree", "node").agg(F.sum("mult").alias("size"))


def _sure(places: DataFrame, size: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, node, i, size, n_trees) of the rows none of whose proximities is left out as too small, whatever the other
    row, and (i) of the others."""
    trees = places.groupBy("i").agg(F.count("*").alias("n_trees"))
    placed = places.join(size, ["tree", "node"], "left").join(trees, "i")
    unsure = stored(placed.filter(F.col("size") * F.col("n_trees") >= SURE).select("i").distinct())
    return placed.join(unsure, "i", "left_anti"), unsure


def train_places(model: ForestModel) -> DataFrame:
    """(tree, node, i): the leaves that left a training row out."""
    return model.membership.filter("oob").select("tree", "node", F.col("idx").alias("i"))


def train_proximities(model: ForestModel, of: DataFrame | None = None) -> DataFrame:
    """(i, j, prox) of training rows, from the leaves that left i out."""
    places = train_places(model)
    return _proximities(places if of is None else places.join(of.select(F.col("idx").alias("i")), "i", "left_semi"), model)


def test_proximities(model: ForestModel, rows: DataFrame) -> DataFrame:
    """(i, j, prox) of other rows i and training rows j."""
    return _proximities(model.route(rows).select("tree", "node", F.col("idx").alias("i")), model)


def dense(prox: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """The whole grid as one array a row: (i, prox array in order of j). On request only: it holds
    |rows| * |columns| numbers, so at most ``MOST_COLUMNS`` columns; more are taken block by block."""
    order = stored(columns.select(F.col("idx").alias("j")).distinct())
    if not at_most(order, MOST_COLUMNS):
        raise ValueError(f"more than {MOST_COLUMNS} columns: take them in blocks")
    js = order.agg(F.array_sort(F.collect_list("j")).alias("js"))
    prox = prox.join(F.broadcast(order), "j", "left_semi")
    have = prox.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "prox"))).alias("m"))
    grid = rows.select(F.col("idx").alias("i")).distinct().join(have, "i", "left").crossJoin(F.broadcast(js))
    return grid.select("i", F.transform("js", lambda j: F.coalesce(F.element_at("m", j), F.lit(0.0))).alias("prox"))


def symmetric(prox: DataFrame) -> DataFrame:
    """Half the sum of the table and its mirror image."""
    half = prox.select("i", "j", (F.col("prox") / 2).alias("prox"))
    return half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "prox")).groupBy("i", "j").agg(F.sum("prox").alias("prox"))


def outlier_scores(prox: DataFrame, labels: DataFrame) -> DataFrame:
    """(idx, label, raw, score): raw is n over the sum of squared proximities to rows of the own class
    (0 counts as 1e-6); score is its distance from the class median over the mean such distance."""
    return _scores(_squares(prox, labels), labels)


def forest_outlier_scores(model: ForestModel, labels: DataFrame) -> DataFrame:
    """As ``outlier_scores`` of the training rows' proximities, without a row for each pair.

    The square of a sum over trees is a sum over pairs of trees, and its sum over j is the same for all rows i that share
    the two leaves: one row for each j and pair of trees is added up by (leaf, leaf, label). Rows in a leaf so large that
    pairs may be left out as too small go by the table of pairs."""
    bag, size = _leaves(model)
    places, unsure = _sure(train_places(model), size)
    known = labels.filter("idx is not null and label is not null").select("idx", "label")
    share = bag.join(known.withColumnRenamed("idx", "j"), "j").join(size, ["tree", "node"])
    renamed = lambda rows: rows.select([F.col(c).alias(f"{c}_2") if c in ("tree", "node", "mult", "size") else F.col(c) for c in rows.columns])
    both = share.join(renamed(share.drop("label")), "j").filter("tree <= tree_2")
    # products of whole numbers are exact; a pair of different trees counts twice
    by_leaves = both.groupBy("tree", "node", "tree_2", "node_2", "label").agg((F.sum(F.col("mult") * F.col("mult_2")) / F.first("size") / F.first("size_2") * F.when(F.col("tree") < F.col("tree_2"), 2).otherwise(1)).alias("s"))
    placed = places.join(known.withColumnRenamed("idx", "i"), "i").select("i", "tree", "node", "label", "n_trees")
    pairs = placed.join(placed.select("i", F.col("tree").alias("tree_2"), F.col("node").alias("node_2")), "i").filter("tree <= tree_2")
    met = pairs.join(by_leaves, ["tree", "node", "tree_2", "node_2", "label"])
    squares = met.groupBy(F.col("i").alias("idx")).agg((F.sum("s") / F.pow(F.first("n_trees"), 2)).alias("s"))
    if not at_most(unsure, 0):
        squares = squares.unionByName(_squares(train_proximities(model, unsure.withColumnRenamed("i", "idx")), labels))
    return _scores(squares, labels)


def weighted_means(model: ForestModel, places: DataFrame, donors: DataFrame, entries: Callable[..., DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(idx, channel, pos, value) and (idx): for the rows i of places (tree, node, i), the proximity-weighted mean of each
    entry that any of the donors (idx, series) observes; and the rows in a leaf so large that pairs may be left out as
    too small, which have no means here. A leaf's donors are added up once for all rows in it; ``entries`` of rows gives
    their (channel, pos, v)."""
    bag, size = _leaves(model)
    sure, unsure = _sure(places, size)
    given = bag.join(sure.select("tree", "node").distinct(), ["tree", "node"]).join(donors.select(F.col("idx").alias("j"), "series"), "j")
    observed = entries(given, "tree", "node", "mult").filter("v is not null")
    sums = observed.groupBy("tree", "node", "channel", "pos").agg(F.sum(F.col("mult") * F.col("v")).alias("total"), F.sum("mult").alias("weight"))
    value = F.sum(F.col("total") / F.col("size")) / F.sum(F.col("weight") / F.col("size"))
    means = sure.join(sums, ["tree", "node"]).groupBy(F.col("i").alias("idx"), "channel", "pos").agg(value.alias("value"))
    return means, unsure.select(F.col("i").alias("idx"))


def _squares(prox: DataFrame, labels: DataFrame) -> DataFrame:
    """(idx, s): the sum of squared proximities to rows of the own class."""
    known = labels.filter("idx is not null and label is not null").select("idx", "label")
    own = prox.join(known.select(F.col("idx").alias("i"), "label"), "i").join(known.select(F.col("idx").alias("j"), F.col("label").alias("other")), "j").filter("label = other")
    return own.groupBy(F.col("i").alias("idx")).agg(F.sum(F.col("prox") * F.col("prox")).alias("s"))


def _scores(squares: DataFrame, labels: DataFrame) -> DataFrame:
    labels = labels.filter("idx is not null")
    known = labels.filter("label is not null").select("idx", "label")
    n = F.broadcast(labels.agg(F.count("*").alias("n")))
    raw = known.join(squares, "idx", "left").crossJoin(n).select("idx", "label", (F.col("n") / F.coalesce(F.nullif("s", F.lit(0.0)), F.lit(1e-6))).alias("raw"))
    raw = stored(raw)
    middle = medians(raw, ["label"], "raw")
    off = raw.join(middle, "label").withColumn("off", F.abs(F.col("raw") - F.col("median")))
    spread = off.groupBy("label").agg(F.avg("off").alias("spread"))
    return off.join(spread, "label").select("idx", "label", "raw", F.when(F.col("spread") > 0, F.col("off") / F.col("spread")).alias("score"))


def nearest_by_proximity(prox: DataFrame, n: int) -> DataFrame:
    """The n rows of greatest proximity to each row, ties to the smaller; ranks are pruned before the shuffle."""
    return prox.withColumn("place", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("prox"), "j"))).filter(F.col("place") <= n)
