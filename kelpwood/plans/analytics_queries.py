"""Queries of the series functions, aggregates, forests, proximities, imputers, graphs, model-based
distances, sources and streams, over whole tables, with SQL where it can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpwood.functions import graphs, meta  # noqa: F401 (graphs registers its distances)
from kelpwood.functions import distances as D
from kelpwood.functions import series as S
from kelpwood.operators import forest as FO
from kelpwood.operators import hotdeck, impute, knn, proximity
from kelpwood.operators import purity as P
from kelpwood.plans.problems import _LINES
from kelpwood.plans.distance_queries import paths_sql, records_2d, valid
from kelpwood.session import at_most, broadcast_if_small, checkpointed, folder, table
from kelpwood.sources import delimited
from kelpwood.streaming import scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _series(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "series_1d").filter(valid(F.col("series"))).select("idx", "file_id", "label", "series")


def _whole(spark: SparkSession, d: str) -> DataFrame:
    """All series that aren't null, NaN as null."""
    return table(spark, d, "series_1d").filter("series is not null and size(series) = 32").select("idx", "file_id", "label", impute.with_nulls(F.col("series")).alias("series"))


def _gappy(spark: SparkSession, d: str) -> DataFrame:
    """All series with entries, of any length, NaN as null."""
    return table(spark, d, "series_1d").filter("size(series) > 0").select("idx", "file_id", "label", impute.with_nulls(F.col("series")).alias("series"))


_E = "n as (select idx, file_id, label, list_transform(series, lambda v: case when not isnan(v) then v end) as x from series_1d where len(series) > 0)"
_V = "v as (select idx, file_id, label, series as x from series_1d where len(series) > 0 and len(list_filter(series, lambda v: v is null or isnan(v))) = 0)"
_N = "n as (select idx, file_id, label, list_transform(series, lambda v: case when not isnan(v) then v end) as x from series_1d where len(series) = 32)"
_SQL_STEPS = "list_transform(range(1, len(x)), lambda k: x[k + 1] - x[k])"
_R6 = lambda c: F.transform(c, lambda v: F.round(v, 6))
_R9 = lambda c: F.transform(c, lambda v: F.round(v, 9))


# --- series functions ------------------------------------------------------------------------


@query(f"with {_V} select idx, list_transform({_SQL_STEPS}, lambda v: round(v, 6)) as y from v")
def s_difference(spark, d):
    """First-order difference."""
    return _series(spark, d).select("idx", _R6(S.difference(F.col("series"))).alias("y"))


@query("""
with r as (select idx, series from series_multi where series is not null qualify row_number() over (partition by idx order by arrived_at) = 1),
q as (select idx, list_transform(series, lambda c: list_transform(c, lambda v: case when v is null or isnan(v) then 0.0::double else v end)) as s from r)
select idx, list_transform(s, lambda x: list_transform(range(1, len(x)), lambda k: round(x[k + 1] - x[k], 6))) as y from q
""")
def s_difference_2d(spark, d):
    """First-order difference of every channel."""
    return records_2d(spark, d).select("idx", F.transform(S.difference_2d(F.col("series")), _R6).alias("y"))


@query(f"with {_V}, i as (select *, range(1, len(x) + 1) as r from v) select idx, case when len(x) < 3 then list_transform(x, lambda v: round(v, 9)) else list_transform(r, lambda k: round(((x[greatest(2, least(k, len(x) - 1))] - x[greatest(2, least(k, len(x) - 1)) - 1]) + (x[greatest(2, least(k, len(x) - 1)) + 1] - x[greatest(2, least(k, len(x) - 1)) - 1]) / 2) / 2, 9)) end as y from i")
def s_keogh_derivative(spark, d):
    """Keogh's derivative."""
    return _series(spark, d).select("idx", F.transform(S.keogh_derivative(F.col("series")), lambda v: F.round(v, 9)).alias("y"))


@query(f"with {_V}, g as (select idx, {_SQL_STEPS} as g, floor(sqrt(len(x)))::int as n from v) select idx, list_transform(range(0, n), lambda k: len(list_filter(g, lambda t: case when list_max(g) = list_min(g) then k = 0 else least(floor((t - list_min(g)) / ((list_max(g) - list_min(g)) / n)), n - 1) = k end))::double) as y from g where len(g) > 0")
def s_gradients_histogram(spark, d):
    """Histogram of the gradients."""
    return _series(spark, d).filter("size(series) > 1").select("idx", S.gradients_histogram(F.col("series")).alias("y"))


_R2 = "r as (select idx, list_transform(series, lambda c: list_transform(c, lambda v: case when v is null or isnan(v) then 0.0::double else v end)) as s from (select * from series_multi where series is not null qualify row_number() over (partition by idx order by arrived_at) = 1))"
_STEPS_OF = "list_transform(range(1, len({x})), lambda k: {x}[k + 1] - {x}[k])"
_COUNTS = "list_transform(range(0, n), lambda k: len(list_filter({g}, lambda t: case when list_max({g}) = list_min({g}) then k = 0 else least(floor((t - list_min({g})) / ((list_max({g}) - list_min({g})) / n)), n - 1) = k end))::double)"


@query(f"with {_R2}, q as (select idx, flatten(list_transform(s, lambda x: {_STEPS_OF.format(x='x')})) as f, floor(sqrt(len(s[1])))::int as n from r), g as (select idx, n, {_STEPS_OF.format(x='f')} as g from q) select idx, {_COUNTS.format(g='g')} as y from g")
def s_gradients_histogram_2d(spark, d):
    """One histogram of the gradients of all channels."""
    return records_2d(spark, d).select("idx", S.gradients_histogram_2d(F.col("series")).alias("y"))


@query(f"with {_R2}, c as (select idx, floor(sqrt(len(s[1])))::int as n, unnest(s) as x, unnest(range(len(s))) as ch from r), f as (select idx, n, ch, {_STEPS_OF.format(x='x')} as f from c), g as (select idx, n, ch, {_STEPS_OF.format(x='f')} as g from f), h as (select idx, ch, {_COUNTS.format(g='g')} as y from g) select idx, flatten(list(y order by ch)) as y from h group by idx")
def s_gradients_histogram_per_channel(spark, d):
    """The channels' histograms side by side."""
    return records_2d(spark, d).select("idx", S.gradients_histogram_2d(F.col("series"), "per_channel").alias("y"))


@query(f"with {_R2}, q as (select idx, list_transform(range(1, len(s[1])), lambda k: list_sum(list_transform(s, lambda x: x[k + 1] - x[k])) / len(s)) as f, floor(sqrt(len(s[1])))::int as n from r), g as (select idx, n, {_STEPS_OF.format(x='f')} as g from q) select idx, {_COUNTS.format(g='g')} as y from g")
def s_gradients_histogram_average(spark, d):
    """Histogram of the channels' mean gradients."""
    return records_2d(spark, d).select("idx", S.gradients_histogram_2d(F.col("series"), "average").alias("y"))


@query()
def s_gradients_histogram_pca(spark, d):
    """Histogram of the gradients of the channels' first principal component."""
    return records_2d(spark, d).select("idx", S.gradients_histogram_2d(F.col("series"), "pca").alias("y"))


@query("""
with v as (select idx, label, series from series_1d where len(series) = 32 and len(list_filter(series, lambda x: x is null or isnan(x))) = 0),
n as (select a.idx, b.label, row_number() over (partition by a.idx order by list_distance(a.series, b.series), b.idx) as place from v a join v b on a.idx <> b.idx where a.label is null qualify place <= 5),
c as (select idx, label, count(*) as k from n where label is not null group by all)
select idx, arg_min(label, (-k, label)) as value from c group by idx
""")
def i_knn_mode(spark, d):
    """Missing labels become the most frequent of the 5 nearest series."""
    rows = _series(spark, d).filter("size(series) = 32")
    lacking = rows.filter("label is null")
    return impute.knn_mode(lacking, rows.filter("label is not null").select("idx", F.col("label").alias("value")), knn.exact_nearest(lacking, rows))


@query(f"with {_V} select idx, list_transform(x, lambda t: round((t - list_avg(x)) / sqrt(list_var_pop(x)), 6)) as y from v")
def s_z_normalised(spark, d):
    """Mean 0 and population deviation 1."""
    return _series(spark, d).select("idx", _R6(S.z_normalised(F.col("series"))).alias("y"))


@query(f"with {_V} select idx, round(sqrt(list_sum(list_transform({_SQL_STEPS}, lambda v: v * v))), 6) as y from v")
def s_complexity(spark, d):
    """Complexity of a series."""
    return _series(spark, d).select("idx", F.round(S.complexity(F.col("series")), 6).alias("y"))


@query(f"with {_V} select idx, list_transform(range(0, len(x)), lambda k: round(1 / (1 + exp(-0.1 * (k - len(x) / 2.0))), 9)) as y from v")
def s_logistic_weights(spark, d):
    """Logistic weights for the length of each series."""
    return _series(spark, d).select("idx", F.transform(S.logistic_weights(F.size("series"), F.lit(0.1)), lambda v: F.round(v, 9)).alias("y"))


@query("select idx, list_transform(list_filter(range(1, len(series) + 1), lambda k: series[k] is null or isnan(series[k])), lambda k: (k - 1)::int) as y from series_1d where series is not null")
def s_missing_positions(spark, d):
    """Positions of missing entries."""
    return table(spark, d, "series_1d").filter("series is not null").select("idx", S.missing_positions(F.col("series")).alias("y"))


@query("select i, j_first, (k - 1)::int as p, prox[k] as prox from (select i, j_first, prox, unnest(range(1, len(prox) + 1)) as k from (select distinct i, j_first, prox from dense_proximities)) where prox[k] > 1e-6 and not isnan(prox[k])")
def s_dense_to_sparse(spark, d):
    """Entries of dense rows above 1e-6, by position."""
    rows = table(spark, d, "dense_proximities").filter("prox is not null").select("i", "j_first", F.transform("prox", lambda v: F.when(~F.isnan(v), v)).alias("prox")).distinct()
    return rows.select("i", "j_first", F.explode(S.dense_to_sparse(F.col("prox"))).alias("p", "prox"))


# --- purities, samples, statistics -----------------------------------------------------------

_C = "c as (select file_id, label, count(*) as n from series_1d where label is not null group by all), t as (select *, n / sum(n) over (partition by file_id) as p from c)"


def _labelled(spark, d):
    return table(spark, d, "series_1d").select("idx", "file_id", "label")


@query("select file_id, label, count(*)::bigint as n from series_1d where label is not null group by all")
def a_class_counts(spark, d):
    """Rows of every class."""
    return P.class_counts(_labelled(spark, d), ["file_id"])


@query(f"with {_C} select file_id, sum(n)::bigint as n, round(1 - sum(p * p), 9) as purity from t group by file_id")
def a_gini(spark, d):
    """Gini impurity of each file's labels."""
    return P.class_purity(P.class_counts(_labelled(spark, d), ["file_id"]), ["file_id"], "gini").withColumn("purity", F.round("purity", 9))


@query(f"with {_C} select file_id, sum(n)::bigint as n, round(-sum(p * log2(p)), 9) + 0.0 as purity from t group by file_id")
def a_entropy(spark, d):
    """Entropy of each file's labels."""
    return P.class_purity(P.class_counts(_labelled(spark, d), ["file_id"]), ["file_id"], "entropy").withColumn("purity", F.round("purity", 9) + F.lit(0.0))


def _targets(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal"), "o_custkey")


@query("select c_mktsegment, count(*) as n, round(var_pop(o_totalprice::double), 2) as purity from orders join customer on c_custkey = o_custkey group by 1")
def a_variance(spark, d):
    """Variance of order prices by segment."""
    rows = _targets(spark, d).withColumn("y", F.col("o_totalprice").cast("double"))
    return P.numeric_purity(rows, ["c_mktsegment"], "y", "variance").withColumn("n", F.col("n").cast("bigint")).withColumn("purity", F.round("purity", 2))


@query("with r as (select c_mktsegment, o_totalprice::double as y, avg(o_totalprice::double) over (partition by c_mktsegment) as m from orders join customer on c_custkey = o_custkey) select c_mktsegment, count(*) as n, round(avg(abs(y - m)), 4) as purity from r group by 1")
def a_mad(spark, d):
    """Mean absolute deviation of order prices by segment."""
    rows = _targets(spark, d).withColumn("y", F.col("o_totalprice").cast("double"))
    return P.numeric_purity(rows, ["c_mktsegment"], "y", "mad").withColumn("n", F.col("n").cast("bigint")).withColumn("purity", F.round("purity", 4))


@query(f"with {_V}, b as (select file_id, x[1] > 0 as branch, label, count(*) as n from v where label is not null group by all), g as (select file_id, branch, sum(n) as n, 1 - sum(pow(n / t, 2)) as purity from (select *, sum(n) over (partition by file_id, branch) as t from b) group by all) select file_id, count(*) as n_branches, sum(n)::bigint as n, round(sum(n * purity) / sum(n), 9) as weighted_purity from g group by 1")
def a_weighted_purity(spark, d):
    """Weighted Gini of splitting each file by the sign of the first entry."""
    rows = _series(spark, d).withColumn("branch", F.get("series", F.lit(0)) > 0)
    of = ["file_id", "branch"]
    return P.weighted_purity(P.class_purity(P.class_counts(rows, of), of, "gini"), ["file_id"]).withColumn("weighted_purity", F.round("weighted_purity", 9))


@query(f"with {_V}, e as (select file_id, unnest(x) as t from v) select file_id, round(stddev_pop(t), 6) as sigma, (select max(len(x)) from v where v.file_id = e.file_id)::int as longest from e group by file_id")
def a_pooled_deviation(spark, d):
    """Deviation of all points of a file."""
    return P.pooled_deviation(_series(spark, d), ["file_id"]).withColumn("sigma", F.round("sigma", 6))


@query("""
with p as (select idx, row_number() over (order by idx) - 1 as place, count(*) over () as n from series_1d),
d as (select t as tree, ('0x' || substr(md5(concat_ws('|', '0', 'bag', t, place)), 1, 8))::bigint % n as place from p, range(3) r(t)),
m as (select tree, place, count(*) as mult from d group by all)
select t::int as tree, idx, coalesce(mult, 0)::bigint as mult, mult is null as oob from p cross join range(3) r(t) left join m on m.tree = t and m.place = p.place
""")
def a_bootstrap(spark, d):
    """Multiplicities and left-out rows of three trees."""
    return FO.bootstrap(table(spark, d, "series_1d").select("idx"), 3, 0)


@query("select label, row_number() over (order by min(idx), label) - 1 as code from series_1d where label is not null group by label")
def a_label_codes(spark, d):
    """Labels in the order in which they are first seen."""
    return impute.recode(table(spark, d, "series_1d")).withColumn("code", F.col("code").cast("bigint"))


@query("select file_id, label, idx from series_1d where label is not null qualify row_number() over (partition by file_id, label order by ('0x' || substr(md5(concat_ws('|', '0', 'sample', idx)), 1, 8))::bigint, idx) <= 2")
def a_stratified_sample(spark, d):
    """Two rows of every class by hash (a sampling operator)."""
    order = Window.partitionBy("file_id", "label").orderBy(FO.draw(0, "sample", F.col("idx")), "idx")
    return _labelled(spark, d).filter("label is not null").withColumn("n", F.row_number().over(order)).filter("n <= 2").drop("n")


# --- one seeded split ---------------------------------------------------------

_SPLIT = """
with v as (
  select idx, label, series as x from series_1d
  where label is not null and len(series) = 32 and len(list_filter(series, lambda t: t is null or isnan(t))) = 0
),
e as (select label, arg_min(idx, (('0x' || substr(md5(concat_ws('|', '0', 'ex', '0', 'r', '0', label, idx)), 1, 8))::bigint, idx)) as eidx from v group by label),
x as (select e.label as branch, eidx, x as ex from e join v on idx = eidx),
d as (select v.idx, v.label, branch, case when v.idx = eidx then -1 else list_sum(list_transform(range(1, 33), lambda k: pow(x[k] - ex[k], 2))) end as d from v, x),
b as (select idx, label, branch from d qualify row_number() over (partition by idx order by d, branch) = 1)
"""


@query(f"{_SPLIT}, c as (select branch, label, count(*) as n from b group by all), t as (select *, sum(n) over (partition by branch) as s from c) select branch, sum(n)::bigint as n, round(1 - sum(pow(n / s, 2)), 9) as purity from t group by branch")
def f_split(spark, d):
    """One seeded split: an exemplar of each class, every row to the nearest, Gini of the branches."""
    rows = _series(spark, d).filter("label is not null and size(series) = 32")
    pick = rows.groupBy("label").agg(F.min_by("idx", F.struct(FO.draw(0, "ex", 0, "r", 0, F.col("label"), F.col("idx")), F.col("idx"))).alias("eidx"))
    chosen = pick.join(rows.select(F.col("idx").alias("eidx"), F.col("series").alias("ex")), "eidx").select(F.col("label").alias("branch"), "eidx", "ex")
    chosen = checkpointed(chosen)  # one row a class
    if not at_most(chosen, 10_000):
        raise ValueError("more than 10,000 classes are not compared in one split")
    sets = F.broadcast(chosen.groupBy().agg(F.collect_list(F.struct("branch", "eidx", "ex")).alias("sets")))
    near = F.array_min(F.transform("sets", lambda e: F.struct(F.when(e["eidx"] == F.col("idx"), F.lit(-1.0)).otherwise(S.squared_euclidean(F.col("series"), e["ex"])).alias("d"), e["branch"].alias("branch"))))
    routed = rows.crossJoin(sets).select("idx", "label", near["branch"].alias("branch"))
    return P.class_purity(P.class_counts(routed, ["branch"]), ["branch"], "gini").withColumn("purity", F.round("purity", 9))


# --- proximity tables ------------------------------------------------------------------------

_PROX = "p as (select i, j, max(prox) as prox from sparse_proximities where prox > 0 and prox <= 1 and j <> i group by all)"


def _prox(spark, d) -> DataFrame:
    return table(spark, d, "sparse_proximities").filter("prox > 0 and prox <= 1 and j <> i").groupBy("i", "j").agg(F.max("prox").alias("prox"))


@query(f"with {_PROX}, h as (select i, j, prox / 2 as prox from p union all select j, i, prox / 2 from p) select i, j, round(sum(prox), 9) as prox from h group by all")
def x_symmetric(spark, d):
    """Symmetric proximities."""
    return proximity.symmetric(_prox(spark, d)).withColumn("prox", F.round("prox", 9))


@query(f"with {_PROX}, e as (select distinct exemplar_idx as j from exemplars), g as (select i, e.j, coalesce(prox, 0) as prox from (select distinct i from p) i cross join e left join p using (i, j)) select i, list(prox order by j) as prox from g group by i")
def x_dense(spark, d):
    """Dense rows of the proximities to the exemplars, whose number is fixed."""
    ids = table(spark, d, "exemplars").select(F.col("exemplar_idx").alias("idx"))
    p = _prox(spark, d)
    return proximity.dense(p.join(F.broadcast(ids.select(F.col("idx").alias("j"))), "j", "left_semi"), p.select(F.col("i").alias("idx")), ids)


_OUT = f"""
with {_PROX}, l as (select idx, label from series_1d),
s as (select p.i as idx, sum(prox * prox) as s from p join l a on a.idx = p.i join l b on b.idx = p.j where a.label = b.label group by 1),
r as (select l.idx, l.label, (select count(*) from l) / coalesce(nullif(s, 0), 1e-6) as raw from l left join s using (idx) where l.label is not null),
o as (select *, abs(raw - median(raw) over (partition by label)) as off from r)
"""


@query(f"{_OUT} select idx, label, round(raw, 3) as raw from r")
def x_outlier_raw(spark, d):
    """Raw outlier scores from the sparse proximities."""
    return proximity.outlier_scores(_prox(spark, d), table(spark, d, "series_1d")).select("idx", "label", F.round("raw", 3).alias("raw"))


@query(f"{_OUT}, m as (select *, avg(off) over (partition by label) as spread from o) select idx, label, round(case when spread > 0 then off / spread end, 6) as score from m")
def x_outlier_score(spark, d):
    """Outlier scores, normalised by class."""
    return proximity.outlier_scores(_prox(spark, d), table(spark, d, "series_1d")).select("idx", "label", F.round("score", 6).alias("score"))


@query(f"with {_PROX} select i, j, prox, (row_number() over (partition by i order by prox desc, j))::int as place from p qualify place <= 3")
def x_nearest_by_proximity(spark, d):
    """The three rows of greatest proximity (a top-k report)."""
    return proximity.nearest_by_proximity(_prox(spark, d), 3)


# --- imputers --------------------------------------------------------------------------------

_OBS = "list_filter(x, lambda t: t is not null)"


def _imputed(name: str, value: str) -> None:
    def run(spark, d):
        return impute.IMPUTERS[name](_gappy(spark, d)).select("idx", _R9(F.col("series")).alias("y"))

    run.__name__ = f"i_{name}"
    query(f"with {_E} select idx, list_transform(x, lambda t: round(coalesce(t, {value}), 9)) as y from n")(run)


_imputed("mean", f"list_avg({_OBS}), 0")
_imputed("median", f"list_median({_OBS}), 0")


def _by_position(name: str, value: str) -> None:
    def run(spark, d):
        return impute.IMPUTERS[name](_whole(spark, d)).select("idx", _R9(F.col("series")).alias("y"))

    run.__name__ = f"i_{name}"
    query(f"with {_N}, c as (select idx, unnest(x) as t, unnest(range(len(x))) as pos from n), g as (select pos, {value} as g from {'c where t is not null' if 'mode' not in name else '(select pos, t, count(*) as k from c where t is not null group by all)'} group by pos) select idx, list(round(coalesce(t, g, 0), 9) order by pos) as y from c left join g using (pos) group by idx")(run)


_by_position("global_mean", "avg(t)")
_by_position("global_median", "median(t)")
_by_position("global_mode", "arg_min(t, (-k, t))")


@query(f"with {_E}, c as (select idx, unnest(x) as t, unnest(range(len(x))) as pos from n), m as (select idx, t, count(*) as k from c where t is not null group by all), g as (select idx, arg_min(t, (-k, t)) as g from m group by idx) select idx, list(round(coalesce(t, g), 9) order by pos) as y from c left join g using (idx) group by idx")
def i_mode(spark, d):
    """Missing entries become the series' most frequent value."""
    return impute.IMPUTERS["mode"](_gappy(spark, d)).select("idx", _R9(F.col("series")).alias("y"))


@query(f"""
with {_E}, c as (select idx, unnest(x) as t, unnest(range(len(x))) as pos from n),
w as (
  select *, last_value(t ignore nulls) over b as a, last_value(case when t is not null then pos end ignore nulls) over b as pa,
    first_value(t ignore nulls) over f as z, first_value(case when t is not null then pos end ignore nulls) over f as pz
  from c window b as (partition by idx order by pos rows between unbounded preceding and current row), f as (partition by idx order by pos rows between current row and unbounded following)
)
select idx, list(round(coalesce(t, case when pa is null then z when pz is null then a else a + (z - a) * (pos - pa) / (pz - pa) end, 0), 9) order by pos) as y from w group by idx
""")
def i_linear(spark, d):
    """Missing entries lie straight between their neighbours."""
    return impute.IMPUTERS["linear"](_gappy(spark, d)).select("idx", _R9(F.col("series")).alias("y"))


@query(f"""
with {_N}, q as (select * from n where len({_OBS}) < 32),
d as (
  select q.idx, r.idx as j, r.x as theirs, list_filter(range(1, 33), lambda k: q.x[k] is not null and r.x[k] is not null) as b, q.x as own from q join n r on r.idx <> q.idx
),
t as (select idx, j, theirs, sqrt(list_sum(list_transform(b, lambda k: pow(own[k] - theirs[k], 2)))) as dist from d where len(b) > 0 qualify row_number() over (partition by idx order by dist, j) <= 5),
g as (select idx, unnest(range(1, 33)) as k from q),
f as (select g.idx, k, coalesce(avg(theirs[k]), 0) as v from g left join t using (idx) group by all),
m as (select idx, list(v order by k) as v from f group by idx)
select n.idx, list_transform(range(1, 33), lambda k: round(coalesce(n.x[k], m.v[k]), 9)) as y from n left join m using (idx)
""")
def i_knn(spark, d):
    """Missing entries become the mean of the 5 nearest series that observe them."""
    return impute.knn_fill(_whole(spark, d)).select("idx", _R9(F.col("series")).alias("y"))


_UPDATE = f"""
with {_N}, {_PROX}, c as (select idx, unnest(x) as t, unnest(range(len(x))) as pos from n),
s as (select idx, list_avg({_OBS}) as start from n),
u as (select a.idx, a.pos, sum(prox * b.t) / sum(prox) as u from c a join p on p.i = a.idx join c b on b.idx = p.j and b.pos = a.pos where a.t is null and b.t is not null group by all)
select idx, list(round(coalesce(t, u, start, 0), 9) order by pos) as y from c left join u using (idx, pos) left join s using (idx) group by idx
"""


@query(_UPDATE)
def i_proximity_update(spark, d):
    """Missing entries become proximity-weighted means of their position."""
    rows = _whole(spark, d)
    return impute.proximity_update(impute.IMPUTERS["mean"](rows), rows, _prox(spark, d)).select("idx", _R9(F.col("series")).alias("y"))


@query(f"""
with {_N}, {_PROX}, fl as materialized (select idx, x, list_transform(x, lambda t: coalesce(t, list_avg({_OBS}), 0)) as y from n),
pr as materialized (select i as idx, j as exemplar_idx, prox, a.y as a, b.y as b from p join fl a on a.idx = i join fl b on b.idx = j where len(list_filter(a.x, lambda t: t is null)) > 0),
{paths_sql("pr")},
st as (select idx, exemplar_idx, unnest(path) as s from w),
u as (select st.idx, s[1] as pos, sum(prox * b.x[s[2]]) / sum(prox) as u from st join pr using (idx, exemplar_idx) join fl a on a.idx = st.idx join fl b on b.idx = st.exemplar_idx where a.x[s[1]] is null and b.x[s[2]] is not null group by all),
c as (select idx, unnest(x) as t, unnest(y) as y, unnest(range(1, len(x) + 1)) as pos from fl)
select idx, list(round(coalesce(t, u, y), 9) order by pos) as y from c left join u using (idx, pos) group by idx
""")
def i_aligned_update(spark, d):
    """The same with values taken where the DTW path passes."""
    rows = _whole(spark, d)
    return impute.aligned_update(impute.IMPUTERS["mean"](rows), rows, _prox(spark, d)).select("idx", _R9(F.col("series")).alias("y"))


@query(f"with {_PROX}, l as (select idx, label from series_1d), w as (select i, b.label, sum(prox) as w from p join l a on a.idx = p.i and a.label is null join l b on b.idx = p.j and b.label is not null group by all) select i as idx, arg_min(label, (-round(w, 9), label)) as value from w group by i")
def i_weighted_mode(spark, d):
    """Missing labels become the proximity-weighted mode."""
    rows = table(spark, d, "series_1d")
    p = _prox(spark, d)
    return impute.weighted_mode(rows.filter("label is null"), rows.filter("label is not null").select("idx", F.col("label").alias("value")), p)


@query("""
with c as (select file_id, list_transform(missing_strings, lambda x: upper(x)) as ms from app_context),
r as (select r.*, ms from (select * from series_multi qualify row_number() over (partition by idx order by arrived_at) = 1) r left join c using (file_id))
select idx, case when not coalesce(list_contains(ms, upper(trim(label, ' ' || chr(9) || chr(10) || chr(13)))), false) then trim(label, ' ' || chr(9) || chr(10) || chr(13)) end as label from r
""")
def i_clean_labels(spark, d):
    """Labels trimmed, missing ones null."""
    return hotdeck.observed_records(table(spark, d, "series_multi"), table(spark, d, "app_context")).select("idx", "label")


# --- graphs ----------------------------------------------------------------------------------

TYPES = ("click", "error", "purchase", "signup", "view")


def _graphs(spark, d) -> DataFrame:
    """(user_id, g): how often each event type follows each other, as a 5 x 5 matrix."""
    step = table(spark, d, "events").withColumn("before", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    cells = [F.sum(((F.col("before") == a) & (F.col("event_type") == b)).cast("int")).cast("double").alias(f"{a}_{b}") for a in TYPES for b in TYPES]
    made = step.groupBy("user_id").agg(*cells)
    row = lambda a: F.array(*[F.coalesce(F.col(f"{a}_{b}"), F.lit(0.0)) for b in TYPES])
    return made.select("user_id", F.array(*[row(a) for a in TYPES]).alias("g"))


_G = f"""
s as (select user_id, event_type as b, lag(event_type) over (partition by user_id order by ts, event_id) as a from events),
k as (select user_id, {', '.join(f"count(*) filter (where a = '{a}' and b = '{b}')::double as {a}_{b}" for a in TYPES for b in TYPES)} from s group by 1),
g as (select user_id, [{', '.join('[' + ', '.join(f'{a}_{b}' for b in TYPES) + ']' for a in TYPES)}] as g from k),
f as (select arg_min(g, user_id) as h from g)
"""


def _graph_pairs(spark, d) -> DataFrame:
    """Every user's graph with the first user's."""
    g = checkpointed(_graphs(spark, d))
    return g.crossJoin(F.broadcast(g.agg(F.min_by("g", "user_id").alias("h"))))


_GRAPHS = {"HammingDistance": "hamming", "ShortestPathDistance": "shortest_path", "GraphletDistance": "graphlet", "WLDistance": "refinement", "WLDistance2": "refinement_cosine", "ApproximateGraphEditDistance": "edit_greedy", "GraphEditDistance": "edit_assigned"}
_EDGE = "(({m}[{i}][{j}] <> 0 or {m}[{j}][{i}] <> 0)::int)"
_TRIPLES = [(i, j, k) for i in range(1, 6) for j in range(i + 1, 6) for k in range(j + 1, 6)]


def _kinds(m: str, n: int) -> str:
    return "(" + " + ".join(f"({_EDGE.format(m=m, i=i, j=j)} + {_EDGE.format(m=m, i=i, j=k)} + {_EDGE.format(m=m, i=j, j=k)} = {n})::int" for i, j, k in _TRIPLES) + ")"


_NODES = "list_transform(range(5), lambda i: {0})"


def _refined_sql(m: str) -> str:
    """Labels of three rounds of refinement of the nodes of a graph without features, with their rounds."""
    near = f"list_filter(range(5), lambda j: {m}[i + 1][j + 1] <> 0)"
    one = _NODES.format(f"len({near})::varchar")
    step = lambda last: _NODES.format(f"{last}[i + 1] || '(' || coalesce(list_aggregate(list_sort(list_transform({near}, lambda j: {last}[j + 1])), 'string_agg', ','), '') || ')'")
    two = step(one)
    return f"list_concat(list_transform({one}, lambda x: '1 ' || x), list_transform({two}, lambda x: '2 ' || x), list_transform({step(two)}, lambda x: '3 ' || x))"


def _lengths_sql(m: str) -> str:
    """Lengths of the shortest paths between different nodes."""
    out = f"list_transform(range(25), lambda k: case when k // 5 = k % 5 then 0.0::double when {m}[k // 5 + 1][k % 5 + 1] <> 0 then {m}[k // 5 + 1][k % 5 + 1] else 'inf'::double end)"
    for _ in range(3):
        out = f"list_transform([{out}], lambda p: list_transform(range(25), lambda k: list_min(list_transform(range(5), lambda q: p[k // 5 * 5 + q + 1] + p[q * 5 + k % 5 + 1]))))[1]"
    return f"list_transform([{out}], lambda p: list_transform(list_filter(range(25), lambda k: k // 5 <> k % 5 and not isinf(p[k + 1])), lambda k: (floor(p[k + 1] * 100 + 0.5) / 100)::varchar))[1]"


def _gap_sql(labels: Callable[[str], str], value: str) -> str:
    """(user_id, d) from the counts a and b of the labels of a user's and the first user's graph."""
    return f"""with {_G}, u as (select user_id, unnest({labels('g')}) as label from g), w as (select unnest({labels('h')}) as label from f),
ca as (select user_id, label, count(*) as a from u group by all), cb as (select label, count(*) as b from w group by all),
every as (select user_id, label from ca union select user_id, label from (select user_id from g), cb),
t as (select user_id, label, coalesce(a, 0) as a, coalesce(b, 0) as b from every left join ca using (user_id, label) left join cb using (label))
select user_id, round({value}, 6) as d from t group by user_id"""


_GRAPH_QUERIES = {
    "edit_greedy": f"""with {_G}, z as (select user_id, g, h, list_transform(g, lambda r: list_sum(r)) as gs, list_transform(h, lambda r: list_sum(r)) as hs from g, f),
t as (select *, list_reduce(list_transform(range(5), lambda k: [k::int]), lambda acc, x: list_append(acc, list_sort(list_transform(list_filter(range(5), lambda j: not list_contains(acc, j::int)), lambda j: {{'c': abs(gs[len(acc) + 1] - hs[j + 1]), 'j': j::int}}))[1].j), []::int[]) as m from z)
select user_id, round(list_sum(list_transform(range(25), lambda k: case when k // 5 = k % 5 then 0
  when g[k // 5 + 1][k % 5 + 1] <> 0 and h[m[k // 5 + 1] + 1][m[k % 5 + 1] + 1] <> 0 then abs(g[k // 5 + 1][k % 5 + 1] - h[m[k // 5 + 1] + 1][m[k % 5 + 1] + 1])
  when (g[k // 5 + 1][k % 5 + 1] <> 0) <> (h[m[k // 5 + 1] + 1][m[k % 5 + 1] + 1] <> 0) then 1 else 0 end)), 6) as d from t""",
    "shortest_path": _gap_sql(_lengths_sql, "sqrt(sum(pow(a - b, 2)))"),
    "refinement": _gap_sql(_refined_sql, "sqrt(sum(pow(a - b, 2)))"),
    "refinement_cosine": _gap_sql(lambda m: f"list_concat(['0', '0', '0', '0', '0'], {_refined_sql(m)})", "1 - sum(a * b) / sqrt(sum(a * a)) / sqrt(sum(b * b))"),
}
_GRAPH_SQL = {
    "hamming": "list_sum(list_transform(range(1, 26), lambda k: abs(g[(k - 1) // 5 + 1][(k - 1) % 5 + 1] - h[(k - 1) // 5 + 1][(k - 1) % 5 + 1])))",
    "graphlet": "sqrt(" + " + ".join(f"pow({_kinds('g', n)} - {_kinds('h', n)}, 2)" for n in (1, 2, 3)) + ")",
}


def _graph_query(name: str, short: str) -> None:
    def run(spark, d):
        return _graph_pairs(spark, d).select("user_id", F.round(D.distance(name, F.col("g"), F.col("h")), 6).alias("d"))

    run.__name__ = f"g_{short}"
    query(f"with {_G} select user_id, round({_GRAPH_SQL[short]}, 6) as d from g, f" if short in _GRAPH_SQL else _GRAPH_QUERIES.get(short))(run)


for _name, _short in _GRAPHS.items():
    _graph_query(_name, _short)


# --- model-based distances, sources, streams -------------------------------------------------


@query(f"with {_V}, p as (select v.*, case when list_avg(x) > 0 then 'up' else 'down' end as c from v) select p.idx, e.exemplar_idx, (c <> case when list_avg(series) > 0 then 'up' else 'down' end)::int::double as d from p join exemplars e using (file_id)")
def m_class_mismatch(spark, d):
    """0/1 distance by a model's class, the model seen once a row."""
    predict = lambda s: s.map(lambda x: "up" if sum(x) / len(x) > 0 else "down")
    own = meta.with_predictions(_series(spark, d).select("idx", "file_id", "series"), predict, "string")
    other = meta.with_predictions(table(spark, d, "exemplars").select("exemplar_idx", "file_id", "series"), predict, "string")
    return own.join(broadcast_if_small(other.select("exemplar_idx", "file_id", F.col("predicted").alias("p")), 10_000), "file_id").select("idx", "exemplar_idx", meta.class_mismatch(F.col("predicted"), F.col("p")).alias("d"))


@query(f"with {_V} select v.idx, e.exemplar_idx, round(abs(list_max(x) - list_max(series)), 6) as d from v join exemplars e using (file_id)")
def m_regression(spark, d):
    """Distance by a model's value."""
    predict = lambda s: s.map(max).astype(float)
    own = meta.with_predictions(_series(spark, d).select("idx", "file_id", "series"), predict, "double")
    other = meta.with_predictions(table(spark, d, "exemplars").select("exemplar_idx", "file_id", "series"), predict, "double")
    return own.join(broadcast_if_small(other.select("exemplar_idx", "file_id", F.col("predicted").alias("p")), 10_000), "file_id").select("idx", "exemplar_idx", F.round(meta.regression_distance(F.col("predicted"), F.col("p")), 6).alias("d"))


@query(f"with {_V}, p as (select idx, file_id, len(list_filter(x, lambda t: t > 0)) / len(x) as s from v), e as (select exemplar_idx, file_id, len(list_filter(series, lambda t: t > 0)) / len(series) as r from exemplars) select idx, exemplar_idx, round(1 - (s * r + (1 - s) * (1 - r)) / (sqrt(s * s + (1 - s) * (1 - s)) * sqrt(r * r + (1 - r) * (1 - r))), 6) as d from p join e using (file_id)")
def m_probability(spark, d):
    """Distance by a model's class probabilities (here the shares of positive entries and of others)."""
    predict = lambda s: s.map(lambda x: [float((x > 0).mean()), float(1 - (x > 0).mean())])
    own = meta.with_predictions(_series(spark, d).select("idx", "file_id", "series"), predict, "array<double>")
    other = meta.with_predictions(table(spark, d, "exemplars").select("exemplar_idx", "file_id", "series"), predict, "array<double>")
    return own.join(broadcast_if_small(other.select("exemplar_idx", "file_id", F.col("predicted").alias("p")), 10_000), "file_id").select("idx", "exemplar_idx", F.round(meta.probability_distance(F.col("predicted"), F.col("p")), 6).alias("d"))


def _by_idx(spark, d, value):
    """Pairs of the proximity table with predictions a and b given by idx."""
    given = table(spark, d, "series_1d").filter("series is not null and size(series) > 0").select("idx", value.alias("value"))
    pairs = table(spark, d, "sparse_proximities").filter("prox > 0 and prox <= 1").select("i", "j").distinct()
    one = meta.with_file_predictions(pairs.withColumn("idx", F.col("i")), given, "value", "a").drop("idx")
    return meta.with_file_predictions(one.withColumn("idx", F.col("j")), given, "value", "b")


_GIVEN = "q as (select distinct i, j from sparse_proximities where prox > 0 and prox <= 1), y as (select idx, len(list_filter(series, lambda t: t > 0 and not isnan(t)))::double as v, len(series) as n from series_1d where len(series) > 0)"


@query(f"with {_GIVEN} select i, j, round(abs(a.v - b.v), 6) as d from q left join y a on a.idx = i left join y b on b.idx = j")
def m_file_regression(spark, d):
    """Distance of the pairs of the proximity table by numbers given by idx (here the positive entries)."""
    positive = F.size(F.filter("series", lambda v: (v > 0) & ~F.isnan(v))).cast("double")
    return _by_idx(spark, d, positive).select("i", "j", F.round(meta.regression_distance(F.col("a"), F.col("b")), 6).alias("d"))


@query(f"with {_GIVEN}, z as (select idx, v / n as s from y) select i, j, round(1 - (a.s * b.s + (1 - a.s) * (1 - b.s)) / (sqrt(a.s * a.s + (1 - a.s) * (1 - a.s)) * sqrt(b.s * b.s + (1 - b.s) * (1 - b.s))), 6) as d from q left join z a on a.idx = i left join z b on b.idx = j")
def m_file_probability(spark, d):
    """Distance of the pairs of the proximity table by class probabilities given by idx."""
    share = F.size(F.filter("series", lambda v: (v > 0) & ~F.isnan(v))) / F.size("series")
    return _by_idx(spark, d, F.array(share, 1 - share)).select("i", "j", F.round(meta.probability_distance(F.col("a"), F.col("b")), 6).alias("d"))


@query("with q as (select i, j, max(prox) as p from sparse_proximities where prox > 0 and prox <= 1 group by all) select i, j, (a.label <> b.label)::int::double as d from q left join series_1d a on a.idx = i left join series_1d b on b.idx = j")
def m_file_class_mismatch(spark, d):
    """0/1 distance of the pairs of the proximity table by predictions given by idx."""
    given = table(spark, d, "series_1d").select("idx", "label")
    pairs = table(spark, d, "sparse_proximities").filter("prox > 0 and prox <= 1").select("i", "j").distinct()
    one = meta.with_file_predictions(pairs.withColumn("idx", F.col("i")), given, "label", "a").drop("idx")
    two = meta.with_file_predictions(one.withColumn("idx", F.col("j")), given, "label", "b")
    return two.select("i", "j", meta.class_mismatch(F.col("a"), F.col("b")).alias("d"))


@query(f"with {_V} select idx, label, list_transform(x, lambda t: t::double) as series from v")
def io_write_and_read(spark, d):
    """Series written as text with inline labels and read back."""
    path = f"{folder(spark)}/lines"
    rows = _series(spark, d)
    line = F.concat_ws("\t", F.col("idx").cast("string"), F.coalesce("label", F.lit("?")), delimited.series_text(F.col("series"), False, "\t"))
    rows.select(line.alias("value")).write.text(path)
    layout = delimited.Layout(entry_separator="\t", missing_strings=("?",), is_numeric=False)
    parsed, _ = delimited.read_delimited(spark, path, layout)
    at = lambda i: F.get("series", F.lit(i))
    return parsed.select(at(0)["num"].cast("bigint").alias("idx"), F.coalesce(at(1)["str"], at(1)["num"].cast("bigint").cast("string")).alias("label"), F.transform(F.slice("series", 3, 1_000_000_000), lambda t: t["num"]).alias("series"))


@query(f"with {_LINES} select date_trunc('day', received_at)::timestamp as day, coalesce(reason, 'loaded') as outcome, count(*) as n_lines from r join raw_lines using (line_id) group by all")
def st_outcomes(spark, d):
    """Lines by day and outcome, parsed as a stream."""
    return _streamed(spark, d)


def _streamed(spark, d):
    lines = table(spark, d, "raw_lines")
    alone = lines.inputFiles()[0].endswith("/raw_lines.parquet")  # else a folder of part files
    reader = spark.readStream.schema(lines.schema)
    source = reader.option("pathGlobFilter", "raw_lines.parquet").parquet(d) if alone else reader.parquet(f"{d}/raw_lines.parquet")
    name = f"outcomes_{uuid.uuid4().hex}"
    found = scoring.outcomes(source, table(spark, d, "app_context"))
    run = found.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{folder(spark)}/stream").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


@query()
def n_exact_neighbours(spark, d):
    """The 5 nearest of every series whose idx is divisible by 100, against all, exactly."""
    rows = _series(spark, d).filter("size(series) = 32")
    return knn.exact_nearest(rows.filter("idx % 100 = 0"), rows)


SQL["n_exact_neighbours"] = """
with v as (select idx, series from series_1d where len(series) = 32 and len(list_filter(series, lambda x: x is null or isnan(x))) = 0)
select a.idx, b.idx as neighbour, list_distance(a.series, b.series) as distance, (row_number() over (partition by a.idx order by list_distance(a.series, b.series), b.idx))::int as place
from v a join v b on a.idx <> b.idx where a.idx % 100 = 0 qualify place <= 5
"""
