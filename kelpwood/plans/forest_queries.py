"""Queries of whole forests over whole tables, with SQL that grows the same forests level by level.

Every random choice of a forest is the hash of the seed and its place, so SQL can draw the same samples,
exemplars and measures. The SQL is written out here for every level up to the depth limit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpwood.functions import mixed
from kelpwood.functions import series as S
from kelpwood.operators import forest as FO
from kelpwood.operators import impute, proximity
from kelpwood.operators import purity as P
from kelpwood.operators.parse_failures import load_valid
from kelpwood.plans.distance_queries import valid
from kelpwood.plans.problems import _LINES
from kelpwood.session import folder, table
from kelpwood.sources.delimited import tagged
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


OPTIONS = {"n_trees": 3, "n_candidates": 2, "distances": ("euclidean", "manhattan"), "max_depth": 4, "seed": 1}
REGRESSION = {**OPTIONS, "task": "regression", "purity": "variance", "max_depth": 3}
IMPUTATION = {"n_trees": 2, "n_candidates": 1, "distances": ("euclidean",), "max_depth": 3, "impute_iterations": 1, "seed": 2}
_MODELS: dict = {}


def _rows(spark: SparkSession, d: str, regression: bool = False) -> DataFrame:
    """All whole series of 32 entries."""
    rows = table(spark, d, "series_1d").filter(valid(F.col("series")) & (F.size("series") == 32)).select("idx", "label", "series")
    return rows.withColumn("label", S.mean(F.col("series")) + F.get("series", F.lit(0))) if regression else rows


def _forest(spark: SparkSession, d: str, options: dict) -> tuple[FO.ForestModel, DataFrame]:
    """The forest over all labelled whole series of a folder, trained once a session."""
    key = (spark.sparkContext.applicationId, d, tuple(sorted(options.items())))
    rows = _rows(spark, d, options.get("task") == "regression")
    if key not in _MODELS:
        _MODELS[key] = FO.fit(rows, FO.ForestConfig(**options))
    return _MODELS[key], rows


# --- SQL -------------------------------------------------------------------------------------


def _draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::bigint"


_LENGTHS = {"euclidean": "list_sum(list_transform(range(1, 33), lambda k: pow(x[k] - ex[k], 2)))", "manhattan": "list_sum(list_transform(range(1, 33), lambda k: abs(x[k] - ex[k])))"}
_WHOLE = """
v as materialized (
  select idx, label, series as x from series_1d
  where len(series) = 32 and len(list_filter(series, lambda t: t is null or isnan(t))) = 0
)"""
_MEASURED = """
v as materialized (
  select idx, list_avg(series) + series[1] as label, series as x from series_1d
  where len(series) = 32 and len(list_filter(series, lambda t: t is null or isnan(t))) = 0
)"""


def forest_sql(values: str, options: dict) -> str:
    """CTEs of a forest: nodes, splits (measure and exemplars of the inner nodes), membership; ``values`` defines v(idx,
    label, x)."""
    seed, trees, cands, names, deep = (options[k] for k in ("seed", "n_trees", "n_candidates", "distances", "max_depth"))
    numeric = options.get("task") == "regression"
    length = "case m " + " ".join(f"when {k} then {_LENGTHS[n]}" for k, n in enumerate(names)) + " end"
    out = [
        values,
        "tr as materialized (select idx, label, x from v where label is not null and idx is not null)",
        "pl as materialized (select idx, row_number() over (order by idx) - 1 as place, count(*) over () as n from tr)",
        f"mu as (select t as tree, place, count(*) as mult from (select t, {_draw(f'{seed}', chr(39) + 'bag' + chr(39), 't', 'place')} % n as place from pl, range({trees}) r(t)) group by all)",
        f"s0 as materialized (select t::int as tree, 'r' as node, pl.idx, label, coalesce(mult, 0) as mult, mult is null as oob from pl join tr using (idx) cross join range({trees}) r(t) left join mu on mu.tree = t and mu.place = pl.place)",
    ]
    for d in range(deep + 1):
        if numeric:
            mean = f"select *, sum(mult * label) over w / sum(mult) over w as mean from s{d} where not oob window w as (partition by tree, node)"
            out.append(f"p{d} as materialized (select tree, node, sum(mult)::bigint as n, sum(mult * pow(label - mean, 2)) / sum(mult) as purity, any_value(mean) as prediction from ({mean}) group by all)")
        else:
            share = f"select *, n / sum(n) over (partition by tree, node) as p from (select tree, node, label, sum(mult) as n from s{d} where not oob group by all)"
            out.append(f"p{d} as materialized (select tree, node, sum(n)::bigint as n, 1 - sum(p * p) as purity, arg_min(label, (-n, label)) as prediction from ({share}) group by all)")
        if d == deep:
            break
        key = lambda *parts: _draw(f"{seed}", "'ex'", "tree", "node", *parts, "idx")  # noqa: B023, E731
        active = f"(select s.*, c from s{d} s join p{d} using (tree, node) cross join range({cands}) r(c) where not oob and purity > 1e-6)"
        if numeric:
            out.append(f"e{d} as (select tree, node, c, b as branch, arg_min(idx, ({key('c', 'b')}, idx)) as eidx from {active} cross join range(2) q(b) group by all)")
            out.append(f"x{d} as materialized (select tree, node, c, branch, eidx, x as ex, {_draw(f'{seed}', chr(39) + 'measure' + chr(39), 'tree', 'node', 'c')} % {len(names)} as m from e{d} join v on v.idx = eidx)")
        else:
            out.append(f"e{d} as (select tree, node, c, label, arg_min(idx, ({key('c', 'label')}, idx)) as eidx from {active} group by all)")
            out.append(f"x{d} as materialized (select tree, node, c, row_number() over (partition by tree, node, c order by e.label) - 1 as branch, eidx, x as ex, {_draw(f'{seed}', chr(39) + 'measure' + chr(39), 'tree', 'node', 'c')} % {len(names)} as m from e{d} e join v on v.idx = eidx)")
        tie = f"md5(concat_ws('|', '{seed}', 'tie', tree, node, c, branch, idx))"
        far = f"select s.*, c, branch, case when idx = eidx then -1 else {length} end as d from (select s.*, v.x from s{d} s join v using (idx)) s join x{d} using (tree, node)"
        out.append(f"t{d} as materialized (select * exclude (d, x) from ({far}) qualify row_number() over (partition by tree, node, c, idx order by d, {tie}) = 1)")
        if numeric:
            mean = f"select *, sum(mult * label) over w / sum(mult) over w as mean from t{d} where not oob window w as (partition by tree, node, c, branch)"
            parts = f"select tree, node, c, branch, sum(mult) as n, sum(mult * pow(label - mean, 2)) / sum(mult) as purity from ({mean}) group by all"
        else:
            share = f"select *, n / sum(n) over (partition by tree, node, c, branch) as p from (select tree, node, c, branch, label, sum(mult) as n from t{d} where not oob group by all)"
            parts = f"select tree, node, c, branch, sum(n) as n, 1 - sum(p * p) as purity from ({share}) group by all"
        wanted = f"(select tree, node, c, count(*) as k from x{d} group by all)"
        split = f"select tree, node, c, count(*) as branches, sum(n * purity) / sum(n) as weighted from ({parts}) group by all"
        out.append(f"o{d} as materialized (select tree, node, arg_min(c, (round(weighted, 12), c)) as c from ({split}) join {wanted} using (tree, node, c) where branches = k and k > 1 group by all)")
        out.append(f"s{d + 1} as materialized (select tree, node || '.' || branch as node, idx, label, mult, oob from t{d} join o{d} using (tree, node, c))")
    inner = lambda d: f"(tree, node) in (select (tree, node) from o{d})" if d < deep else "false"
    levels = range(deep + 1)
    out.append("nodes as materialized (" + " union all ".join(f"select tree, node, {d} as depth, not {inner(d)} as is_leaf, n, purity, prediction from p{d}" for d in levels) + ")")
    out.append("splits as materialized (" + " union all ".join(f"select x.* exclude (c) from x{d} x join o{d} using (tree, node, c)" for d in range(deep)) + ")")
    out.append("membership as materialized (" + " union all ".join(f"select tree, node, idx, mult, oob from s{d} where not {inner(d)}" for d in levels) + ")")
    return "with " + ",\n".join(out)


def route_sql(options: dict, rows: str) -> str:
    """CTE places(tree, node, idx): the leaves of ``rows``, a selection of idx."""
    length = "case m " + " ".join(f"when {k} then {_LENGTHS[n]}" for k, n in enumerate(options["distances"])) + " end"
    tie = f"md5(concat_ws('|', '{options['seed']}', 'tie', tree, node, branch, idx))"
    out = [f"r0 as materialized (select t::int as tree, 'r' as node, idx, x from v cross join range({options['n_trees']}) r(t) where idx in ({rows}))"]
    for d in range(options["max_depth"]):
        far = f"select r.*, branch, case when idx = eidx then -1 else {length} end as d from r{d} r join splits using (tree, node)"
        out.append(f"r{d + 1} as materialized (select tree, node || '.' || branch as node, idx, x from ({far}) qualify row_number() over (partition by tree, node, idx order by d, {tie}) = 1)")
    out.append("places as materialized (" + " union all ".join(f"select tree, node, idx from r{d} where (tree, node) in (select (tree, node) from nodes where is_leaf)" for d in range(options["max_depth"] + 1)) + ")")
    return ",\n" + ",\n".join(out)


_VOTES = ", votes as (select idx, prediction, count(*) as n from places join nodes using (tree, node) group by all), predicted as (select idx, arg_min(prediction, (-n, prediction)) as prediction from votes group by idx)"
_GROWN = forest_sql(_WHOLE, OPTIONS)
_PREDICTED = _GROWN + route_sql(OPTIONS, "select idx from v") + _VOTES
_PER_TREE = "select tree, count(*) as n_nodes, sum(is_leaf::int)::bigint as n_leaves, sum((not is_leaf)::int)::bigint as n_inner, max(depth)::int as height, min(case when is_leaf then depth end)::int as least_depth from nodes group by tree"


def prox_sql(places: str) -> str:
    """CTE prox(i, j, prox) of places(tree, node, i)."""
    return f""", pi as (select tree, node, idx as i from {places}), nt as (select i, count(*) as n_trees from pi group by i),
sh as (select tree, node, idx as j, mult / sum(mult) over (partition by tree, node) as share from membership where not oob),
prox as (select * from (select i, j, sum(share) / any_value(n_trees) as prox from pi join sh using (tree, node) join nt using (i) group by i, j) where prox > 1e-6)"""


_PROX = prox_sql("(select * from membership where oob)")


@query(f"{_PREDICTED} select idx, prediction from predicted")
def f_predict(spark, d):
    """Votes of a forest for every series."""
    model, rows = _forest(spark, d, OPTIONS)
    return model.transform(rows)


@query(f"{_PREDICTED} select round(avg(case when label is not null then (label = prediction)::int end), 9) as accuracy, round(1 - avg(case when label is not null then (label = prediction)::int end), 9) as error_rate, count(label) as n from predicted join v using (idx)")
def f_accuracy(spark, d):
    """Accuracy of a forest on its own rows."""
    model, rows = _forest(spark, d, OPTIONS)
    found = P.accuracy(model.transform(rows).join(rows.select("idx", "label"), "idx"))
    return found.select(F.round("accuracy", 9).alias("accuracy"), F.round("error_rate", 9).alias("error_rate"), "n")


_REGRESSED = forest_sql(_MEASURED, REGRESSION) + route_sql(REGRESSION, "select idx from v")


@query(f"{_REGRESSED}, y as (select idx, avg(prediction) as p from places join nodes using (tree, node) group by idx), z as (select label, p, avg(label) over () as m from y join v using (idx)) select round(1 - sum(pow(label - p, 2)) / sum(pow(label - m, 2)), 6) as r2, round(avg(abs(label - p)), 6) as mae, count(*) as n from z")
def f_regression(spark, d):
    """R2 of a regression forest on its own rows."""
    model, rows = _forest(spark, d, REGRESSION)
    found = P.r_squared(model.transform(rows).join(rows.select("idx", "label"), "idx"))
    return found.select(F.round("r2", 6).alias("r2"), F.round("mae", 6).alias("mae"), "n")


@query(f"{_GROWN} select tree, node, depth, is_leaf, n, round(purity, 9) as purity, prediction from nodes")
def f_nodes(spark, d):
    """Nodes of the forest with size, purity and prediction."""
    return _forest(spark, d, OPTIONS)[0].nodes.select("tree", "node", "depth", "is_leaf", "n", F.round("purity", 9).alias("purity"), "prediction")


@query(f"{_GROWN} select tree, node, branch::int as branch, eidx as idx, ['euclidean', 'manhattan'][m + 1] as measure from splits")
def f_exemplars(spark, d):
    """Exemplars and measure of every inner node."""
    model = _forest(spark, d, OPTIONS)[0]
    return model.exemplars.join(model.nodes.select("tree", "node", "measure"), ["tree", "node"]).select("tree", "node", "branch", "idx", "measure")


@query(f"{_GROWN} {_PER_TREE}")
def f_tree_stats(spark, d):
    """Nodes, leaves and depths of the trees."""
    return _forest(spark, d, OPTIONS)[0].tree_stats()


@query(f"{_GROWN}, per as ({_PER_TREE}) select round(avg(n_nodes), 9) as mean_nodes, round(stddev_pop(n_nodes), 9) as sd_nodes, round(avg(height), 9) as mean_height, round(stddev_pop(height), 9) as sd_height from per")
def f_forest_stats(spark, d):
    """Mean and deviation of the trees' sizes and heights."""
    found = _forest(spark, d, OPTIONS)[0].forest_stats()
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@query(f"{_GROWN} {_PROX} select i, j, round(prox, 9) as prox from prox")
def f_proximities(spark, d):
    """Proximities of the training rows of a forest."""
    return proximity.train_proximities(_forest(spark, d, OPTIONS)[0]).withColumn("prox", F.round("prox", 9))


@query(f"{_GROWN} {route_sql(OPTIONS, 'select idx from v where label is null')} {prox_sql('places')} select i, j, round(prox, 9) as prox from prox")
def f_proximities_of_others(spark, d):
    """Proximities of the unlabelled series to the training rows."""
    model, rows = _forest(spark, d, OPTIONS)
    return proximity.test_proximities(model, rows.filter("label is null")).withColumn("prox", F.round("prox", 9))


@query(f"""{_GROWN} {_PROX},
sq as (select i as idx, sum(prox * prox) as s from prox join tr a on a.idx = i join tr b on b.idx = j where a.label = b.label group by 1),
ra as (select v.idx, v.label, (select count(*) from v) / coalesce(nullif(s, 0), 1e-6) as raw from v left join sq using (idx) where label is not null),
fo as (select *, abs(raw - median(raw) over (partition by label)) as off from ra),
sp as (select *, avg(off) over (partition by label) as spread from fo)
select idx, label, round(raw, 3) as raw, round(case when spread > 0 then off / spread end, 6) as score from sp""")  # fmt: skip
def f_outliers(spark, d):
    """Outlier scores from the forest's own proximities."""
    model, rows = _forest(spark, d, OPTIONS)
    found = proximity.forest_outlier_scores(model, rows)
    return found.select("idx", "label", F.round("raw", 3).alias("raw"), F.round("score", 6).alias("score"))


@query(f"{_PREDICTED} select idx, prediction from predicted")
def f_save_and_load(spark, d):
    """A saved forest gives the same predictions."""
    model, rows = _forest(spark, d, OPTIONS)
    path = f"{folder(spark)}/model"
    model.save(path)
    return FO.ForestModel.load(spark, path).transform(rows)


@query(f"{_PREDICTED} select idx, prediction from predicted")
def st_scores(spark, d):
    """The series scored as a stream by the forest, micro-batch by micro-batch."""
    model, _ = _forest(spark, d, OPTIONS)
    whole = table(spark, d, "series_1d")
    alone = whole.inputFiles()[0].endswith("/series_1d.parquet")  # else a folder of part files
    reader = spark.readStream.schema(whole.schema)
    source = reader.option("pathGlobFilter", "series_1d.parquet").parquet(d) if alone else reader.parquet(f"{d}/series_1d.parquet")
    path = folder(spark)
    scoring.score(model, source.filter(valid(F.col("series")) & (F.size("series") == 32)).select("idx", "series"), path, folder(spark)).awaitTermination()
    return spark.read.parquet(path).select("idx", "prediction")


@query()
def f_default(spark, d):
    """Predictions of a forest with all defaults: 11 trees, 5 candidates, all 11 measures, no limit of depth."""
    rows = _rows(spark, d)
    return FO.fit(rows).transform(rows)


_GAPS = """
n as (select idx, label, list_transform(series, lambda t: case when not isnan(t) then t end) as o from series_1d where len(series) = 32),
v as materialized (select idx, label, list_transform(o, lambda t: coalesce(t, list_avg(list_filter(o, lambda u: u is not null)), 0)) as x from n)"""
_FILLED = """,
ce as (select idx, unnest(o) as t, unnest(range(len(o))) as pos from n),
up as (select a.idx, a.pos, sum(prox * b.t) / sum(prox) as u from ce a join prox p on p.i = a.idx join ce b on b.idx = p.j and b.pos = a.pos where a.t is null and b.t is not null group by all),
fi as (select ce.idx, list(round(coalesce(t, u, v.x[pos + 1]), 6) order by pos) as series from ce join v using (idx) left join up using (idx, pos) group by ce.idx)"""


def _gappy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "series_1d").filter("series is not null and size(series) = 32").select("idx", "label", impute.with_nulls(F.col("series")).alias("series"))


@query(f"{forest_sql(_GAPS, IMPUTATION)} {_PROX} {_FILLED} select idx, series from fi")
def i_forest(spark, d):
    """The whole iteration: initial imputer, forest, proximities, update, final forest."""
    found = impute.forest_impute(_gappy(spark, d), FO.ForestConfig(**IMPUTATION))[1]
    return found.select("idx", F.transform("series", lambda v: F.round(v, 6)).alias("series"))


@query(f"{forest_sql(_GAPS.replace('select idx, label, list_transform(series', 'select idx, case when idx % 5 <> 0 then label end as label, list_transform(series'), IMPUTATION)} {route_sql(IMPUTATION, 'select idx from v where idx % 5 = 0')} {prox_sql('places')} {_FILLED.replace('b.t is not null', 'b.t is not null and a.idx % 5 = 0 and b.idx % 5 <> 0')} select idx, series from fi where idx % 5 = 0")
def i_forest_others(spark, d):
    """Test rows (every fifth idx) filled by the proximities to the training rows (all others)."""
    rows = _gappy(spark, d)
    found = impute.forest_impute_others(rows.filter("idx % 5 <> 0"), FO.ForestConfig(**IMPUTATION), rows.filter("idx % 5 = 0"))
    return found.select("idx", F.transform("series", lambda v: F.round(v, 6)).alias("series"))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    """(idx, file_id, label, series): the valid lines of the files that aren't numeric, with tagged entries."""
    lines = table(spark, d, "raw_lines").select("line_id", "file_id", "line_no", "raw_line")
    files = table(spark, d, "app_context").filter("not is_numeric")
    good = load_valid(lines.join(F.broadcast(files.select("file_id").distinct()), "file_id", "left_semi"), files)  # one row a file
    return good.select(F.col("line_id").alias("idx"), "file_id", "label", F.transform(F.get("tokens", F.lit(0)), tagged).alias("series"))


def _shown(e: F.Column) -> F.Column:
    """An entry as text: its kind and itself, a number to six places."""
    return F.when(e["num"].isNotNull(), F.concat(F.lit("n "), F.round(e["num"] * 1_000_000).cast("bigint").cast("string"))).when(e["bool"].isNotNull(), F.concat(F.lit("b "), e["bool"].cast("string"))).otherwise(F.concat(F.lit("s "), e["str"]))


@query(f"""with {_LINES},
ea as (select line_id, file_id, ms, lab, target_column, regexp_extract_all(t || entry_separator, '(' || ent || ')' || e, 1) as en from w join r using (line_id, file_id) where reason is null and not is_numeric),
eb as (select *, list_transform(case when lab = 0 then en when target_column = 'first' then en[2:] else en[:-2] end, lambda x: trim(x, ' ' || chr(9))) as own from ea),
eu as (select *, list_transform(own, lambda x: case when x like '"%' then trim(replace(x[2:-2], '""', '"'), ' ' || chr(9)) else x end) as trimmed from eb),
ec as (select line_id as idx, file_id, unnest(trimmed) as x, unnest(range(len(trimmed))) as pos, ms from eu),
ek as (select idx, file_id, pos, case when list_contains(ms, upper(x)) then null else x end as x, try_cast(x as double) as num from ec),
ee as (select idx, file_id, pos, case when x is null then null when num is not null then 0 when lower(x) in ('true', 'false') then 1 else 2 end as kind, num, lower(x) = 'true' as flag, x from ek),
es as (select idx, file_id, pos, case kind when 0 then 'n ' || (round(num * 1000000)::bigint)::varchar when 1 then 'b ' || flag::varchar when 2 then 's ' || x end as shown,
  (case when kind = 0 then num end) as num, (case when kind = 1 then flag end) as flag, (case when kind = 2 then x end) as txt from ee),
en2 as (select file_id, pos, shown, any_value(num) as num, any_value(flag) as flag, any_value(txt) as txt, count(*) as n from es where shown is not null group by all),
em as (select file_id, pos, shown as best from en2 qualify row_number() over (partition by file_id, pos order by n desc, num nulls first, flag nulls first, txt nulls first) = 1)
select idx, file_id, list(coalesce(shown, best) order by pos) as y from es left join em using (file_id, pos) group by idx, file_id""")  # fmt: skip
def i_mixed_mode(spark, d):
    """Missing entries of mixed instances become the most frequent entry of their file and position."""
    return impute.mixed_mode(_mixed(spark, d), ("file_id",)).select("idx", "file_id", F.transform("series", _shown).alias("y"))


@query()
def i_mixed_forest(spark, d):
    """The whole iteration over mixed instances of one length: modes, forest on the mixed distance, weighted modes."""
    rows = _mixed(spark, d).filter("file_id = 13").drop("file_id")
    found = impute.forest_impute_mixed(rows, FO.ForestConfig(n_trees=3, n_candidates=2, max_depth=4, impute_iterations=1))[1]
    return found.select("idx", F.transform("series", _shown).alias("y"))


@query()
def f_mixed(spark, d):
    """Predictions of a forest on mixed instances, files apart by length."""
    rows = mixed.encoded(impute.mixed_mode(_mixed(spark, d), ("file_id",)).filter(~F.exists("series", lambda e: e.isNull())))
    return FO.fit(rows.select("idx", "label", "series"), FO.ForestConfig(n_trees=3, n_candidates=2, max_depth=4, distances=("mixed",))).transform(rows)
