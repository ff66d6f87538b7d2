"""Distances of every series to the exemplars of its file, and of multivariate records to their file's
first record, with SQL that spells each recurrence out on its own."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpwood.functions import distances as D
from kelpwood.functions import series as S
from kelpwood.session import broadcast_if_small, parallelism, table

MOST_EXEMPLARS = 10_000


def valid(x: F.Column) -> F.Column:
    return (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v))


def pairs_1d(spark: SparkSession, d: str, heavy: bool = False) -> DataFrame:
    """(idx, exemplar_idx, a, b): each valid series with the exemplars of its file."""
    exemplars = broadcast_if_small(table(spark, d, "exemplars").select("file_id", "exemplar_idx", F.col("series").alias("b")), MOST_EXEMPLARS)
    rows = table(spark, d, "series_1d").filter(valid(F.col("series"))).select("idx", "file_id", F.col("series").alias("a"))
    return (_dealt(rows) if heavy else rows).join(exemplars, "file_id").select("idx", "exemplar_idx", "a", "b")


def records_2d(spark: SparkSession, d: str) -> DataFrame:
    """(idx, file_id, series): multivariate records once, null and NaN entries 0."""
    once = table(spark, d, "series_multi").filter("series is not null").groupBy("idx").agg(F.min_by(F.struct("file_id", "series"), "arrived_at").alias("r"))
    return once.select("idx", "r.file_id", F.transform("r.series", lambda c: F.transform(c, lambda v: F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v))).alias("series"))


def pairs_2d(spark: SparkSession, d: str) -> DataFrame:
    """(idx, a, b): each record with the first record of its file."""
    rows = records_2d(spark, d)
    first = rows.groupBy(F.col("file_id").alias("f")).agg(F.min_by("series", "idx").alias("b"))
    return rows.join(broadcast_if_small(first, MOST_EXEMPLARS), F.col("file_id") == F.col("f")).select("idx", F.col("series").alias("a"), "b")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows over all tasks: they are small, the work on a pair is not."""
    return rows.repartition(parallelism(rows.sparkSession), "idx")


def _pairs(name: str, params: dict, digits: int, spark: SparkSession, d: str) -> DataFrame:
    if D.get(name).multi:
        p, keys = pairs_2d(spark, d), ["idx"]
    else:
        p, keys = pairs_1d(spark, d, D.get(name).column is None), ["idx", "exemplar_idx"]
    return p.select(*keys, F.round(D.distance(name, F.col("a"), F.col("b"), **params), digits).alias("d"))


USED = {
    "euclidean": {}, "manhattan": {}, "cosine": {}, "cid": {}, "sbd": {}, "dtw": {}, "dtwcv": {"w": 4}, "ddtw": {}, "ddtwcv": {"w": 4}, "wdtw": {"g": 0.1}, "wddtw": {"g": 0.1},
    "lcss": {"epsilon": 0.4, "delta": 5}, "erp": {"g": 0.3, "w": 6}, "msm": {"c": 0.5}, "twe": {"nu": 0.01, "lam": 0.05}, "shapeHoG1dDTW": {},
}
USED_2D = {"dtw_d": {}, "ddtw_d": {}, "wdtw_d": {"g": 0.1}, "wddtw_d": {"g": 0.1}, "shapeHoGdtw_d": {}, "dtw_i": {}, "ddtw_i": {}, "wdtw_i": {"g": 0.1}, "wddtw_i": {"g": 0.1}, "lcss_i": {"epsilon": 0.4, "delta": 5}, "erp_i": {"g": 0.3, "w": 30}, "msm_i": {"c": 0.5}, "twe_i": {"nu": 0.01, "lam": 0.05}, "euclidean_i": {}, "manhattan_i": {}, "cid_i": {}, "sbd_i": {}, "shapeHoG1dDTW_i": {}}


def cosine_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Cosine similarity of every series to its file's exemplars."""
    return pairs_1d(spark, d).select("idx", "exemplar_idx", F.round(S.cosine_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


def masked_euclidean(spark: SparkSession, d: str) -> DataFrame:
    """Squared distance over the observed positions, of all series of 32 entries, to their file's exemplars."""
    exemplars = broadcast_if_small(table(spark, d, "exemplars").select("file_id", "exemplar_idx", F.col("series").alias("b")), MOST_EXEMPLARS)
    gaps = F.transform("series", lambda v: F.when(~F.isnan(v), v))
    rows = table(spark, d, "series_1d").filter("size(series) = 32").select("idx", "file_id", gaps.alias("a"))
    return rows.join(exemplars, "file_id").select("idx", "exemplar_idx", F.round(D.masked(F.col("a"), F.col("b"), S.squared_euclidean), 6).alias("d"))


def nearest_exemplar(spark: SparkSession, d: str) -> DataFrame:
    """The nearest exemplar of every series by DTW; ties go to the smaller exemplar."""
    p = pairs_1d(spark, d, True).withColumn("d", D.distance("dtw", F.col("a"), F.col("b")))
    best = p.groupBy("idx").agg(F.min(F.struct("d", "exemplar_idx")).alias("m"))
    return best.select("idx", F.col("m.exemplar_idx").alias("exemplar_idx"), F.round("m.d", 6).alias("d"))


def alignment(spark: SparkSession, d: str) -> DataFrame:
    """The DTW alignment path of every series with its file's exemplars, place by place."""
    p = pairs_1d(spark, d, True).select("idx", "exemplar_idx", D.alignment_path("a", "b").alias("at"))
    return p.select("idx", "exemplar_idx", F.transform("at", lambda s: F.concat_ws(" ", s["i"].cast("string"), s["j"].cast("string"))).alias("path"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"d_{n.lower()}": partial(_pairs, n, p, 6) for n, p in USED.items()},
    **{f"d_{n.lower()}": partial(_pairs, n, p, 3 if n == "euclidean_i" else 9) for n, p in USED_2D.items()},
    "d_cosine_similarity": cosine_similarity,
    "d_masked_euclidean": masked_euclidean,
    "d_nearest_exemplar": nearest_exemplar,
    "d_alignment_path": alignment,
}

# --- SQL -------------------------------------------------------------------------------------

_P1 = """p as (
  select s.idx, e.exemplar_idx, s.series as a, e.series as b from series_1d s join exemplars e using (file_id)
  where len(s.series) > 0 and len(list_filter(s.series, lambda v: v is null or isnan(v))) = 0
)"""
_P2 = """r as (
  select idx, file_id, list_transform(series, lambda c: list_transform(c, lambda v: case when v is null or isnan(v) then 0.0::double else v end)) as series
  from (select * from series_multi where series is not null qualify row_number() over (partition by idx order by arrived_at) = 1)
),
p as (
  select r.idx, r.series as a, f.b from r join (select file_id, arg_min(series, idx) as b from r group by file_id) f using (file_id)
)"""
_STEPS = "list_transform(range(1, len({x})), lambda k: {x}[k + 1] - {x}[k])"
_KEOGH = "case when len({x}) < 3 then {x} else list_transform(range(1, len({x}) + 1), lambda k: (({x}[greatest(2, least(k, len({x}) - 1))] - {x}[greatest(2, least(k, len({x}) - 1)) - 1]) + ({x}[greatest(2, least(k, len({x}) - 1)) + 1] - {x}[greatest(2, least(k, len({x}) - 1)) - 1]) / 2) / 2) end"


def _dp(cell: str, a: str = "a", b: str = "b") -> str:
    """Last cell of a dynamic program over lists a and b. Within ``cell``: {i}, {j} from 1, {x}, {y} the
    entries, {up}, {left}, {diag} the neighbours or null."""
    i, j = "xi[1]::bigint", "kk[1]::bigint"
    own = cell.format(i=i, j=j, x=f"{a}[{i}]", y=f"{b}[{j}]", px=f"{a}[{i} - 1]", py=f"{b}[{j} - 1]", up=f"prev[{j}]", left=f"(case when {j} > 1 then row[{j} - 1] end)", diag=f"(case when {j} > 1 then prev[{j} - 1] end)", a=a, b=b)
    return f"list_last(list_reduce(list_transform(range(1, len({a}) + 1), lambda k: [k::double]), lambda prev, xi: list_reduce(list_transform(range(1, len({b}) + 1), lambda k: [k::double]), lambda row, kk: list_append(row, {own}), []::double[]), []::double[]))"


_INF = "'inf'::double"
_LEAST = f"case when {{i}} = 1 and {{j}} = 1 then 0 else least(coalesce({{up}}, {_INF}), coalesce({{left}}, {_INF}), coalesce({{diag}}, {_INF})) end"


def _dtw_cell(local: str, band: int | None = None) -> str:
    own = f"({local} + {_LEAST})"
    return own if band is None else f"case when abs({{i}} - {{j}}) <= {band} then {own} else {_INF} end"


_SQUARE = "pow({x} - {y}, 2)"
_WEIGHT = "(1 / (1 + exp(-0.1 * (abs({i} - {j}) - greatest(len({a}), len({b})) / 2.0))))"


def _erp_cell(band: int) -> str:
    return f"case when abs({{i}} - {{j}}) > {band} then {_INF} when {{i}} = 1 and {{j}} = 1 then 0.0 when {{i}} = 1 then {{left}} + pow(0.3 - {{y}}, 2) when {{j}} = 1 then {{up}} + pow({{x}} - 0.3, 2) else least({{left}} + pow(0.3 - {{y}}, 2), {{up}} + pow({{x}} - 0.3, 2), {{diag}} + pow({{x}} - {{y}}, 2)) end"


def _step(v: str, x: str, y: str) -> str:
    return f"(0.5 + case when {v} between least({x}, {y}) and greatest({x}, {y}) then 0 else least(abs({v} - {x}), abs({v} - {y})) end)"


_MSM = f"case when {{i}} = 1 and {{j}} = 1 then abs({{x}} - {{y}}) when {{j}} = 1 then {{up}} + {_step('{x}', '{px}', '{y}')} when {{i}} = 1 then {{left}} + {_step('{y}', '{x}', '{py}')} else least({{diag}} + abs({{x}} - {{y}}), {{up}} + {_step('{x}', '{px}', '{y}')}, {{left}} + {_step('{y}', '{x}', '{py}')}) end"
_EDGE = "list_sum(list_transform(range(1, {k} + 1), lambda k: pow({s}[k] - case when k > 1 then {s}[k - 1] else 0 end, 2)))"
_EDGE_A, _EDGE_B = _EDGE.replace("{k}", "{i}").replace("{s}", "{a}"), _EDGE.replace("{k}", "{j}").replace("{s}", "{b}")
_DA, _DB = "pow({x} - case when {i} > 1 then {px} else 0 end, 2)", "pow({y} - case when {j} > 1 then {py} else 0 end, 2)"
_TWE = f"""least(
  case when {{i}} = 1 and {{j}} = 1 then 0 when {{i}} = 1 then {_EDGE_B} - {_DB} when {{j}} = 1 then {_EDGE_A} - {_DA} else {{diag}} end
    + pow({{x}} - {{y}}, 2) + case when {{i}} > 1 and {{j}} > 1 then pow({{px}} - {{py}}, 2) else 0 end + 0.01 * abs({{i}} - {{j}}) * case when {{i}} > 1 and {{j}} > 1 then 2 else 1 end,
  case when {{i}} = 1 then {_EDGE_B} else {{up}} end + {_DA} + 0.05 + 0.01,
  case when {{j}} = 1 then {_EDGE_A} else {{left}} end + {_DB} + 0.05 + 0.01)"""
_LCSS = "case when abs({i} - {j}) > 5 then '-inf'::double when abs({x} - {y}) <= 0.4 then greatest(coalesce({diag}, 0), 0) + 1 else greatest(coalesce({diag}, 0), coalesce({up}, 0), coalesce({left}, 0), 0) end"
_ZN = "list_transform({x}, lambda v: (v - list_avg({x})) / sqrt(list_var_pop({x})))"


def _one(expression: str, digits: int = 6) -> str:
    return f"with {_P1} select idx, exemplar_idx, round({expression}, {digits}) as d from p"


def _on(a: str, b: str, expression: str, digits: int = 6) -> str:
    return f"with {_P1}, q as (select idx, exemplar_idx, {a} as a, {b} as b from p) select idx, exemplar_idx, round({expression}, {digits}) as d from q"


def _bend(form: str) -> tuple[str, str]:
    return form.format(x="a"), form.format(x="b")


_HOG = "case when len({g}) = 0 or {n} <= 0 then []::double[] else list_transform(range(0, {n}), lambda k: len(list_filter({g}, lambda v: case when list_max({g}) = list_min({g}) then k = 0 else least(floor((v - list_min({g})) / ((list_max({g}) - list_min({g})) / {n})), {n} - 1) = k end))::double) end"
_E2 = "list_sum(list_transform(range(1, len({a}) + 1), lambda k: pow({a}[k] - {b}[k], 2)))"
_COS = "(list_sum(list_transform(range(1, len(a) + 1), lambda k: a[k] * b[k])) / (sqrt(list_sum(list_transform(a, lambda v: v * v))) * sqrt(list_sum(list_transform(b, lambda v: v * v)))))"


def paths_sql(source: str) -> str:
    """CTEs m (whole tables of a DTW) and w (idx, exemplar_idx, path from its end, places from 1) of source(idx,
    exemplar_idx, a, b)."""
    return f"""m as materialized (
  select idx, exemplar_idx, len(a) as la, len(b) as lb, list_reduce(
    list_transform(range(len(a)), lambda k: [[k::double]]),
    lambda acc, z: list_append(acc, list_reduce(
      list_transform(range(len(b)), lambda k: [k::double]),
      lambda row, y: list_append(row, (a[len(acc) + 1] - b[len(row) + 1]) * (a[len(acc) + 1] - b[len(row) + 1]) + case when len(acc) = 0 and len(row) = 0 then 0
        else least(coalesce(acc[len(acc)][len(row) + 1], {_INF}), coalesce(row[len(row)], {_INF}), case when len(row) > 0 then coalesce(acc[len(acc)][len(row)], {_INF}) else {_INF} end) end),
      []::double[])),
    []::double[][]) as d from {source}
),
w as (
  select idx, exemplar_idx, list_reduce(
    list_transform(range(la + lb - 2), lambda k: [[k::int, k::int]]),
    lambda path, z: case when path[len(path)][1] = 1 and path[len(path)][2] = 1 then path
      when path[len(path)][2] = 1 then list_append(path, [path[len(path)][1] - 1, 1])
      when path[len(path)][1] = 1 then list_append(path, [1, path[len(path)][2] - 1])
      when d[path[len(path)][1] - 1][path[len(path)][2] - 1] <= least(d[path[len(path)][1] - 1][path[len(path)][2]], d[path[len(path)][1]][path[len(path)][2] - 1]) then list_append(path, [path[len(path)][1] - 1, path[len(path)][2] - 1])
      when d[path[len(path)][1] - 1][path[len(path)][2]] <= d[path[len(path)][1]][path[len(path)][2] - 1] then list_append(path, [path[len(path)][1] - 1, path[len(path)][2]])
      else list_append(path, [path[len(path)][1], path[len(path)][2] - 1]) end,
    [[la::int, lb::int]]) as path from m
)"""


def _per_channel(expression: str, a: str = "x", b: str = "y") -> str:
    """Mean over the channels of a one-dimensional distance of the lists a and b."""
    return f"with {_P2}, c as (select idx, unnest(a) as x0, unnest(b) as y0 from p), q as (select idx, {a} as x, {b} as y from c) select idx, round(avg({expression}), 9) as d from q group by idx"


def _together(local: str, change: str | None = None, root: bool = True) -> str:
    both = "a, b" if change is None else f"list_transform(a, lambda c: {change.format(x='c')}) as a, list_transform(b, lambda c: {change.format(x='c')}) as b"
    cost = "list_sum(list_transform(range(1, len({a}) + 1), lambda ch: pow(" + "{a}[ch][{i}] - {b}[ch][{j}], 2)))"
    cell = _dtw_cell(local.replace("{cost}", cost)).replace("len({a}), len({b})", "len({a}[1]), len({b}[1])")
    i, j = "xi[1]::bigint", "kk[1]::bigint"
    own = cell.format(i=i, j=j, a="a", b="b", up=f"prev[{j}]", left=f"(case when {j} > 1 then row[{j} - 1] end)", diag=f"(case when {j} > 1 then prev[{j} - 1] end)")
    dp = f"list_last(list_reduce(list_transform(range(1, len(a[1]) + 1), lambda k: [k::double]), lambda prev, xi: list_reduce(list_transform(range(1, len(b[1]) + 1), lambda k: [k::double]), lambda row, kk: list_append(row, {own}), []::double[]), []::double[]))"
    return f"with {_P2}, q as (select idx, {both} from p) select idx, round({'sqrt' if root else ''}({dp}), 9) as d from q"


def _xy(expression: str) -> str:
    return expression.replace("{a}", "x").replace("{b}", "y")


_CX, _CY = (f"sqrt(list_sum(list_transform({_STEPS.format(x=v)}, lambda v: v * v)))" for v in ("x", "y"))
_ZC = "list_transform({x}, lambda v: case when list_var_pop({x}) > 0 then (v - list_avg({x})) / sqrt(list_var_pop({x})) else v - list_avg({x}) end)"
_SECOND = "list_transform(range(1, len({x}) - 1), lambda k: ({x}[k + 2] - {x}[k + 1]) - ({x}[k + 1] - {x}[k]))"
_STEPS_X, _STEPS_Y = _STEPS.format(x="x0"), _STEPS.format(x="y0")
SQL = {
    "d_euclidean": _one(_E2.format(a="a", b="b")),
    "d_manhattan": _one("list_sum(list_transform(range(1, len(a) + 1), lambda k: abs(a[k] - b[k])))").replace("from p", "from p where len(a) = len(b) union all select idx, exemplar_idx, null from p where len(a) <> len(b)"),
    "d_cosine": _one(f"1 - {_COS}"),
    "d_cosine_similarity": _one(_COS).replace("as d from", "as similarity from"),
    "d_cid": _one(f"sqrt({_E2.format(a='a', b='b')}) * greatest(ca, cb) / least(ca, cb)").replace("from p", f"from (select *, sqrt(list_sum(list_transform({_STEPS.format(x='a')}, lambda v: v * v))) as ca, sqrt(list_sum(list_transform({_STEPS.format(x='b')}, lambda v: v * v))) as cb from p)"),
    "d_sbd": _on(*_bend(_ZN), "1 - list_max(list_transform(range(-(len(a)::bigint) + 1, len(a)::bigint), lambda s: coalesce(list_sum(list_transform(range(greatest(1, 1 - s), least(len(a)::bigint, len(a)::bigint - s) + 1), lambda k: a[k] * b[k + s])), 0)))"),
    "d_dtw": _one(f"sqrt({_dp(_dtw_cell(_SQUARE))})"),
    "d_dtwcv": _one(f"sqrt({_dp(_dtw_cell(_SQUARE, 4))})"),
    "d_ddtw": _on(*_bend(_KEOGH), f"sqrt({_dp(_dtw_cell(_SQUARE))})"),
    "d_ddtwcv": _on(*_bend(_KEOGH), f"sqrt({_dp(_dtw_cell(_SQUARE, 4))})"),
    "d_wdtw": _one(_dp(_dtw_cell(f"{_WEIGHT} * {_SQUARE}"))),
    "d_wddtw": _on(*_bend(_KEOGH), _dp(_dtw_cell(f"{_WEIGHT} * {_SQUARE}"))),
    "d_lcss": _one(f"1 - greatest({_dp(_LCSS)}, 0) / least(len(a), len(b))"),
    "d_erp": _one(f"sqrt({_dp(_erp_cell(6))})"),
    "d_msm": _one(_dp(_MSM)),
    "d_twe": _one(_dp(_TWE)),
    "d_shapehog1ddtw": f"with {_P1}, s as (select idx, exemplar_idx, {_STEPS.format(x='a')} as a, {_STEPS.format(x='b')} as b from p), g as (select idx, exemplar_idx, {_STEPS.format(x='a')} as a, {_STEPS.format(x='b')} as b, floor(sqrt(len(a)))::int as na, floor(sqrt(len(b)))::int as nb from s), q as (select idx, exemplar_idx, {_HOG.format(g='a', n='na')} as a, {_HOG.format(g='b', n='nb')} as b from g) select idx, exemplar_idx, round(sqrt({_dp(_dtw_cell(_SQUARE))}), 6) as d from q",
    "d_masked_euclidean": """
with q as (
  select s.idx, e.exemplar_idx, s.series as a, e.series as b from series_1d s join exemplars e using (file_id) where len(s.series) = 32
)
select idx, exemplar_idx, round(coalesce(list_sum(list_transform(list_filter(range(1, len(a) + 1), lambda k: a[k] is not null and not isnan(a[k])), lambda k: pow(a[k] - b[k], 2))), 'inf'::double), 6) as d from q
""",
    "d_nearest_exemplar": f"with {_P1}, q as (select idx, exemplar_idx, sqrt({_dp(_dtw_cell(_SQUARE))}) as d from p) select idx, arg_min(exemplar_idx, (d, exemplar_idx)) as exemplar_idx, round(min(d), 6) as d from q group by idx",
    "d_dtw_d": _together("{cost}"),
    "d_ddtw_d": _together("{cost}", _STEPS),
    "d_wdtw_d": _together(f"{_WEIGHT} * {{cost}}"),
    "d_wddtw_d": _together(f"{_WEIGHT} * {{cost}}", _STEPS),
    "d_dtw_i": _per_channel(f"sqrt({_dp(_dtw_cell(_SQUARE), 'x', 'y')})", "x0", "y0"),
    "d_ddtw_i": _per_channel(f"sqrt({_dp(_dtw_cell(_SQUARE), 'x', 'y')})", _KEOGH.format(x="x0"), _KEOGH.format(x="y0")),
    "d_wdtw_i": _per_channel(_dp(_dtw_cell(f"{_WEIGHT} * {_SQUARE}"), "x", "y"), "x0", "y0"),
    "d_wddtw_i": _per_channel(_dp(_dtw_cell(f"{_WEIGHT} * {_SQUARE}"), "x", "y"), _KEOGH.format(x="x0"), _KEOGH.format(x="y0")),
    "d_lcss_i": _per_channel(f"1 - greatest({_dp(_LCSS, 'x', 'y')}, 0) / least(len(x), len(y))", "x0", "y0"),
    "d_erp_i": _per_channel(f"sqrt({_dp(_erp_cell(30), 'x', 'y')})", "x0", "y0"),
    "d_msm_i": _per_channel(_dp(_MSM, "x", "y"), "x0", "y0"),
    "d_twe_i": _per_channel(_dp(_TWE, "x", "y"), "x0", "y0"),
    "d_cid_i": _per_channel(f"case when len(x) = len(y) then case when least({_CX}, {_CY}) > 0 then sqrt({_E2.format(a='x', b='y')}) * greatest({_CX}, {_CY}) / least({_CX}, {_CY}) when {_E2.format(a='x', b='y')} = 0 then 0 else 'inf'::double end end", "x0", "y0"),
    "d_sbd_i": _per_channel("case when len(x) = len(y) then 1 - list_max(list_transform(range(-(len(x)::bigint) + 1, len(x)::bigint), lambda s: coalesce(list_sum(list_transform(range(greatest(1, 1 - s), least(len(x)::bigint, len(x)::bigint - s) + 1), lambda k: x[k] * y[k + s])), 0))) end", _ZC.format(x="x0"), _ZC.format(x="y0")),
    "d_alignment_path": f"""with {_P1}, {paths_sql("p")}
select idx, exemplar_idx, list_transform(list_reverse(path), lambda x: (x[1] - 1)::varchar || ' ' || (x[2] - 1)::varchar) as path from w""",
    "d_shapehogdtw_d": f"with {_P2}, f as (select idx, len(a[1]) as la, len(b[1]) as lb, flatten(list_transform(a, lambda x: {_SECOND.format(x='x')})) as a, flatten(list_transform(b, lambda x: {_SECOND.format(x='x')})) as b from p), g as (select idx, floor(sqrt(la - 1))::int as na, floor(sqrt(lb - 1))::int as nb, {_STEPS.format(x='a')} as a, {_STEPS.format(x='b')} as b from f), q as (select idx, {_HOG.format(g='a', n='na')} as a, {_HOG.format(g='b', n='nb')} as b from g) select idx, round(case when len(a) = 0 or len(b) = 0 then 0 else sqrt({_dp(_dtw_cell(_SQUARE))}) end, 9) as d from q",
    "d_shapehog1ddtw_i": _per_channel(f"case when len(x) = 0 or len(y) = 0 then 0 else sqrt({_dp(_dtw_cell(_SQUARE), 'x', 'y')}) end", _HOG.format(g=_SECOND.format(x="x0"), n="floor(sqrt(len(x0) - 1))::int"), _HOG.format(g=_SECOND.format(x="y0"), n="floor(sqrt(len(y0) - 1))::int")),
    "d_euclidean_i": _per_channel(f"case when len(x) = len(y) then {_E2.format(a='x', b='y')} end", "x0", "y0").replace(", 9) as d", ", 3) as d"),
    "d_manhattan_i": _per_channel("case when len(x) = len(y) then list_sum(list_transform(range(1, len(x) + 1), lambda k: abs(x[k] - y[k]))) end", "x0", "y0"),
}
for _n in ("d_euclidean", "d_cosine", "d_cosine_similarity", "d_cid", "d_sbd"):  # unequal lengths have no distance
    SQL[_n] = SQL[_n].replace("round(", "case when len(a) = len(b) then round(", 1).replace(" as d from", " end as d from").replace(" as similarity from", " end as similarity from")
