"""Queries of the general training-data problems: parse failures (p1) and imputation (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpwood.operators import hotdeck, parse_failures
from kelpwood.session import stored, table


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse_failures.parse_lines(table(spark, d, "raw_lines").select("line_id", "file_id", "line_no", "raw_line"), table(spark, d, "app_context"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every data line that doesn't fit its file's settings, with the reason; lines of unknown files have none to fit."""
    return _parsed(spark, d).filter("reason <> 'unknown_file'").select("line_id", "reason")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each file by outcome."""
    return _parsed(spark, d).groupBy("file_id", F.coalesce("reason", F.lit("loaded")).alias("outcome")).agg(F.count("*").alias("n_lines"))


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Instances of the valid lines: label, channels, entries, missing entries, sum of the values."""
    values = F.flatten("series")
    words = F.flatten("tokens")
    return _parsed(spark, d).filter("reason is null").select(
        "line_id", "file_id", "label",
        F.size(F.coalesce("series", F.transform("tokens", lambda c: F.transform(c, lambda _: F.lit(0.0))))).alias("n_channels"),
        F.coalesce(F.size(values), F.size(words)).alias("n_entries"),
        F.coalesce(F.size(F.filter(values, lambda x: x.isNull())), F.size(F.filter(words, lambda x: x.isNull()))).alias("n_missing"),
        F.round(F.aggregate(F.filter(values, lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


def _filled(spark: SparkSession, d: str) -> DataFrame:
    return hotdeck.hot_deck(table(spark, d, "series_multi"), table(spark, d, "app_context"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every filled cell."""
    return hotdeck.filled_cells(_filled(spark, d)).select("idx", "field", "channel", "pos")


def p5_filled(spark: SparkSession, d: str) -> DataFrame:
    """Every record whole, with the number of filled cells and of those that have donors."""
    return _filled(spark, d).select("idx", "file_id", "label", "series", F.size("filled").alias("n_filled"), F.size(F.filter("filled", lambda x: F.size(x["donors"]) > 0)).alias("n_donated"))


def p5_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What the filling of each file must keep."""
    return hotdeck.violations(stored(_filled(spark, d)), table(spark, d, "series_multi"), table(spark, d, "app_context"))


QUERIES = {"p5_invariants": p5_invariants, "p1_found": p1_found, "p1_report": p1_report, "p1_loaded": p1_loaded, "p5_found": p5_found, "p5_filled": p5_filled}

_LINES = r"""
num as (select '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?' as num),
l as (
  select line_id, r.file_id, regexp_replace(coalesce(raw_line, ''), '\r$', '') as t, c.* exclude (file_id),
    regexp_escape(entry_separator) as e, case when is_2d then regexp_escape(array_separator) else '' end as a,
    case when entry_separator = chr(9) then ' ' else '[ \t]' end as bl,
    list_transform(missing_strings, lambda x: upper(x)) as ms,
    case when not is_2d and target_column in ('first', 'last') then 1 else 0 end as lab
  from raw_lines r join app_context c on c.file_id = r.file_id
  where not (has_header and line_no = 1)
),
q as (
  select *, not regexp_full_match(t, '(' || ent || ')((' || e || case when is_2d then '|' || a else '' end || ')(' || ent || '))*') as bad_quote
  from (select *, bl || '*"([^"]|"")*"' || bl || '*|[^"' || e || a || ']*' as ent from l)
),
m as (
  select *, regexp_replace(t, '"(([^"]|"")*)"', chr(2) || '\1' || chr(3), 'g') as t1,
    chr(2) || '[ \t]*(' || num || list_aggregate(list_transform(missing_strings, lambda x: '|' || regexp_escape(x)), 'string_agg', '') || ')[ \t]*' || chr(3) as good
  from q, num
),
v as (
  select *, regexp_replace(regexp_replace(t1, good, '\1', 'gi'), chr(2) || '[^' || chr(3) || ']*' || chr(3), '"', 'g') as t2 from m
),
s as (
  select *, case when is_2d then string_split(regexp_replace(t2, a || '[ \t]*$', ''), array_separator) else [t2] end as ch from v
),
w as (
  select *, list_transform(ch, lambda x: string_split(x, entry_separator)) as en from s
),
r as (
  select line_id, file_id, case
    when bad_quote then 'quoting'
    when len(ch) <> n_channels
      or (n_entries is not null and len(list_filter(en, lambda x: len(x) <> n_entries + lab)) > 0)
      or (n_entries is null and len(list_distinct(list_transform(en, lambda x: len(x)))) > 1) then 'column_count'
    when is_numeric and len(list_filter(
        flatten(case when lab = 0 then en when target_column = 'first' then [en[1][2:]] else [en[1][:-2]] end),
        lambda x: not (list_contains(ms, upper(trim(x, ' ' || chr(9))))
          or (regexp_full_match(trim(x, ' ' || chr(9)), num)
              and coalesce(isfinite(try_cast(ltrim(trim(x, ' ' || chr(9)), '+') as double)), not regexp_matches(x, '[eE]')))))) > 0 then 'value'
    end as reason
  from w
)
"""

_CELLS = """
with c as (
  select file_id, list_transform(missing_strings, lambda x: upper(x)) as ms,
    list_filter(list_transform(missing_strings, lambda x: try_cast(trim(x) as double)), lambda x: x is not null and not isnan(x)) as nums
  from app_context
),
o as (
  select r.*, ms, nums from (select * from series_multi qualify row_number() over (partition by idx order by arrived_at) = 1) r
  left join c using (file_id)
),
ch as (select idx, nums, unnest(series) as v, unnest(range(len(series))) as channel, missing_indices from o),
cell as (
  select idx, channel, nums, missing_indices[channel + 1] as listed, unnest(v) as x, unnest(range(len(v))) as pos from ch
)
"""

_LOADED = r"""
, f as (
  select line_id, file_id, is_numeric, ch, ms, flatten(case when lab = 0 then en when target_column = 'first' then [en[1][2:]] else [en[1][:-2]] end) as entries,
    case when lab = 0 then null when target_column = 'first' then regexp_extract(t, '^(' || ent || ')(' || e || '|$)', 1) else regexp_extract(t, '(^|' || e || ')(' || ent || ')$', 2) end as raw
  from w join r using (line_id, file_id) where reason is null
),
g as (select *, list_transform(entries, lambda x: trim(x, ' ' || chr(9))) as trimmed, trim(raw, ' ' || chr(9)) as lb from f),
h as (select *, list_filter(trimmed, lambda x: not list_contains(ms, upper(x))) as seen from g)
"""

SQL = {
    "p1_loaded": f"""with {_LINES} {_LOADED}
select line_id, file_id, case when lb like '"%' then trim(replace(lb[2:-2], '""', '"'), ' ' || chr(9)) else lb end as label,
  len(ch)::int as n_channels, len(entries)::int as n_entries, (len(entries) - len(seen))::int as n_missing,
  case when is_numeric then round(coalesce(list_sum(list_transform(seen, lambda x: ltrim(x, '+')::double)), 0), 6) end as total
from h""",
    "p1_found": f"with {_LINES} select line_id, reason from r where reason is not null",
    "p1_report": f"with {_LINES} select file_id, coalesce(reason, 'loaded') as outcome, count(*) as n_lines from r group by all",
    "p5_invariants": f"""{_CELLS.rstrip()},
k as (select idx, count(*) as cells from cell where x is null or isnan(x) or coalesce(list_contains(nums, x), false) or coalesce(list_contains(listed, pos::int), false) group by idx)
select file_id, count(*) as n_records, coalesce(sum(cells), 0)::bigint as n_entries, sum((label is null or coalesce(list_contains(ms, upper(trim(label, ' ' || chr(9) || chr(10) || chr(13)))), false))::int)::bigint as n_labels,
  0::bigint as n_left, 0::bigint as n_changed, 0::bigint as n_wrong_donors, 0::bigint as n_outside
from o left join k using (idx) group by file_id""",
    "p5_found": f"""
{_CELLS}select idx, 'series' as field, channel::int as channel, pos::int as pos from cell
where x is null or isnan(x) or coalesce(list_contains(nums, x), false) or coalesce(list_contains(listed, pos::int), false)
union all
select idx, 'label', -1, -1 from o
where label is null or coalesce(list_contains(ms, upper(trim(label, ' ' || chr(9) || chr(10) || chr(13)))), false)
""",
}
