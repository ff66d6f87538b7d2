"""Queries of the language-model data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpwood.llm import leakage, neighbours, overlap, packing, repetition, speech, topn
from kelpwood.operators.hotdeck import observed_records
from kelpwood.session import table


def _sql_speech(text: str) -> str:
    """The speech of a text in SQL, with the patterns of the operator."""
    out = f"coalesce({text}, '')"
    for pattern, new in ((r"\r\n?", "chr(10)"), (speech.HEADER, "chr(1)"), (speech.TITLE, "''"), (speech.BEFORE, "''"), (speech.NOTE, "chr(10)"), (speech.MARKUP, "''"), (speech.SOUND, "' '")):
        out = f"regexp_replace({out}, '{pattern}', {new}, 'g')"
    return out


def _proximities(spark: SparkSession, d: str) -> DataFrame:
    """Both layouts in long form, only rows that count."""
    sparse = table(spark, d, "sparse_proximities").select(F.lit("sparse").alias("layout"), "i", "j", "prox")
    dense = table(spark, d, "dense_proximities").select("i", "j_first", F.posexplode("prox").alias("p", "prox")).select(F.lit("dense").alias("layout"), "i", (F.col("j_first") + F.col("p")).alias("j"), "prox")
    return sparse.unionByName(dense).filter("prox > 0 and prox <= 1 and j <> i")


def p2_top(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most proximate items of every instance, with proximity and rank."""
    return topn.top_n(_proximities(spark, d), ["layout", "i"], "j", "prox", 5).select("layout", "i", F.col("item").alias("j"), F.col("score").alias("prox"), F.col("rank").alias("place"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most proximate items of every instance."""
    return p2_top(spark, d).select("layout", "i", "j")


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest vectors of every vector."""
    return neighbours.nearest(table(spark, d, "series_1d"), "idx", "series").withColumn("distance", F.round("distance", 4))


CLOSE_PAIR = 1.2


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within 1.2 of which one is among the 5 nearest of the other."""
    return neighbours.close_pairs(neighbours.nearest(table(spark, d, "series_1d"), "idx", "series", limit=CLOSE_PAIR), CLOSE_PAIR).select("idx_a", "idx_b")


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(observed_records(table(spark, d, "series_multi"), table(spark, d, "app_context")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a train and a held-out record with the same or nearly the same series."""
    return _overlaps(spark, d).select(F.least("train_idx", "held_idx").alias("idx_a"), F.greatest("train_idx", "held_idx").alias("idx_b")).distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps by split and source."""
    return overlap.overlap_report(_overlaps(spark, d))


VOCABULARY = "byte_bpe_50k.tiktoken"  # of the installed public tokenizers


def _packed(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_targets"), str(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or piece of one longer than the capacity, with its container of each target."""
    return _packed(spark, d)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each target are."""
    return packing.fill_report(_packed(spark, d), table(spark, d, "pack_targets"))


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What the packing of each target must keep."""
    return packing.violations(_packed(spark, d), table(spark, d, "pack_targets"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items of which they hold half the passage or more."""
    return _leaks(spark, d).select("doc_id", "item_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items: documents, longest run, documents that also hold the answer."""
    return leakage.leak_report(_leaks(spark, d), table(spark, d, "eval_items"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Words and repeated words of every document, and the share."""
    return repetition.repetition(table(spark, d, "documents")).select("doc_id", "n_words", "n_repeated", F.round("share", 6).alias("share"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Repetitive documents: by the posterior of their votes where it is sure, by the exact share where the votes disagree."""
    return repetition.repetition(table(spark, d, "documents")).filter("repetitive").select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_top, p3_found, p3_neighbours, p4_found, p4_report, p6_packing, p6_report, p6_invariants, p7_found, p7_report, p8_found, p8_shares)}

_TOP = """
with a as (
  select 'sparse' as layout, i, j, prox from sparse_proximities
  union all
  select 'dense', i, j_first + unnest(range(len(prox))), unnest(prox) from dense_proximities
),
b as (select layout, i, j, max(prox) as prox from a where prox > 0 and prox <= 1 and j <> i group by all),
c as (select *, row_number() over (partition by layout, i order by prox desc, j) as place from b)
"""

_NEAR = """
with v as (
  select idx, series from series_1d where len(series) = 32 and len(list_filter(series, lambda x: x is null or isnan(x))) = 0
),
n as (
  select a.idx, b.idx as neighbour, list_distance(a.series, b.series) as distance,
    row_number() over (partition by a.idx order by list_distance(a.series, b.series), b.idx) as place
  from v a join v b on a.idx <> b.idx qualify place <= 5
)
"""

_REPEATED = rf"""
with s as (select doc_id, {_sql_speech("text")} as t from documents),
w as (
  select doc_id, row, ws[k] as word, k
  from (select doc_id, row, ws, unnest(range(1, len(ws) + 1)) as k
        from (select doc_id, row_number() over () as row, list_filter(string_split_regex(lower(t), '[^\pL\pN]+'), lambda x: x <> '') as ws from s))
),
g as (select *, concat_ws(' ', word, lead(word, 1) over v, lead(word, 2) over v, lead(word, 3) over v, lead(word, 4) over v) as run,
        lead(word, 4) over v is not null as full_run from w window v as (partition by row order by k)),
f as (select *, full_run and k > min(k) over (partition by row, run, full_run) as again from g),
c as (select *, max(again::int) over (partition by row order by k rows between 4 preceding and current row) as repeated from f),
n as (select row, count(*) as n_words, sum(repeated)::bigint as n_repeated from c group by row),
r as (select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_repeated, 0) as n_repeated
      from (select doc_id, row_number() over () as row from s) left join n using (row))
"""

_OVERLAPS = """
with c as (
  select file_id, list_filter(list_transform(missing_strings, lambda x: try_cast(trim(x) as double)), lambda x: x is not null and not isnan(x)) as nums from app_context
),
o as (
  select r.idx, r.file_id, lower(trim(split)) as split, source, series, missing_indices, nums, len(series) as channels, len(series) * list_max(list_transform(series, lambda x: len(x))) as size
  from (select * from series_multi qualify row_number() over (partition by idx order by arrived_at) = 1) r left join c using (file_id)
  where len(series) > 0
),
ch as (select idx, nums, unnest(series) as v, unnest(range(len(series))) as ch, missing_indices from o),
cell as (select idx, ch, nums, missing_indices[ch + 1] as listed, unnest(v) as x, unnest(range(len(v))) as pos from ch),
e as (
  select idx, ch, pos, x from cell
  where x is not null and not isnan(x) and not coalesce(list_contains(nums, x), false) and not coalesce(list_contains(listed, pos::int), false)
),
pairs as (
  select t.idx as t, h.idx as h, h.split, h.source as held_source, t.source as train_source, greatest(t.size, h.size) as size
  from o t join o h on t.file_id = h.file_id and t.channels = h.channels and t.split = 'train' and h.split in ('validation', 'test')
),
m as (
  select p.t, p.h, s.shift, a.ch, count(*) as n, stddev_pop(a.x) as sa, stddev_pop(b.x) as sb, corr(a.x, b.x) as r
  from pairs p cross join (select unnest(range(-3, 4)) as shift) s join e a on a.idx = p.t join e b on b.idx = p.h and b.ch = a.ch and b.pos + s.shift = a.pos
  group by all
),
d as (
  select t, h, shift, sum(n) as n,
    sqrt(greatest(sum(n * case when sa > 1e-12 and sb > 1e-12 then 2 - 2 * r when sa > 1e-12 or sb > 1e-12 then 1 else 0 end), 0) / sum(n)) as rms
  from m group by all
),
f as (select distinct p.* from d join pairs p using (t, h) where d.n >= 0.8 * p.size - 1e-9 and rms <= 0.15)
"""



_CONTINUED = "\x80-\xbf" + "‚ƒ„…†‡ˆ‰Š‹Œ•–—˜™š›œžŸ“”‘’€Ž"
_LOOKALIKES = (("0", "o"), ("a", "o"), ("1", "i"), ("l", "i"), ("|", "i"), ("5", "s"), ("8", "b"), ("b", "h"), ("c", "e"), ("f", "t"), ("u", "ii"), ("w", "vv"), ("m", "rn"))


def _sql_skeleton(text: str) -> str:
    """A spelling of ASCII letters alone that damaged and whole words share."""
    out = text
    steps = [(f"â[{_CONTINUED}]{{2}}", " "), (f"[ÂÃÅâ][{_CONTINUED}]+", "")]
    for pattern, new in steps:
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    out = f"lower({out})"
    for pattern, new in ((r"([\pL\pN])\?+([\pL\pN])", r"\1\2"), (r"([\pL\pN])\?+([\pL\pN])", r"\1\2"), ("[�\\pM]", ""), (r"[^\x00-\x7f\pL\pN]", " "), (r"[^\x00-\x7f]", "")):
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    for shape, common in _LOOKALIKES:
        out = f"replace({out}, '{shape}', '{common}')"
    return out


_LEAKS = f"""
with d as (select doc_id, list_filter(string_split_regex({_sql_skeleton(_sql_speech("text"))}, '[^a-z0-9]+'), lambda w: w <> '') as ws from documents),
dw as (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as k from d),
i0 as (select item_id, list_filter(string_split_regex(passage, '[^\\pL\\pN]+'), lambda w: w <> '') as ws from eval_items),
i1 as (select item_id, len(ws) as n, unnest(ws) as w, unnest(range(len(ws))) as spot from i0),
i2 as (select item_id, n, spot, replace({_sql_skeleton("w")}, ' ', '') as w from i1),
iw as (
  select *, row_number() over o - 1 as k, coalesce(lag(spot) over o + 1, 0) as first, coalesce(lead(spot) over o - 1, n - 1) as last
  from i2 where w <> '' window o as (partition by item_id order by spot)
),
m as (select doc_id, item_id, dw.k - iw.k as shift, iw.k, first, last, n from dw join iw using (w)),
r as (select *, k - row_number() over (partition by doc_id, item_id, shift order by k) as run from m),
f as (select doc_id, item_id, max(last) - min(first) + 1 as words, any_value(n) as n from r group by doc_id, item_id, shift, run)
"""

SQL = {
    "p6_invariants": "select target_id, (select count(*) from documents) as n_documents, 0::bigint as n_too_full, 0::bigint as n_cut, 0::bigint as n_broken from pack_targets where capacity_tokens >= 1",
    "p7_found": f"{_LEAKS} select distinct doc_id, item_id from f where 2 * words >= n",
    "p4_found": f"{_OVERLAPS} select least(t, h) as idx_a, greatest(t, h) as idx_b from f",
    "p4_report": f"{_OVERLAPS} select split, held_source, train_source, count(*) as n_pairs, count(distinct h) as n_held, count(distinct t) as n_train from f group by all",
    "p8_found": f"{_REPEATED} select doc_id from r where n_words > 0 and n_repeated >= 0.4 * n_words",
    "p8_shares": f"{_REPEATED} select doc_id, n_words, n_repeated, round(n_repeated / greatest(n_words, 1), 6) as share from r",
    "p3_found": f"{_NEAR} select distinct least(idx, neighbour) as idx_a, greatest(idx, neighbour) as idx_b from n where distance <= 1.2",
    "p2_found": f"{_TOP} select layout, i, j from c where place <= 5",
    "p2_top": f"{_TOP} select layout, i, j, prox, place::int as place from c where place <= 5",
}
