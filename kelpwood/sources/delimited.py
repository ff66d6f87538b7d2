"""Delimited text files of series: one instance a line, labels inline or in a file of their own.

Lines are numbered in file order from counts of the splits, so large files are read by many tasks. Lines
that don't parse come out apart (``failed``), none is lost. Separators are taken literally.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpwood.operators.parse_failures import parse_lines
from kelpwood.session import stored


@dataclass(frozen=True)
class Layout:
    """How a file is written."""

    entry_separator: str = ","
    array_separator: str = ":"
    missing_strings: tuple[str, ...] = ("", "NA", "NaN", "null", "nan", "NAN")
    is_2d: bool = False
    is_numeric: bool = True
    n_channels: int | None = None
    n_entries: int | None = None
    target_column: str = "none"  # first, last
    has_header: bool = False


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(idx, raw_line): the lines of a file or folder, numbered from 0 in order.

    The splits of a text file are read in any order, so their rows are counted by file and place, and every row
    takes its number from the counts before its split and its rank within; no line is shuffled.
    """
    at = ["file", "block"]
    lines = stored(spark.read.text(path, lineSep="\n").select(F.col("value").alias("raw_line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))
    splits = lines.groupBy(*at).agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = splits.withColumn("before", F.sum("n").over(Window.orderBy(*at)) - F.col("n")).drop("n")  # one row a split
    return lines.join(F.broadcast(before), at).select((F.col("before") + F.col("row") - F.col("first")).alias("idx"), "raw_line")


def _settings(spark: SparkSession, layout: Layout, channels: int) -> DataFrame:
    row = (0, layout.entry_separator, layout.array_separator, list(layout.missing_strings), layout.is_2d, layout.is_numeric, channels, layout.n_entries, layout.target_column, False)
    return spark.createDataFrame([row], "file_id int, entry_separator string, array_separator string, missing_strings array<string>, is_2d boolean, is_numeric boolean, n_channels int, n_entries int, target_column string, has_header boolean")


def tagged(token: Column) -> Column:
    """A mixed entry by what it reads as: number, else true/false, else text; null stays null."""
    number = token.try_cast("double")
    flag = F.when(F.lower(token).isin("true", "false"), F.lower(token) == "true")
    return F.when(token.isNotNull(), F.struct(number.alias("num"), F.when(number.isNull(), flag).alias("bool"), F.when(number.isNull() & flag.isNull(), token).alias("str")))


def read_delimited(spark: SparkSession, path: str, layout: Layout | None = None, labels: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(instances, failed) of a file.

    instances: (idx, label, series): array<double>, array<array<double>>, or arrays of tagged entries in
    files that aren't numeric. failed: (idx, raw_line, reason).
    """
    layout = layout or Layout()
    lines = read_lines(spark, path)
    if layout.has_header:
        lines = lines.filter("idx > 0").withColumn("idx", F.col("idx") - 1)
    channels = layout.n_channels
    if channels is None:
        first = lines.orderBy("idx").limit(1).collect() if layout.is_2d else []
        channels = len([c for c in first[0]["raw_line"].rstrip("\r").split(layout.array_separator) if c]) if first else 1
    whole = lines.select("idx", F.lit(0).alias("file_id"), F.lit(0).alias("line_no"), "raw_line", F.col("raw_line").alias("text"))
    parsed = parse_lines(whole, _settings(spark, layout, channels))
    good = parsed.filter("reason is null")
    if layout.is_numeric:
        series = F.col("series") if layout.is_2d else F.get("series", F.lit(0))
    else:
        mixed = F.transform("tokens", lambda c: F.transform(c, tagged))
        series = mixed if layout.is_2d else F.get(mixed, F.lit(0))
    instances = good.select("idx", "label", series.alias("series"))
    if labels:
        own = read_lines(spark, labels).select("idx", F.trim("raw_line").alias("label"))
        instances = instances.drop("label").join(own, "idx", "left").select("idx", "label", "series")
    return instances, parsed.filter("reason is not null").select("idx", F.col("text").alias("raw_line"), "reason")


def series_text(series: Column, two: bool, entry: str = ",", array: str = ":", mixed: bool = False) -> Column:
    """A series as a line of text; two-dimensional ones end every channel with the array separator. ``mixed``: the
    entries are tagged."""
    shown = lambda v: F.coalesce(v["num"].cast("string"), v["bool"].cast("string"), v["str"]) if mixed else v.cast("string")
    words = lambda c: F.array_join(F.transform(c, lambda v: F.coalesce(shown(v), F.lit(""))), entry)
    return F.array_join(F.transform(series, lambda c: F.concat(words(c), F.lit(array))), "") if two else words(series)


def write_series(rows: DataFrame, path: str, two: bool, entry: str = ",", array: str = ":") -> None:
    """(idx, series) as text, one line an instance in order of idx."""
    mixed = "struct" in rows.schema["series"].dataType.simpleString()
    rows.repartitionByRange("idx").sortWithinPartitions("idx").select(series_text(F.col("series"), two, entry, array, mixed).alias("value")).write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Predictions, proximities or outlier scores as parquet, json or csv."""
    getattr(rows.write.mode("overwrite"), kind)(path)


def collect_matrix(dense: DataFrame, most: int = 10_000):  # noqa: ANN201
    """A dense proximity table (i, prox array) as (ids, numpy matrix), for at most ``most`` rows."""
    import numpy as np

    rows = dense.orderBy("i").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return [r["i"] for r in rows], np.array([r["prox"] for r in rows], float)


def file_info(spark: SparkSession, path: str, layout: Layout | None = None) -> DataFrame:
    """(n_lines, n_rows, least_entries, most_entries) of a file: lines without a header, and entries of a line (of its
    first channel in two dimensions), the label counted in."""
    layout = layout or Layout()
    text = F.regexp_replace("value", "\r$", "")
    line = F.split_part(text, F.lit(layout.array_separator), F.lit(1)) if layout.is_2d else text
    entries = F.size(F.split(line, F.lit("\\Q" + layout.entry_separator + "\\E"), -1))
    lines = spark.read.text(path, lineSep="\n").select(entries.alias("n"))
    return lines.agg(F.count("*").alias("n_lines"), (F.count("*") - int(layout.has_header)).alias("n_rows"), F.min("n").alias("least_entries"), F.max("n").alias("most_entries"))
