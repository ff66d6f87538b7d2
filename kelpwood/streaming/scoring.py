"""Structured Streaming: parse lines as they arrive, and score new rows with a saved forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kelpwood.operators.forest import ForestModel
from kelpwood.operators.parse_failures import parse_lines


def outcomes(lines: DataFrame, context: DataFrame, delay: str = "7 days", window: str = "1 day") -> DataFrame:
    """Lines by outcome in windows of their arrival; lines later than ``delay`` are left out in append mode."""
    parsed = parse_lines(lines.select("line_id", "file_id", "line_no", "raw_line", F.col("received_at").cast("timestamp").alias("received_at")), context)
    at = parsed.withWatermark("received_at", delay)
    return at.groupBy(F.window("received_at", window).alias("w"), F.coalesce("reason", F.lit("loaded")).alias("outcome")).agg(F.count("*").alias("n_lines")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "outcome", "n_lines")


def score(model: ForestModel, rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Predictions of each micro-batch of (idx, series), written once each to path/batch=<n>."""

    def one(batch: DataFrame, number: int) -> None:
        model.transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
