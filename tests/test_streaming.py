from __future__ import annotations

from datetime import datetime, timedelta

from kelpwood.streaming import scoring

CONTEXT = "file_id int, file_name string, entry_separator string, array_separator string, missing_strings array<string>, is_2d boolean, is_numeric boolean, n_channels int, n_entries int, target_column string, has_header boolean"
LINES = "line_id long, file_id int, line_no long, raw_line string, received_at timestamp"


def test_late_lines_are_left_out_in_append_mode(spark, tmp_path):
    context = spark.createDataFrame([(1, "f", ",", None, ["NA"], False, True, 1, 2, "first", False)], CONTEXT)
    day = datetime(2025, 3, 1)
    batches = [
        [(1, 1, 1, "a,1,2", day), (2, 1, 2, "a,1", day)], [(3, 1, 3, "a,1,2", day + timedelta(days=30))],
        [(4, 1, 4, "a,3,4", day), (5, 1, 5, "b,1,2", day + timedelta(days=29))], [(6, 1, 6, "a,1,2", day + timedelta(days=60))],
    ]
    source = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(str(source))
        query = scoring.outcomes(spark.readStream.schema(LINES).parquet(str(source)), context).writeStream.outputMode("append").format("parquet")
        query.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = {(str(r["day"])[:10], r["outcome"], r["n_lines"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # line 4 came long after its day was closed, line 5 within the delay
    assert got == {("2025-03-01", "loaded", 1), ("2025-03-01", "column_count", 1), ("2025-03-30", "loaded", 1), ("2025-03-31", "loaded", 1)}
