"""Streams file by file: late rows, repeated ids, kept state and the trace sink."""

import os

from pyspark.sql import functions as F

from corpusforge import schema
from corpusforge.streaming import traces


def stream_of(spark, folder, batches):
    """A stream that sees each batch as a file of its own, in order. Rows: (event_id, ts, user_id, event_type, value)."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
        names = [c.split()[0] for c in schema.EVENTS.split(", ")]
        wanted = df.select(*[F.col(n) if n in df.columns else F.lit("{}").alias(n) for n in names])
        wanted.withColumn("ts", F.col("ts").cast("timestamp_ntz")).toPandas().to_parquet(f"{folder}/{i}.parquet", coerce_timestamps="us")
        os.utime(f"{folder}/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return traces.read(spark, str(folder))


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    day = lambda d, h=0: f"2024-01-0{d} {h:02d}:00:00"
    # Late rows are told by the watermark of the trigger before: one more file has to come in between.
    batches = [[(1, day(1), 1, "a", 1.0)], [(2, day(3), 1, "a", 1.0)], [(3, day(3, 1), 1, "a", 1.0)], [(4, day(1, 5), 1, "a", 1.0)], [(5, day(6), 1, "a", 1.0)]]
    traces.run_to_table(traces.rollup(stream_of(spark, folder, batches)), "late_rows", "append", str(tmp_path / "c"))
    got = sorted((str(r["window_start"])[:10], r["n"]) for r in spark.table("late_rows").collect())
    assert got == [("2024-01-01", 1), ("2024-01-03", 2)]


def test_repeated_ids_count_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    at = "2024-01-01 00:00:00"
    batches = [[(1, at, 1, "a", 1.0), (1, at, 1, "a", 1.0)], [(1, at, 1, "a", 1.0), (2, at, 1, "a", 1.0)]]
    stream = stream_of(spark, folder, batches)
    traces.run_to_table(traces.deduplicated(stream), "once", "append", str(tmp_path / "c"))
    assert sorted(r["event_id"] for r in spark.table("once").collect()) == [1, 2]
    batch = traces.timed(spark.read.parquet(str(folder)))
    assert traces.deduplicated(batch).count() == 2


def test_counts_are_kept_from_file_to_file(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    at = "2024-01-01 00:00:00"
    batches = [[(1, at, 1, "a", 1.0), (2, at, 2, "a", 5.0)], [(3, at, 1, "a", 2.0)]]
    traces.run_to_table(traces.running_counts(stream_of(spark, folder, batches)), "counts", "update", str(tmp_path / "c"))
    got = sorted((r["user_id"], r["n"], r["total"]) for r in spark.table("counts").collect())
    assert got == [(1, 1, 1.0), (1, 2, 3.0), (2, 1, 5.0)]


def test_the_trace_log_holds_each_row_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    at = "2024-01-01 00:00:00"
    stream = stream_of(spark, folder, [[(1, at, 1, "a", 1.0)], [(2, at, 1, "a", 1.0)]])
    for _ in range(2):
        traces.append_traces(stream, str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.json(str(tmp_path / "log")).collect()) == [1, 2]
