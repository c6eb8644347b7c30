"""Streams of trace events: watermarked roll-ups, sessions, de-duplication and a stateful counter.

Event time comes as TIMESTAMP_NTZ in some files; a watermark needs TIMESTAMP, so it is cast (session time zone UTC).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

LATE = "1 hour"


def read(spark: SparkSession, folder: str, pattern: str = "*.parquet", per_trigger: int = 1) -> DataFrame:
    """A stream over Parquet files of events as they arrive."""
    return timed(spark.readStream.schema(schema.EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).parquet(folder))


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def rollup(events: DataFrame, width: str = "1 day") -> DataFrame:
    """window_start, event_type, n, total: tumbling windows; the same on a batch and a stream."""
    marked = events.withWatermark("ts", LATE) if events.isStreaming else events
    out = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day") -> DataFrame:
    marked = events.withWatermark("ts", LATE) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """user_id, session_start, session_end, n."""
    marked = events.withWatermark("ts", LATE) if events.isStreaming else events
    out = marked.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def deduplicated(events: DataFrame) -> DataFrame:
    """Each event_id once; a stream forgets ids that the watermark has passed."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def running_counts(events: DataFrame) -> DataFrame:
    """user_id, n, total so far, kept as state by user: a row for each user and trigger."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, n long, total double", "n long, total double", "update", "NoTimeout")


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> None:
    """Process all that is there into an in-memory table (tests and small roll-ups)."""
    stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_traces(stream: DataFrame, folder: str, checkpoint: str):
    """The append-only trace log: JSON files, exactly once by the file sink's log."""
    return stream.writeStream.outputMode("append").format("json").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
