"""The answer cache as a stream writes it: every batch its own folder, the last write of a key counts, answers expire.

A batch that is run again after a failure replaces its own folder, so nothing is written twice. Reading takes, of each key, the answer of
latest time (ties: the later batch), and leaves out what has expired. `compact` puts all that still counts into one folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = "cache_key string, payload string, at timestamp, batch long"


def write_batch(answers: DataFrame, batch: int, folder: str) -> None:
    """answers: cache_key, payload, at (when it was given). For `foreachBatch`; running a batch again changes nothing."""
    rows = answers.where("cache_key is not null and payload is not null").select("cache_key", "payload", F.col("at").cast("timestamp").alias("at"))
    rows.write.mode("overwrite").parquet(f"{folder}/batches/batch={batch}")


def feed(answers: DataFrame, folder: str, checkpoint: str):
    """A query that writes a stream of answers into the cache."""
    return answers.writeStream.foreachBatch(lambda df, batch: write_batch(df, batch, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def entries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ENTRIES).parquet(f"{folder}/batches")


def current(rows: DataFrame, now: Column, keep_hours: float | None = None) -> DataFrame:
    """cache_key, payload, at: each key's last answer, unless it is older than keep_hours."""
    last = rows.groupBy("cache_key").agg(F.max(F.struct("at", "batch", "payload")).alias("e")).select("cache_key", "e.payload", "e.at")
    return last if keep_hours is None else last.where(F.col("at") > now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(keep_hours * 3600)))


def compact(spark: SparkSession, folder: str, now: Column, keep_hours: float | None = None) -> None:
    """Rewrite the cache as one batch numbered before all others, and delete the batches that it replaces. Not to be run beside a feed."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = f"{folder}/compacted-{uuid.uuid4().hex}"
    current(entries(spark, folder), now, keep_hours).write.parquet(aside)
    for s in fs.listStatus(path(f"{folder}/batches")):
        fs.delete(s.getPath(), True)
    fs.rename(path(aside), path(f"{folder}/batches/batch=-1"))
