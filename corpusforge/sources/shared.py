"""The folder that driver and executors share, and tables written there between steps."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Unset, it is an error on a cluster, whose executors don't see the driver's disk; a local session gets a temporary folder."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="corpusforge-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    context.setCheckpointDir(made)
    return made


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return os.path.join(shared_folder(spark), "corpusforge", f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: it is worked out once, and an executor's loss costs nothing."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
