"""Stored tables: chunks as JSON lines or Parquet, vectors, the graph, the index manifest, traces and the answer cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.audits import fingerprint
from ..settings import Settings


def write_chunks(chunks: DataFrame, folder: str) -> None:
    """Parquet for the engine and JSON lines for interchange."""
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks.parquet")
    chunks.write.mode("overwrite").json(f"{folder}/chunks.jsonl")


def read_chunks_json(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines are skipped."""
    return spark.read.schema(schema.CHUNKS).json(path)


def manifest(chunks: DataFrame, settings: Settings, vector_store: str = "exact", embed_model: str = "external") -> DataFrame:
    print_ = fingerprint(chunks, "chunk_index", F.col("md5"))
    return print_.select(F.col("fingerprint").alias("chunks_md5"), F.col("n_chunks").cast("long").alias("n_chunks"), F.lit(vector_store).alias("vector_store"), F.lit(embed_model).alias("embed_model"), F.lit(settings.chunk_size).alias("chunk_size"), F.lit(settings.chunk_overlap).alias("chunk_overlap"), F.lit(settings.min_chunk_chars).alias("min_chunk_chars"))


def write_manifest(row: DataFrame, folder: str) -> None:
    row.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest.parquet")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest.parquet")


def build_vectors(chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], folder: str) -> None:
    """Embed every chunk and store vec_id, embedding, source and superseded; a store that is there is replaced.

    embed takes (chunk_index, page_content, ...) to the same rows with `embedding`; an Arrow UDF gets batches whose size
    the session sets in spark.sql.execution.arrow.maxRecordsPerBatch. Filters on source reach the scan.
    """
    rows = embed(chunks).select(F.col("chunk_index").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), "source", "superseded")
    rows.write.mode("overwrite").parquet(f"{folder}/vectors.parquet")


def load_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/vectors.parquet")


def save_graph(node_rows: DataFrame, edge_rows: DataFrame, folder: str) -> None:
    """The graph as two tables; parallel edges stay."""
    node_rows.write.mode("overwrite").parquet(f"{folder}/nodes.parquet")
    edge_rows.write.mode("overwrite").parquet(f"{folder}/edges.parquet")


def load_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as they were saved."""
    return spark.read.parquet(f"{folder}/nodes.parquet"), spark.read.parquet(f"{folder}/edges.parquet")


def consistency(current: DataFrame, stored: DataFrame | None) -> DataFrame:
    """status of one-row manifests: ok, mismatch, or unknown without a stored one."""
    if stored is None:
        return current.select(F.lit("unknown").alias("status"))
    other = stored.select(F.col("chunks_md5").alias("stored_md5"))
    joined = current.join(other, F.lit(True), "left")  # a row each
    return joined.select(F.when(F.col("stored_md5").isNull(), "unknown").when(F.col("stored_md5") == F.col("chunks_md5"), "ok").otherwise("mismatch").alias("status"))


def trace(answers: DataFrame, most: int = 500) -> DataFrame:
    """Rows for the trace log: answer cut, seconds rounded."""
    rounded = F.transform_values("timings", lambda _, v: F.round(v, 2))
    return answers.withColumns({"answer": F.substring("answer", 1, most), "elapsed_sec": F.round("elapsed_sec", 1), "timings": rounded})


def cache_key(settings_fingerprint: Column, index_md5: Column, question: Column) -> Column:
    return F.md5(F.concat_ws(":", settings_fingerprint, index_md5, question).cast("binary"))


def cached_and_new(questions: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions (cache_key, ...) with a stored payload, and those without one. Only the latter need an answer."""
    return questions.join(cache, "cache_key"), questions.join(cache, "cache_key", "left_anti")
