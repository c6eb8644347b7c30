"""Reciprocal rank fusion, version filter, re-ranking by a permutation, and the sweep of the fusion constant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import wants_history
from .lexical import top_k


def fuse(lists: DataFrame, top: int, constant: Column | float = 60, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Rows (query_id, list_id, rank, key, ...) of all lists to (query_id, rank, key, first_list, first_rank, score).

    score: sum of weight / (constant + rank), a repeated key in one list counts each time; `weight` is an optional
    column. Ties go to the key seen first. Scores are rounded to nine places before ranking.
    """
    constant = constant if isinstance(constant, Column) else F.lit(float(constant))
    weight = F.col("weight") if "weight" in lists.columns else F.lit(1.0)
    first = F.min(F.struct("list_id", F.col("rank").alias("first_rank")))
    scored = lists.groupBy(*by, "key").agg(F.round(F.sum(weight / (constant + F.col("rank"))), 9).alias("score"), first.alias("first"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "first.list_id", "first.first_rank"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select(*by, "rank", "key", F.col("first.list_id").alias("first_list"), F.col("first.first_rank").alias("first_rank"), "score")


def sweep_constant(lists: DataFrame, top: int, constants: tuple[int, ...] = (1, 5, 10, 20, 40, 60, 100, 200)) -> DataFrame:
    """The fusion at every constant, in one plan."""
    asked = lists.sparkSession.createDataFrame([(c,) for c in constants], "rrf_k int")
    return fuse(lists.crossJoin(F.broadcast(asked)), top, F.col("rrf_k").cast("double"), ("query_id", "rrf_k"))


def version_filtered(ranked: DataFrame, questions: DataFrame, top: int, enabled: bool = True) -> DataFrame:
    """Lists of 2 * top rows (query_id, rank, ..., superseded) without superseded rows, cut to top; may under-fill.

    A question about history (asked of the original question) and a corpus without superseded rows keep their list.
    """
    if not enabled:
        return ranked.where(F.col("rank") <= top)
    asked = questions.select("query_id", wants_history(F.col("question")).alias("history"))
    kept = ranked.join(asked, "query_id").where(F.col("history") & (F.col("rank") <= top) | ~F.col("history") & ~F.col("superseded"))
    return top_k(kept.withColumnRenamed("rank", "raw_rank"), top, F.col("raw_rank")).drop("history")


def permuted(ranked: DataFrame, permutations: DataFrame) -> DataFrame:
    """Lists reordered by a 0-based permutation for each query; an invalid one, or a list of one, changes nothing."""
    sized = ranked.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    valid = F.array_sort(F.col("permutation")) == F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))
    place = F.array_position("permutation", (F.col("rank") - 1).cast("int")).cast("int")
    new = F.when(F.coalesce(valid, F.lit(False)) & (F.col("n") > 1), place).otherwise(F.col("rank"))
    return sized.join(permutations, "query_id", "left").withColumn("new_rank", new).drop("n", "permutation")
