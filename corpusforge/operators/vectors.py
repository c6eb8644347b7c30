"""Exact vector search: top-k by cosine or distance, filtered before or after ranking, and studies of both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import cosine, l2
from .lexical import CELLS, in_key_order, top_k

#: So many queries are held by each task; more are joined with the vectors.
HELD = 4096


def scored_pairs(vectors: DataFrame, queries: DataFrame, metric: str = "cosine") -> DataFrame:
    """query_id, vec_id, score and the vectors' other columns. queries: query_id, query_vector (a stated set, far fewer than the vectors)."""
    score = cosine(F.col("query_vector"), F.col("embedding")) if metric == "cosine" else l2(F.col("query_vector"), F.col("embedding"))
    return vectors.join(queries.select("query_id", "query_vector")).select("query_id", *[c for c in vectors.columns if c != "embedding"], F.round(score, 6).alias("score"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", prefilter: Column | None = None) -> DataFrame:
    """The k nearest of each query, ties by vec_id. prefilter reaches the scan, so k is filled if enough rows pass.

    Each task hands on the k best of the vectors that it reads at once, so pairs are never rows. Vectors of another length than the queries', or
    with null or non-finite components, are paired one by one; so are all if the queries differ in length or are over `HELD`.
    """
    if prefilter is not None:
        vectors = vectors.where(prefilter)
    order = (F.col("score").desc() if metric == "cosine" else F.col("score")), F.col("vec_id")
    asked = queries.select("query_id", "query_vector")
    held = asked.limit(HELD + 1).toArrow()
    lists = held["query_vector"].to_pylist() if held.num_rows <= HELD else []
    sizes = {len(v) if v is not None and None not in v and np.isfinite(v).all() else 0 for v in lists}
    if len(sizes) != 1 or 0 in sizes:
        return top_k(scored_pairs(vectors, queries, metric), k, *order)
    usual = F.coalesce((F.size("embedding") == sizes.pop()) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))
    once = vectors.sparkSession.createDataFrame(held, asked.schema)
    few = _cut(vectors.where(usual), held, asked.schema["query_id"].dataType, k, metric)
    return top_k(few.unionByName(scored_pairs(vectors.where(~usual), once, metric)), k, *order)


def _cut(vectors: DataFrame, asked: pa.Table, id_type: T.DataType, k: int, metric: str) -> DataFrame:
    """Of `scored_pairs` the k best of each query among some thousand vectors at a time."""
    others = [c for c in vectors.columns if c != "embedding"]
    schema = T.StructType([T.StructField("query_id", id_type), *[vectors.schema[c] for c in others], T.StructField("score", T.DoubleType())])
    q = np.array(asked["query_vector"].to_pylist(), dtype=np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast((asked["query_id"].combine_chunks(), q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        own = np.sqrt((q * q).sum(axis=1))
        step = max(1, CELLS // (len(q) + q.shape[1]))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                rows = rows.take(pa.array(in_key_order(rows["vec_id"])))
                v = rows["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)
                if metric == "cosine":
                    scale = own[:, None] * np.sqrt((v * v).sum(axis=1))
                    score = np.divide(q @ v.T, scale, out=np.zeros(scale.shape), where=scale != 0)
                else:
                    score = np.sqrt(np.stack([((v - x) ** 2).sum(axis=1) for x in q]))
                # Rounded half up, as the query does; nearest first.
                near = np.floor(np.abs(score) * 1e6 + 0.5) * (np.sign(score) if metric == "cosine" else -1.0)
                least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] if near.shape[1] > k else near.min(axis=1)
                row, place = np.nonzero(near >= least[:, None])
                order = np.lexsort((place, -near[row, place], row))
                row, place = row[order], place[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, place = row[kept], place[kept]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), *[rows[c].take(pa.array(place)) for c in others], pa.array(score[row, place])], names=schema.names)

    rounded = F.round("score", 6).alias("score")
    return vectors.select(*others, "embedding").mapInArrow(run, schema).select("query_id", *others, rounded)


def nearest_postfiltered(vectors: DataFrame, queries: DataFrame, k: int, condition: Column, over_fetch: int = 10, metric: str = "cosine") -> DataFrame:
    """Rank first, take over_fetch * k, then filter and cut to k: may give fewer than k rows, on purpose."""
    first = nearest(vectors, queries, over_fetch * k, metric).withColumnRenamed("rank", "raw_rank").where(condition)
    return top_k(first, k, F.col("raw_rank"))


def parity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """query_id, rank, a_key, b_key where two ranked lists differ; none if the stores agree."""
    return a.select("query_id", "rank", F.col(key).alias("a_key")).join(b.select("query_id", "rank", F.col(key).alias("b_key")), ["query_id", "rank"], "full_outer").where(~F.col("a_key").eqNullSafe(F.col("b_key")))


def over_fetch_study(vectors: DataFrame, queries: DataFrame, k: int, condition: Column, factors: tuple[int, ...] = (1, 2, 5, 10)) -> DataFrame:
    """query_id, factor, filled: how many of k a post-filter fills at each over-fetch; one ranking serves all factors."""
    ranked = nearest(vectors, queries, max(factors) * k).where(condition)
    asked = ranked.sparkSession.createDataFrame([(f,) for f in factors], "factor int")
    hits = ranked.select("query_id", "rank").join(F.broadcast(asked), F.col("rank") <= F.col("factor") * k).groupBy("query_id", "factor").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("long").alias("filled"))
    return queries.select("query_id").crossJoin(F.broadcast(asked)).join(hits, ["query_id", "factor"], "left").select("query_id", "factor", F.coalesce("filled", F.lit(0)).alias("filled"))
