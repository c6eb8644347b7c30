"""Exact token statistics from a length histogram.

Method. Documents are aggregated by encoded length: one row for each length that occurs, a combinable count that no hot
source can unbalance. Suffix sums over the histogram then answer everything at once: documents and tokens at or above a
length, quantiles, and the tokens that remain when every document is truncated to a context limit. The histogram has at
most sqrt(2 * tokens) rows, since m distinct lengths hold at least m(m-1)/2 tokens. The suffix sums run in two levels
(blocks of lengths, then lengths in a block), so that no task needs the whole histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import share, worker_codec
from .common import arrow_rows, written

#: Lengths in a block of the two-level suffix sums.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """n_tokens (long) of each row's whole text; a null text has length 0."""
    shared = share(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(shared)
        for batch in arrow_rows(batches, 256):
            yield pa.RecordBatch.from_arrays([codec.counts(batch.column(0).to_pylist())], names=["n_tokens"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs. Map-side combined, so a length that a third of all documents share costs one row a task."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with suffix sums, a row for each length L that occurs.

    docs_at_least, tokens_at_least: documents of L tokens or more, and their tokens. total_docs, total_tokens: of all.
    truncated_tokens: tokens left if documents are cut to L. quantile: share of documents of at most L tokens.
    An empty table gives no rows. The histogram is read twice, so it is written first: encoding runs once.
    """
    hist = written(hist, "length-histogram")
    blocks = hist.groupBy(F.floor(F.col("n_tokens") / BLOCK).alias("block")).agg(F.sum("n_docs").alias("b_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("b_tokens"))
    # One task adds up the blocks: the longest document's tokens / BLOCK rows at most, each far smaller than that document.
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"after_{c}") for c in ("b_docs", "b_tokens")], *[F.sum(c).over(whole).alias(f"all_{c}") for c in ("b_docs", "b_tokens")])
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).join(blocks, "block")
    docs = F.sum("n_docs").over(inside) + F.col("after_b_docs")
    tokens = F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside) + F.col("after_b_tokens")
    out = out.select("n_tokens", "n_docs", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"), F.col("all_b_docs").alias("total_docs"), F.col("all_b_tokens").alias("total_tokens"))
    truncated = F.col("total_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")
    below = F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")
    return out.withColumns({"truncated_tokens": truncated, "quantile": below / F.col("total_docs")})


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit (also one at which no document ends): documents over it, and tokens left after truncation."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(x,) for x in sorted(set(limits))], "context_limit long")
    # The smallest length above the limit carries the suffix sums for it; limits are a short list from the caller.
    over = sums.join(F.broadcast(asked), F.col("n_tokens") > F.col("context_limit")).groupBy("context_limit").agg(F.min_by(F.struct("docs_at_least", "tokens_at_least", "total_tokens"), "n_tokens").alias("s"))
    total = sums.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("t"))
    out = asked.join(over, "context_limit", "left").crossJoin(F.broadcast(total))  # one row on the right
    docs = F.coalesce(F.col("s.docs_at_least"), F.lit(0))
    return out.select("context_limit", docs.alias("docs_over"), F.coalesce(F.col("t") - F.col("s.tokens_at_least") + docs * F.col("context_limit"), F.col("t")).alias("tokens_kept"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length whose quantile reaches each share."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in sorted(set(shares))], "share double")
    return sums.join(F.broadcast(asked), F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
