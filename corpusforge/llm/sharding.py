"""Shards by weighted rendezvous hashing of stable record keys.

Method. Every (key, shard) pair has a hash; read as a uniform number u it gives the score -weight / ln(u), and the
record goes to the shard of highest score. A shard that is added wins some records and moves no other; shard weights set
the shares. This is the law `key`: key and shard count alone decide. All is expression work on one row, no shuffle.
Slots (0, 1, ... in each shard) need one: rows are dealt by (shard, bucket), numbered inside the bucket,
and shifted by the counts of the buckets before, so no task holds a whole shard. An empty table gives no rows; texts of any
length are hashed in place and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name

#: Buckets in a shard for numbering; a bucket holds 1/BUCKETS of a shard.
BUCKETS = 256


def uniform(key: Column, salt: Column) -> Column:
    """A number in (0, 1) from 52 bits of a hash of key and salt."""
    return (F.shiftrightunsigned(F.xxhash64(key, salt), 12).cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Index of the shard with the highest score for the key; a weight of zero or less gets nothing."""
    scores = [F.struct((F.lit(-float(w)) / F.log(uniform(key, F.lit(i)))).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    if not scores:
        raise ValueError("at least one shard needs a positive weight")
    return -(F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def assign(df: DataFrame, key: Column, weights: list[float], shard: str = "shard") -> DataFrame:
    """df with its shard. Rows of equal keys, and all rows with a null key, go to one shard each."""
    return df.withColumn(shard, rendezvous(key, weights))


def with_slots(df: DataFrame, shard: str, key: Column, order: list[Column], slot: str = "slot") -> DataFrame:
    """df with gapless slots from 0 in each shard. Order: bucket of the key and of `order`, then `order`; repeated rows get a slot each.

    Rows that share a key are dealt over the buckets by what else they are ordered by, so null or repeated ids don't gather; only rows
    that are equal in all of it fill one bucket. All other columns of df are kept, whatever their names.
    """
    bucket, n, before, row = (free_name([*df.columns, shard, slot], x) for x in ("bucket", "n", "before", "row"))
    df = df.withColumn(bucket, F.pmod(F.xxhash64(key, *order, F.lit("slot")), F.lit(BUCKETS)).cast("int"))
    counts = df.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(shard), bucket, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    numbered = df.withColumn(row, F.row_number().over(Window.partitionBy(shard, bucket).orderBy(*order)))
    return numbered.join(offsets, [shard, bucket]).withColumn(slot, F.col(before) + F.col(row) - 1).drop(bucket, row, before)


def shard_documents(docs: DataFrame, shards: int, weights: list[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    size: UTF-8 bytes of the text plus 8; a null text has none and the crc32 of the empty text. A null doc_id is a key
    like any other. grown_shard: the shard if one more of the mean weight were added. Texts never enter the shuffle.
    """
    weights = weights or [1.0] * shards
    if len(weights) != shards:
        raise ValueError("a weight for each shard is needed")
    key = F.col("doc_id")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    slim = slim.withColumns({"law": F.lit("key"), "shard": rendezvous(key, weights).cast("int"), "grown_shard": rendezvous(key, [*weights, sum(weights) / shards]).cast("int")})
    out = with_slots(slim, "shard", key, [key, F.col("size"), F.col("text_crc32")])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
