"""The queries of this subpackage: one for each operator, over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, golden, mixing, periodic, pii, ppm, quality_cascade, sharding, simhash, token_counts, token_store, toxicity
from .common import table

#: Parameters of the queries.
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SHARDS = 24
END_ID = 2


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.encoded_lengths(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)
    return token_counts.suffix_sums(token_counts.histogram(lengths))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.judged(table(spark, sf_dir, "documents"))


def op4_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.digests(spark, token_store.build(table(spark, sf_dir, "documents"), WORD_BPE, END_ID))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.judge(table(spark, sf_dir, "documents"))


def op10_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op11_golden_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.digests(table(spark, sf_dir, "clients"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_simhash, op3_mixing, op4_ivf_pq, op5_toxicity, op6_rendezvous_sharding, op7_byte_bpe, op8_token_store, op9_quality_rules, op10_ppm_scoring, op11_golden_records, op12_pii, op13_periodic_runs)}
ORACLES = {"op3_mixing": mixing.judged_sql(), "op9_quality_rules": quality_cascade.JUDGE_SQL.replace("{documents}", "documents"), "op11_golden_records": golden.DIGESTS_SQL}
