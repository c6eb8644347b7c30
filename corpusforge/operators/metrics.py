"""Measures: gold ranks, recall and MRR, closed-form baselines, path coverage, graded answers, A/B with controls, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded, normalize_punctuation, refuses
from . import passages, quantiles


def gold_rank(questions: DataFrame, ranked: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """query_id, gold_rank: the first rank whose key is gold, null for a miss."""
    hits = ranked.join(gold, ["query_id", key], "left_semi").groupBy("query_id").agg(F.min("rank").alias("gold_rank"))
    return questions.select("query_id").join(hits, "query_id", "left")


def recall_mrr(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 6), by: tuple[str, ...] = ()) -> DataFrame:
    """n, recall_at_k and mrr over all questions; misses count 0."""
    hits = [F.round(F.avg(F.when(F.col("gold_rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_at_{k}") for k in ks]
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *hits, F.round(F.avg(F.coalesce(1.0 / F.col("gold_rank"), F.lit(0.0))), 6).alias("mrr"))


def chance(n: Column, gold: Column, k: int) -> Column:
    """Chance that k random picks of n hold one of `gold`: 1 - prod (n - gold - j) / (n - j)."""
    left = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda p, j: p * F.greatest(F.lit(0.0), (n - gold - j).cast("double")) / F.greatest(F.lit(1.0), (n - j).cast("double")))
    return 1 - left


def anchor_hits(anchors: DataFrame, chunks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """anchors (..., anchor) joined to the chunks that contain them. Anchors are a stated set of phrases."""
    return passages.containing(chunks.select(key, text), anchors, text)


def path_coverage(paths: DataFrame, hits: DataFrame) -> DataFrame:
    """paths (query_id, path_id, anchor_id); hits (query_id, anchor_id): query_id, satisfied, best_coverage, any_anchor."""
    marked = paths.join(hits.select("query_id", "anchor_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "anchor_id"], "left")
    by_path = marked.groupBy("query_id", "path_id").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("share"))
    return by_path.groupBy("query_id").agg(F.max(F.col("share") >= 1).alias("satisfied"), F.round(F.max("share"), 6).alias("best_coverage"), F.max(F.col("share") > 0).alias("any_anchor"))


def passes(answer: Column, patterns: Column, keywords: Column, expect_refusal: Column) -> Column:
    """Refusal if it is expected; else no refusal and all patterns, or all keywords (in any case) where there is no pattern; an error without either."""
    text = normalize_punctuation(answer)
    some = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    matched = F.forall(patterns, lambda p: F.regexp_like(text, p))
    worded = F.forall(keywords, lambda w: F.contains(folded(text), folded(normalize_punctuation(w))))
    graded = F.when(refuses(text), False).when(some(patterns), matched).when(some(keywords), worded).otherwise(F.raise_error(F.lit("a case without a criterion")).cast("boolean"))
    return F.when(F.coalesce(expect_refusal, F.lit(False)), refuses(text)).otherwise(graded)


def upper_median(values: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """The element at n // 2 of the sorted values of each group; groups of any size (see quantiles)."""
    found = quantiles.order_statistics(values, value, by, F.array(F.floor(F.col("n") / 2)))
    return found.select(*by, F.col(value).alias("median_upper"))


def confusion(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """n, accuracy, constant_baseline (always the commoner answer), false_positives, false_negatives, unparsed."""
    p, a = F.col(predicted), F.col(actual)
    share = F.avg(a.cast("double"))
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.when(p == a, 1.0).otherwise(0.0)), 6).alias("accuracy"),
        F.round(F.greatest(share, 1 - share), 6).alias("constant_baseline"),
        F.count(F.when((p == 1) & (a == 0), 1)).alias("false_positives"),
        F.count(F.when((p == 0) & (a == 1), 1)).alias("false_negatives"),
        F.count(F.when(p.isNull(), 1)).alias("unparsed"),
    )


def flips(rows: DataFrame, case: str, verdict: str) -> DataFrame:
    """n_cases, flipped: cases whose repeated verdicts (a row each) aren't all the same; a verdict that can't be parsed (null) is one of its own."""
    kinds = F.count_distinct(verdict) + F.max(F.col(verdict).isNull().cast("int"))
    return rows.groupBy(case).agg((kinds > 1).alias("flipped")).agg(F.count(F.lit(1)).alias("n_cases"), F.count_if("flipped").alias("flipped"))


def quadrants(rows: DataFrame, retrieved: str = "retrieved", passed: str = "passed") -> DataFrame:
    """retrieved, passed, n of all four combinations: was the evidence found, was the answer right."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(r, p) for r in (True, False) for p in (True, False)], "retrieved boolean, passed boolean")
    counted = rows.groupBy(F.col(retrieved).alias("retrieved"), F.col(passed).alias("passed")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counted, ["retrieved", "passed"], "left").select("retrieved", "passed", F.coalesce("n", F.lit(0)).alias("n"))


def ab_delta(rows: DataFrame) -> DataFrame:
    """rows (question, arm: a or b, treated, passed, of): passed by arm and group, with rescued, broken and unchanged questions."""
    wide = rows.groupBy("question", "treated").agg(*[F.sum(F.when(F.col("arm") == x, F.col(c))).alias(f"{c}_{x}") for x in ("a", "b") for c in ("passed", "of")])
    wins = F.col("passed_b") - F.col("passed_a")
    return wide.groupBy("treated").agg(*[F.sum(c).cast("long").alias(c) for c in ("passed_a", "of_a", "passed_b", "of_b")], F.count(F.when(wins > 0, 1)).alias("rescued"), F.count(F.when(wins < 0, 1)).alias("broken"), F.count(F.when(wins == 0, 1)).alias("unchanged"))


def ab_values(outcomes: DataFrame, value: str, base, passed: str = "passed") -> DataFrame:
    """outcomes (query_id, value, passed) of a parameter's values: n, passed, and questions rescued and broken against the base value."""
    before = outcomes.where(F.col(value) == base).select("query_id", F.col(passed).alias("before"))
    met = outcomes.join(before, "query_id")
    count = lambda c: F.count(F.when(c, 1))
    return met.groupBy(value).agg(F.count(F.lit(1)).alias("n"), count(F.col(passed)).alias("passed"), count(F.col(passed) & ~F.col("before")).alias("rescued"), count(~F.col(passed) & F.col("before")).alias("broken"))


def profile_summary(traces: DataFrame, loop: tuple[str, ...] = ("grade", "rewrite")) -> DataFrame:
    """traces (timings map, rewrites): n_queries, share of the loop's steps (percent of all seconds), rewrite rate (percent),
    medians of a query's seconds over all, rewritten and other queries; null where there is none."""
    seconds = lambda c: F.aggregate(F.map_values(c), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    rows = traces.select(seconds("timings").alias("all"), seconds(F.map_filter("timings", lambda k, _: k.isin(*loop))).alias("looped"), (F.col("rewrites") > 0).alias("again"))
    median = lambda c: F.round(F.median(c), 4)
    return rows.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(100 * F.sum("looped") / F.sum("all"), 4).alias("loop_share"),
        F.round(100 * F.avg(F.col("again").cast("double")), 4).alias("rewrite_rate"),
        median("all").alias("median_total"),
        median(F.when(F.col("again"), F.col("all"))).alias("median_rewritten"),
        median(F.when(~F.col("again"), F.col("all"))).alias("median_plain"),
    )


def node_profile(traces: DataFrame) -> DataFrame:
    """traces (timings map): node, total, share (percent of all seconds), median, calls."""
    rows = traces.select(F.explode("timings").alias("node", "sec"))
    total = F.sum("sec")
    by_node = rows.groupBy("node").agg(F.round(total, 6).alias("total"), F.round(F.median("sec"), 6).alias("median"), F.count(F.lit(1)).alias("calls"))
    return by_node.withColumn("share", F.round(100 * F.col("total") / F.sum("total").over(Window.partitionBy(F.lit(1))), 4))  # a row a node
