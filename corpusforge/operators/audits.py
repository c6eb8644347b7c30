"""Checks whose result is empty if all is well, and reports on labels and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DEFECTS, REAL_URL, REVIEW, char_grams


def defects(chunks: DataFrame, text: str, rules: dict[str, str] | None = None) -> DataFrame:
    """rule, n_chunks of the rules that some chunk breaks. The rule on encoded paths looks at the text without URLs."""
    rules = rules or DEFECTS
    bare = F.regexp_replace(F.col(text), REAL_URL, " ")
    hits = F.array(*[F.when((bare if name == "encoded_path" else F.col(text)).rlike(pattern), F.lit(name)) for name, pattern in rules.items()])
    return chunks.select(F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n_chunks"))


def for_review(chunks: DataFrame, key: str, text: str, rules: dict[str, str] | None = None) -> DataFrame:
    """key, rule of chunks that someone should look at: what the rules match is no defect by itself."""
    rules = rules or REVIEW
    hits = F.array(*[F.when(F.col(text).rlike(pattern), F.lit(name)) for name, pattern in rules.items()])
    return chunks.select(key, F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("rule"))


def length_histogram(chunks: DataFrame, text: str, edges: tuple[int, ...]) -> DataFrame:
    """low, high, n of every bin [low, high) that holds a chunk."""
    size = F.length(text)
    bins = F.coalesce(*[F.when((size >= lo) & (size < hi), F.struct(F.lit(lo).alias("low"), F.lit(hi).alias("high"))) for lo, hi in zip(edges, edges[1:], strict=False)])
    return chunks.select(bins.alias("b")).where("b is not null").groupBy("b.low", "b.high").agg(F.count(F.lit(1)).alias("n"))


def fingerprint(chunks: DataFrame, key: str, md5: Column) -> DataFrame:
    """n_chunks and an order-free fingerprint: sums of two halves of each chunk's md5 with its key. Combines map-side; no global sort."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), md5).cast("binary"))
    half = lambda at: F.sum(F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(38,0)"))
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.md5(F.concat_ws(":", F.count(F.lit(1)).cast("string"), half(1).cast("string"), half(13).cast("string")).cast("binary")).alias("fingerprint"))


def containment(old: DataFrame, new: DataFrame, n: int = 5) -> DataFrame:
    """old (old_id, text), new (new_id, text): best and runner-up share of old's n-grams that a new text holds.

    An equi-join on grams; texts without a common gram don't meet. old is a stated set: its (old_id, size) by gram are one row a
    gram, so a side that Spark finds small enough is broadcast and new's other grams are never shuffled. Rows: old_id, new_id, score, runner_up.
    """
    a = old.select("old_id", char_grams(F.col("text"), n).alias("g")).select("old_id", F.size("g").alias("size"), F.explode("g").alias("gram"))
    b = new.select("new_id", F.explode(char_grams(F.col("text"), n)).alias("gram"))
    shared = a.join(b, "gram").groupBy("old_id", "new_id", "size").agg(F.count(F.lit(1)).alias("hits")).withColumn("score", F.round(F.col("hits") / F.col("size"), 6))
    order = Window.partitionBy("old_id").orderBy(F.col("score").desc(), "new_id")
    ranked = shared.withColumn("r", F.row_number().over(order)).where("r <= 2")
    return ranked.groupBy("old_id").agg(F.max(F.when(F.col("r") == 1, F.col("new_id"))).alias("new_id"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("score"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("score"))), F.lit(0.0)).alias("runner_up"))


def without_match(patterns: DataFrame, chunks: DataFrame, text: str = "text") -> DataFrame:
    """Patterns (pattern_id, pattern) that match no chunk. Patterns are a stated set of a few rows."""
    found = chunks.select(text).join(patterns, F.regexp_like(F.col(text), F.col("pattern"))).select("pattern_id").distinct()
    return patterns.join(found, "pattern_id", "left_anti")


def pattern_states(patterns: DataFrame, chunks: DataFrame, text: str = "text") -> DataFrame:
    """patterns (pattern_id, pattern, derived, expect_refusal) with state: leak (a refusal is expected, yet a chunk matches),
    refusal, ok, derived (an answer that must be worked out may match nothing), or dead."""
    unmatched = without_match(patterns.select("pattern_id", "pattern"), chunks, text).select("pattern_id", F.lit(True).alias("none"))
    missing = F.coalesce("none", F.lit(False))
    state = F.when(F.col("expect_refusal"), F.when(missing, "refusal").otherwise("leak")).when(~missing, "ok").when(F.col("derived"), "derived").otherwise("dead")
    return patterns.join(unmatched, "pattern_id", "left").withColumn("state", state).drop("none")


def feasibility(covers: DataFrame, top_k: int) -> DataFrame:
    """covers (query_id, path_id, size: chunks of the path's smallest cover, null if an anchor has none): query_id, need, state.

    need is the cheapest path's; more than top_k can't be retrieved (infeasible), and without a whole path it is unresolved.
    """
    need = covers.groupBy("query_id").agg(F.min("size").alias("need"))
    return need.withColumn("state", F.when(F.col("need").isNull(), "unresolved").when(F.col("need") > top_k, "infeasible").otherwise("feasible"))


def pass_but_miss(passed: Column, satisfied: Column, supported: Column, n_contexts: Column) -> Column:
    """Why an answer passed though its labelled evidence wasn't found: a label is missing (a context supports it), it is
    ungrounded (none does), or unknown (no contexts are stored). Null for all other answers."""
    return F.when(passed & ~satisfied, F.when(supported, "missing_label").when(n_contexts > 0, "ungrounded").otherwise("unknown"))


def derived_paths(sets: Column, anchors: Column) -> Column:
    """Explicit paths if there are any, else each anchor as a path of its own."""
    return F.when(F.coalesce(F.size(sets), F.lit(0)) > 0, sets).otherwise(F.transform(F.coalesce(anchors, F.array().cast("array<string>")), lambda a: F.array(a)))


def systematic(rows: DataFrame, order: str, at_most: int) -> DataFrame:
    """Every s-th row by `order` from the first, s = max(1, n // at_most), at_most rows. `order` must be dense from 0 (a position)."""
    n = rows.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / at_most)).cast("long").alias("stride"))
    return rows.crossJoin(F.broadcast(n)).where((F.col(order) % F.col("stride") == 0) & (F.col(order) / F.col("stride") < at_most)).drop("stride")  # one row on the right


def stratified(rows: DataFrame, by: str, order: str, n: int = 2) -> DataFrame:
    """The first n rows of each value."""
    return rows.withColumn("pick", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("pick") <= n)
