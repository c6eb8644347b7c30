"""Queries on measures, baselines, comparisons and audits."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import udfs
from ..operators import audits, chunking, context, lexical, metrics
from ..settings import Settings
from ..sources.shared import written
from . import workload as w
from .workload import query, table

DOCS = "documents"
RANKS = "SELECT query_id, gold_rank FROM (SELECT item_id AS query_id FROM benchmark) LEFT JOIN (SELECT query_id, min(rank) AS gold_rank FROM {bm} SEMI JOIN {gold} USING (query_id, doc_id) WHERE rank <= 6 GROUP BY query_id) USING (query_id)"
MEASURES = "count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN gold_rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_at_{k}" for k in (1, 3, 6)) + ", round(avg(coalesce(1.0 / gold_rank, 0.0)), 6) AS mrr"


def ranks(spark, sf_dir, first=1, n=12, gold=None):
    return metrics.gold_rank(w.questions(spark, sf_dir), w.best(spark, sf_dir, 6, first, n), w.gold(spark, sf_dir) if gold is None else gold, "doc_id")


@query("gold_rank", RANKS)
def gold_rank(spark, sf_dir):
    return ranks(spark, sf_dir)


CHANCE = "1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(range({k}), lambda j: greatest(0.0, (n_docs - g - j)::DOUBLE) / greatest(1.0, (n_docs - j)::DOUBLE))), lambda a, b: a * b)"


@query("recall_mrr", f"SELECT {MEASURES}, (SELECT round(avg({CHANCE.format(k=6)}), 6) FROM (SELECT item_id, (SELECT count(*) FROM documents) AS n_docs, coalesce(g, 0) AS g FROM benchmark LEFT JOIN (SELECT query_id AS item_id, count(*) AS g FROM {{gold}} GROUP BY 1) USING (item_id))) AS random_at_6 FROM ({RANKS})")
def recall_mrr(spark, sf_dir):
    gold = written(w.gold(spark, sf_dir), "gold")
    return metrics.recall_mrr(ranks(spark, sf_dir, gold=gold)).crossJoin(F.broadcast(by_chance(spark, sf_dir, (6,), gold)))  # a row each


def by_chance(spark, sf_dir, ks, gold=None):
    n = table(spark, sf_dir, DOCS).agg(F.count(F.lit(1)).alias("n_docs"))
    golds = (w.gold(spark, sf_dir) if gold is None else gold).groupBy("query_id").agg(F.count(F.lit(1)).alias("g"))
    rows = w.questions(spark, sf_dir).select("query_id").join(golds, "query_id", "left").crossJoin(F.broadcast(n))
    return rows.agg(*[F.round(F.avg(metrics.chance(F.col("n_docs"), F.coalesce("g", F.lit(0)), k)), 6).alias(f"random_at_{k}") for k in ks])


@query("random_baseline", f"SELECT {', '.join(f'round(avg({CHANCE.format(k=k)}), 6) AS random_at_{k}' for k in (1, 3, 6))} FROM (SELECT item_id, (SELECT count(*) FROM documents) AS n_docs, coalesce(g, 0) AS g FROM benchmark LEFT JOIN (SELECT query_id AS item_id, count(*) AS g FROM {{gold}} GROUP BY 1) USING (item_id))")
def random_baseline(spark, sf_dir):
    return by_chance(spark, sf_dir, (1, 3, 6))


@query("system_comparison", f"SELECT 'long' AS system, {MEASURES} FROM ({RANKS}) GROUP BY 1 UNION ALL SELECT 'short', {MEASURES} FROM ({RANKS.replace('{bm}', '{bmh}')}) GROUP BY 1")
def system_comparison(spark, sf_dir):
    gold = written(w.gold(spark, sf_dir), "gold")
    both = ranks(spark, sf_dir, gold=gold).withColumn("system", F.lit("long")).unionByName(ranks(spark, sf_dir, 5, 3, gold).withColumn("system", F.lit("short")))
    return metrics.recall_mrr(both, by=("system",))


@query("anchor_chunks", "SELECT query_id, doc_id FROM {gold}")
def anchor_chunks(spark, sf_dir):
    anchors = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("anchor"))
    return metrics.anchor_hits(anchors, table(spark, sf_dir, DOCS), "doc_id").select("query_id", "doc_id")


#: Paths: a question's own passage with its neighbour's, or its own alone where its id is even.
PATHS = "SELECT item_id // 4 AS query_id, item_id % 2 AS path_id, item_id AS anchor_id FROM benchmark"
HITS = "SELECT DISTINCT query_id // 4 AS query_id, query_id AS anchor_id FROM {gold}"


def paths(spark, sf_dir):
    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(F.floor(i / 4).alias("query_id"), (i % 2).alias("path_id"), i.alias("anchor_id"))


def hits(spark, sf_dir):
    return w.gold(spark, sf_dir).select(F.floor(F.col("query_id") / 4).alias("query_id"), F.col("query_id").alias("anchor_id")).distinct()


@query("path_coverage", f"SELECT query_id, max(share) >= 1 AS satisfied, round(max(share), 6) AS best_coverage, max(share) > 0 AS any_anchor FROM (SELECT query_id, path_id, avg(CASE WHEN h.anchor_id IS NULL THEN 0.0 ELSE 1.0 END) AS share FROM ({PATHS}) p LEFT JOIN ({HITS}) h USING (query_id, anchor_id) GROUP BY ALL) GROUP BY query_id")
def path_coverage(spark, sf_dir):
    return metrics.path_coverage(paths(spark, sf_dir), hits(spark, sf_dir))


@query(
    "coverage_baseline",
    f"SELECT query_id, round(max(p), 6) AS by_chance FROM (SELECT query_id, path_id, product({CHANCE.format(k=6)}) AS p FROM (SELECT query_id, path_id, anchor_id, coalesce(g, 0) AS g, (SELECT count(*) FROM documents) AS n_docs FROM ({PATHS}) LEFT JOIN (SELECT query_id AS anchor_id, count(*) AS g FROM {{gold}} GROUP BY 1) USING (anchor_id)) GROUP BY ALL) GROUP BY query_id",
)
def coverage_baseline(spark, sf_dir):
    """Chance that six random picks satisfy the best path: anchors of a path taken as independent."""
    golds = w.gold(spark, sf_dir).groupBy(F.col("query_id").alias("anchor_id")).agg(F.count(F.lit(1)).alias("g"))
    n = table(spark, sf_dir, DOCS).agg(F.count(F.lit(1)).alias("n_docs"))
    rows = paths(spark, sf_dir).join(golds, "anchor_id", "left").crossJoin(F.broadcast(n)).withColumn("p", metrics.chance(F.col("n_docs"), F.coalesce("g", F.lit(0)), 6))
    by_path = rows.groupBy("query_id", "path_id").agg(F.product("p").alias("p"))
    return by_path.groupBy("query_id").agg(F.round(F.max("p"), 6).alias("by_chance"))


@query("evidence_loss", f"SELECT query_id FROM (SELECT query_id, path_id, bool_and(h.anchor_id IS NOT NULL) AS whole FROM ({PATHS}) p LEFT JOIN ({HITS}) h USING (query_id, anchor_id) GROUP BY ALL) GROUP BY query_id HAVING NOT bool_or(whole)")
def evidence_loss(spark, sf_dir):
    return metrics.path_coverage(paths(spark, sf_dir), hits(spark, sf_dir)).where(~F.col("satisfied")).select("query_id")


@query("coverage_audit", f"SELECT CASE WHEN g IS NULL THEN 'unresolved' WHEN g > 1 THEN 'broad' ELSE 'single' END AS state, count(*) AS n FROM ({PATHS}) LEFT JOIN (SELECT query_id AS anchor_id, count(*) AS g FROM {{gold}} GROUP BY 1) USING (anchor_id) GROUP BY 1")
def coverage_audit(spark, sf_dir):
    golds = w.gold(spark, sf_dir).groupBy(F.col("query_id").alias("anchor_id")).agg(F.count(F.lit(1)).alias("g"))
    state = F.when(F.col("g").isNull(), "unresolved").when(F.col("g") > 1, "broad").otherwise("single")
    return paths(spark, sf_dir).join(golds, "anchor_id", "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("min_cover")
def min_cover(spark, sf_dir):
    golds = w.gold(spark, sf_dir).groupBy(F.col("query_id").alias("anchor_id")).agg(F.array_sort(F.collect_set(F.col("doc_id").cast("int"))).alias("found"))
    rows = paths(spark, sf_dir).join(golds, "anchor_id", "left")
    sets = rows.groupBy("query_id", "path_id").agg(F.collect_list(F.coalesce("found", F.array().cast("array<int>"))).alias("sets"))
    return sets.select("query_id", "path_id", F.array_join(udfs.min_cover("sets"), ",").alias("cover"))


@query("quadrants", "SELECT quality, count(*) FILTER (toxic = 0) AS clean, count(*) FILTER (toxic = 1) AS toxic FROM labels GROUP BY quality")
def quadrants(spark, sf_dir):
    wide = table(spark, sf_dir, "labels").groupBy("quality").pivot("toxic", [0, 1]).agg(F.count(F.lit(1)))
    return wide.select("quality", *[F.coalesce(c, F.lit(0)).alias(n) for c, n in (("0", "clean"), ("1", "toxic"))])


REFUSED = " 정보가 없습니다"


@query(
    "answer_grade",
    f"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN refused WHEN 1 THEN NOT refused AND conv_id % 2 = 0 WHEN 2 THEN NOT refused AND conv_id % 5 <> 0 ELSE NOT refused AND conv_id % 5 <> 0 END AS passed
    FROM (SELECT conv_id, turn, text, conv_id % 3 = 0 AS refused FROM conversations)""",
)
def answer_grade(spark, sf_dir):
    """Turns as answers, every third conversation refusing. Criteria by turn: a refusal is wanted; a pattern made of the answer's own first word, or of one it lacks; its words in capitals as keywords; a pattern in full-width marks beside keywords that count for nothing."""
    i, first = F.col("conv_id"), F.regexp_extract("text", r"^\s*(\S{1,4})", 1)
    own = F.concat(F.lit(r"\Q"), first, F.lit(r"\E"))
    turn = F.col("turn") % 4
    answer = F.concat("text", F.lit("：end"), F.when(i % 3 == 0, REFUSED).otherwise(""))
    absent = F.concat(F.lit("zq"), i.cast("string"))
    patterns = F.when(turn == 1, F.array(own, F.when(i % 2 == 0, F.lit(":end")).otherwise(absent))).when(turn == 3, F.array(F.when(i % 5 == 0, absent).otherwise(F.lit("(?i)[:]END"))))
    keywords = F.when(turn == 2, F.array(F.lit(":END"), F.when(i % 5 == 0, absent).otherwise(F.upper(first)))).when(turn == 3, F.array(absent))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", metrics.passes(answer, patterns, keywords, turn == 0).alias("passed"))


@query("accuracy_rollup", "SELECT type, count(*) AS n, round(avg(passed::INTEGER), 6) AS accuracy, round(avg(rewrote::INTEGER), 6) AS rewrite_rate, round(avg(latency), 4) AS latency FROM {ans} GROUP BY ROLLUP (type)")
def accuracy_rollup(spark, sf_dir):
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return w.answers(spark, sf_dir).rollup("type").agg(F.count(F.lit(1)).alias("n"), share("passed").alias("accuracy"), share("rewrote").alias("rewrite_rate"), F.round(F.avg("latency"), 4).alias("latency"))


@query("rescore_flips", "SELECT doc_id, passed AS before, toxic = 0 AS after FROM {ans} WHERE passed <> (toxic = 0)")
def rescore_flips(spark, sf_dir):
    rows = w.answers(spark, sf_dir)
    again = rows.select("doc_id", (F.col("toxic") == 0).alias("after"))
    return rows.join(again, "doc_id").where("passed <> after").select("doc_id", F.col("passed").alias("before"), "after")


@query(
    "grader_cases",
    """WITH b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS p, count(*) OVER () AS n FROM benchmark),
    top AS (SELECT item_id AS query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS docs FROM benchmark LEFT JOIN (SELECT * FROM {bm} WHERE rank <= 3) t ON t.query_id = item_id GROUP BY ALL),
    hit AS (SELECT DISTINCT l.query_id AS shown_id, g.query_id FROM bm l JOIN {gold} g USING (doc_id) WHERE l.rank <= 3),
    own AS (SELECT top.query_id, EXISTS (SELECT 1 FROM hit WHERE hit.query_id = top.query_id AND shown_id = top.query_id) AS ok, docs FROM top)
    SELECT CASE WHEN ok THEN 'positive' ELSE 'retrieval-miss' END AS kind, query_id, docs, CASE WHEN ok THEN 'yes' ELSE 'no' END AS expected FROM own
    UNION ALL SELECT 'shuffled', a.item_id, docs, 'no' FROM b a JOIN b c ON c.p = (a.p + a.n // 2) % a.n JOIN top ON top.query_id = c.item_id WHERE c.item_id <> a.item_id AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.query_id = a.item_id AND shown_id = c.item_id)
    UNION ALL SELECT 'out-of-scope', qo.query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank), 'no' FROM {qo} LEFT JOIN (SELECT * FROM {bmo} WHERE rank <= 3) t ON t.query_id = qo.query_id GROUP BY qo.query_id""",
)
def grader_cases(spark, sf_dir):
    """Questions with three documents and the verdict they should get: their own three, those of the question half a table
    away (left out where gold is among them), and those found for questions out of scope."""
    asked = w.questions(spark, sf_dir)
    found = w.best(spark, sf_dir, 3).select("query_id", "rank", "doc_id")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",")
    tops = asked.select("query_id").join(found.groupBy("query_id").agg(listed.alias("docs")), "query_id", "left")
    hits = found.select(F.col("query_id").alias("shown_id"), "doc_id").join(w.gold(spark, sf_dir), "doc_id").select("query_id", "shown_id").distinct().withColumn("hit", F.lit(True))
    own = tops.withColumn("shown_id", F.col("query_id")).join(hits, ["query_id", "shown_id"], "left").withColumn("ok", F.coalesce("hit", F.lit(False)))
    first = own.select(F.when(F.col("ok"), "positive").otherwise("retrieval-miss").alias("kind"), "query_id", "docs", F.when(F.col("ok"), "yes").otherwise("no").alias("expected"))
    numbered = asked.select("query_id", (F.row_number().over(Window.orderBy("query_id")) - 1).alias("p"))  # a stated set
    n = numbered.agg(F.count(F.lit(1)).alias("n"))
    shifted = numbered.select(F.col("query_id").alias("shown_id"), F.col("p").alias("at"))
    pairs = numbered.crossJoin(F.broadcast(n)).withColumn("at", F.pmod(F.col("p") + F.floor(F.col("n") / 2), F.col("n"))).join(shifted, "at").select("query_id", "shown_id").where("query_id <> shown_id")
    clean = pairs.join(hits, ["query_id", "shown_id"], "left_anti").join(tops.withColumnRenamed("query_id", "shown_id"), "shown_id")
    second = clean.select(F.lit("shuffled").alias("kind"), "query_id", "docs", F.lit("no").alias("expected"))
    outside = spark.createDataFrame(list(enumerate(w.OUT_OF_SCOPE)), "query_id long, question string")
    third = lexical.bm25_topk(table(spark, sf_dir, DOCS), outside, "doc_id", 3)
    third = outside.select("query_id").join(third.groupBy("query_id").agg(listed.alias("docs")), "query_id", "left")
    return first.unionByName(second).unionByName(third.select(F.lit("out-of-scope").alias("kind"), "query_id", "docs", F.lit("no").alias("expected")))


@query("confusion_summary", "SELECT count(*) AS n, round(avg(CASE WHEN p = quality THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(greatest(avg(quality), 1 - avg(quality)), 6) AS constant_baseline, count(*) FILTER (p = 1 AND quality = 0) AS false_positives, count(*) FILTER (p = 0 AND quality = 1) AS false_negatives, count(*) FILTER (p IS NULL) AS unparsed FROM (SELECT quality, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN n_chars > 300 THEN 1 ELSE 0 END AS p FROM {ans})")
def confusion_summary(spark, sf_dir):
    rows = w.answers(spark, sf_dir).withColumn("p", F.when(F.col("doc_id") % 10 == 0, F.lit(None)).when(F.col("n_chars") > 300, 1).otherwise(0))
    return metrics.confusion(rows, "p", "quality")


@query("verify_buckets", "SELECT passed, rewrote, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS rate, round(quantile_cont(latency, 0.5), 6) AS median_latency FROM {ans} GROUP BY passed, rewrote")
def verify_buckets(spark, sf_dir):
    rows = w.answers(spark, sf_dir).groupBy("passed", "rewrote").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("latency", 0.5), 6).alias("median_latency"))
    return rows.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))  # four rows


ARMS = "SELECT doc_id // 2 AS question, arm, bool_or(rewrote) OVER (PARTITION BY doc_id // 2) AS treated, passed::INTEGER AS passed, 1 AS of_ FROM {ans}"


def arms(spark, sf_dir):
    rows = w.answers(spark, sf_dir).withColumn("question", F.floor(F.col("doc_id") / 2))
    treated = F.max("rewrote").over(Window.partitionBy("question"))
    return rows.select("question", "arm", treated.alias("treated"), F.col("passed").cast("int").alias("passed"), F.lit(1).alias("of"))


@query(
    "ab_delta",
    f"SELECT treated, sum(pa)::BIGINT AS passed_a, sum(oa)::BIGINT AS of_a, sum(pb)::BIGINT AS passed_b, sum(ob)::BIGINT AS of_b, count(*) FILTER (pb > pa) AS rescued, count(*) FILTER (pb < pa) AS broken, count(*) FILTER (pb = pa) AS unchanged FROM (SELECT question, treated, sum(passed) FILTER (arm = 'a') AS pa, sum(of_) FILTER (arm = 'a') AS oa, sum(passed) FILTER (arm = 'b') AS pb, sum(of_) FILTER (arm = 'b') AS ob FROM ({ARMS}) GROUP BY ALL) GROUP BY treated",
)
def ab_delta(spark, sf_dir):
    return metrics.ab_delta(arms(spark, sf_dir))


@query("ab_three_arm", "SELECT type, count(*) FILTER (doc_id % 3 = 0 AND passed) AS single, count(*) FILTER (doc_id % 3 = 1 AND passed) AS routed, count(*) FILTER (doc_id % 3 = 2 AND passed) AS all_team FROM {ans} GROUP BY type")
def ab_three_arm(spark, sf_dir):
    arm = F.element_at(F.array(F.lit("single"), F.lit("routed"), F.lit("all_team")), (F.col("doc_id") % 3 + 1).cast("int"))
    wide = w.answers(spark, sf_dir).where("passed").withColumn("system", arm).groupBy("type").pivot("system", ["single", "routed", "all_team"]).agg(F.count(F.lit(1)))
    return wide.select("type", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("single", "routed", "all_team")])


@query("latency_medians", "SELECT type, median_upper, round(quantile_cont(latency, 0.5), 6) AS median FROM {ans} JOIN (SELECT type, latency AS median_upper FROM (SELECT type, latency, row_number() OVER (PARTITION BY type ORDER BY latency) AS r, count(*) OVER (PARTITION BY type) AS n FROM ans) WHERE r = n // 2 + 1) USING (type) GROUP BY type, median_upper")
def latency_medians(spark, sf_dir):
    rows = w.answers(spark, sf_dir)
    return metrics.upper_median(rows, "latency", ("type",)).join(rows.groupBy("type").agg(F.round(F.median("latency"), 6).alias("median")), "type")


@query("node_profile", "SELECT event_type AS node, round(sum(value), 4) AS total, round(100 * sum(value) / (SELECT sum(value) FROM events), 4) AS share, round(quantile_cont(value, 0.5), 6) AS median, count(*) AS calls FROM events GROUP BY event_type")
def node_profile(spark, sf_dir):
    traces = table(spark, sf_dir, "events").select(F.create_map("event_type", "value").alias("timings"))
    return metrics.node_profile(traces).withColumn("total", F.round("total", 4))


@query("stratified_sample", "SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 2")
def stratified_sample(spark, sf_dir):
    return audits.stratified(table(spark, sf_dir, DOCS).select("lang", "doc_id"), "lang", "doc_id", 2).select("lang", "doc_id")


GRAMS = "list_distinct(list_transform(range(1, greatest(1, length(b) - 4) + 1), lambda i: substr(b, i, 5)))"
BODY = "regexp_replace(text, '[^0-9A-Za-z가-힣]+', '', 'g')"


@query(
    "containment_match",
    f"""WITH a AS (SELECT item_id AS old_id, len({GRAMS}) AS size, unnest({GRAMS}) AS gram FROM (SELECT item_id, {BODY} AS b FROM benchmark)),
    n AS (SELECT doc_id AS new_id, unnest({GRAMS}) AS gram FROM (SELECT doc_id, {BODY} AS b FROM documents)),
    s AS (SELECT old_id, new_id, round(count(*) / size, 6) AS score, row_number() OVER (PARTITION BY old_id ORDER BY round(count(*) / size, 6) DESC, new_id) AS r FROM a JOIN n USING (gram) GROUP BY old_id, new_id, size)
    SELECT old_id, max(new_id) FILTER (r = 1) AS new_id, max(score) FILTER (r = 1) AS score, coalesce(max(score) FILTER (r = 2), 0.0) AS runner_up FROM s GROUP BY old_id HAVING max(score) FILTER (r = 1) >= 0.35""",
)
def containment_match(spark, sf_dir):
    old = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("old_id"), "text")
    new = table(spark, sf_dir, DOCS).select(F.col("doc_id").alias("new_id"), "text")
    return audits.containment(old, new).where("score >= 0.35")


@query("dead_patterns", "SELECT item_id AS pattern_id FROM benchmark WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(documents.text, substr(benchmark.text, 1, 20)))")
def dead_patterns(spark, sf_dir):
    literal = F.concat(F.lit("\\Q"), F.substring("text", 1, 20), F.lit("\\E"))
    patterns = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pattern_id"), literal.alias("pattern"))
    return audits.without_match(patterns, table(spark, sf_dir, DOCS)).select("pattern_id")


@query("gold_audit", "SELECT query_id, doc_id, 'omitted' AS state FROM {gold} WHERE doc_id % 2 = 1 UNION ALL SELECT item_id, 1000000 + item_id, 'stale' FROM benchmark WHERE item_id % 10 = 0")
def gold_audit(spark, sf_dir):
    """Labels that hold the even documents and some that are gone: what is missing and what is stale."""
    found = w.gold(spark, sf_dir)
    gone = table(spark, sf_dir, "benchmark").where("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), (F.col("item_id") + 1000000).alias("doc_id"))
    labels = found.where("doc_id % 2 = 0").unionByName(gone)
    omitted = found.join(labels, ["query_id", "doc_id"], "left_anti").withColumn("state", F.lit("omitted"))
    stale = labels.join(table(spark, sf_dir, DOCS).select("doc_id"), "doc_id", "left_anti").select("query_id", "doc_id", F.lit("stale").alias("state"))
    return omitted.unionByName(stale)


@query("derive_paths", "SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 2 WHEN conv_id % 3 = 1 THEN count(*) ELSE 0 END::INTEGER AS n_paths, CASE WHEN conv_id % 3 = 0 THEN string_agg(role, '+' ORDER BY turn) WHEN conv_id % 3 = 1 THEN min_by(role, turn) END AS first_path FROM conversations GROUP BY conv_id")
def derive_paths(spark, sf_dir):
    """A conversation's roles as anchors: given as two paths, given as anchors alone, or not given."""
    roles = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("s")).select("conv_id", F.col("s.role").alias("roles"))
    sets, anchors = F.when(F.col("conv_id") % 3 == 0, F.array("roles", F.array(F.lit("z")))), F.when(F.col("conv_id") % 3 < 2, F.col("roles"))
    p = roles.select("conv_id", audits.derived_paths(sets, anchors).alias("p"))
    return p.select("conv_id", F.size("p").alias("n_paths"), F.array_join(F.get("p", F.lit(0)), "+").alias("first_path"))


@query("subset_check", "SELECT conv_id, list_has_all(list(DISTINCT role), ['user', 'assistant']) AS complete FROM conversations GROUP BY conv_id")
def subset_check(spark, sf_dir):
    called = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("called"))
    return called.select("conv_id", (F.size(F.array_except(F.array(F.lit("user"), F.lit("assistant")), F.col("called"))) == 0).alias("complete"))


TOP_NS = (1, 2, 3, 5, 6)


@query(
    "ab_top_n",
    "WITH o AS (SELECT item_id AS query_id, top_n, coalesce(g <= top_n, false) AS passed FROM benchmark LEFT JOIN (SELECT query_id AS item_id, min(rank) AS g FROM {bm} SEMI JOIN {gold} USING (query_id, doc_id) GROUP BY 1) USING (item_id), (SELECT unnest([1, 2, 3, 5, 6])::INTEGER AS top_n)) SELECT o.top_n, count(*) AS n, count(*) FILTER (o.passed) AS passed, count(*) FILTER (o.passed AND NOT b.passed) AS rescued, count(*) FILTER (NOT o.passed AND b.passed) AS broken FROM o JOIN o b ON o.query_id = b.query_id AND b.top_n = 5 GROUP BY o.top_n",
)
def ab_top_n(spark, sf_dir):
    """How many documents go into the prompt: questions whose passage is among them, against five."""
    ranked = ranks(spark, sf_dir)
    values = spark.createDataFrame([(n,) for n in TOP_NS], "top_n int")
    outcomes = ranked.crossJoin(F.broadcast(values)).select("query_id", "top_n", F.coalesce(F.col("gold_rank") <= F.col("top_n"), F.lit(False)).alias("passed"))
    return metrics.ab_values(outcomes, "top_n", 5)


@query(
    "ab_lists",
    "WITH g AS (SELECT l, query_id, min(rank) AS g FROM (SELECT 'long' AS l, query_id, doc_id, rank FROM {bm} UNION ALL SELECT 'short', query_id, doc_id, rank FROM {bmh}) SEMI JOIN {gold} USING (query_id, doc_id) GROUP BY ALL), o AS (SELECT item_id AS query_id, l.l AS list, coalesce(g.g <= 3, false) AS passed FROM benchmark CROSS JOIN (VALUES ('long'), ('short')) l(l) LEFT JOIN g ON g.l = l.l AND g.query_id = item_id) SELECT o.list, count(*) AS n, count(*) FILTER (o.passed) AS passed, count(*) FILTER (o.passed AND NOT b.passed) AS rescued, count(*) FILTER (NOT o.passed AND b.passed) AS broken FROM o JOIN o b ON o.query_id = b.query_id AND b.list = 'long' GROUP BY o.list",
)
def ab_lists(spark, sf_dir):
    """Which form of a question is searched: twelve of its tokens or three."""
    both = ranks(spark, sf_dir).withColumn("list", F.lit("long")).unionByName(ranks(spark, sf_dir, 5, 3).withColumn("list", F.lit("short")))
    return metrics.ab_values(both.select("query_id", "list", F.coalesce(F.col("gold_rank") <= 3, F.lit(False)).alias("passed")), "list", "long")


@query(
    "ab_context_order",
    "WITH t AS (SELECT query_id, rank, doc_id, count(*) OVER (PARTITION BY query_id) AS n FROM {bm} WHERE rank <= 5), g AS (SELECT query_id, min(rank) AS r, any_value(n) AS n FROM t SEMI JOIN {gold} USING (query_id, doc_id) GROUP BY query_id) SELECT o AS context_order, count(*) AS n, round(avg(CASE o WHEN 'ranked' THEN r WHEN 'reversed' THEN n - r + 1 ELSE CASE WHEN n < 3 THEN n - r + 1 WHEN r = 1 THEN 1 ELSE n - r + 2 END END), 6) AS mean_place FROM g, (VALUES ('ranked'), ('reversed'), ('sandwich')) v(o) GROUP BY o",
)
def ab_context_order(spark, sf_dir):
    """Where in the prompt the best gold document first stands, by order."""
    found = w.best(spark, sf_dir, 5)
    lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id")))["doc_id"].alias("docs"))
    best = found.join(w.gold(spark, sf_dir), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min_by("doc_id", "rank").alias("doc_id"))
    orders = ("ranked", "reversed", "sandwich")
    place = F.explode(F.array(*[F.struct(F.lit(o).alias("context_order"), F.array_position(context.ordered(F.col("docs"), o), F.col("doc_id")).alias("place")) for o in orders]))
    return lists.join(best, "query_id").select(place.alias("p")).groupBy("p.context_order").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p.place"), 6).alias("mean_place"))


@query("pattern_audit", "SELECT item_id AS pattern_id, CASE WHEN item_id % 7 = 0 THEN CASE WHEN g IS NULL THEN 'refusal' ELSE 'leak' END WHEN g IS NOT NULL THEN 'ok' WHEN item_id % 5 = 0 THEN 'derived' ELSE 'dead' END AS state FROM benchmark LEFT JOIN (SELECT DISTINCT query_id AS item_id, true AS g FROM {gold}) USING (item_id)")
def pattern_audit(spark, sf_dir):
    """Whole passages as patterns; every fifth is taken as derived and every seventh as a refusal."""
    literal = F.concat(F.lit("\\Q"), F.col("text"), F.lit("\\E"))
    patterns = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pattern_id"), literal.alias("pattern"), (F.col("item_id") % 5 == 0).alias("derived"), (F.col("item_id") % 7 == 0).alias("expect_refusal"))
    return audits.pattern_states(patterns, table(spark, sf_dir, DOCS)).select("pattern_id", "state")


@query(
    "coverage_feasibility",
    f"WITH p AS ({PATHS}), c AS (SELECT p.query_id, p.path_id, CASE WHEN bool_or(g.doc_id IS NULL) THEN NULL WHEN EXISTS (SELECT 1 FROM {{gold}} x JOIN p y ON x.query_id = y.anchor_id WHERE y.query_id = p.query_id AND y.path_id = p.path_id GROUP BY x.doc_id HAVING count(DISTINCT y.anchor_id) = (SELECT count(*) FROM p z WHERE z.query_id = p.query_id AND z.path_id = p.path_id)) THEN 1 ELSE count(DISTINCT p.anchor_id) END AS size FROM p LEFT JOIN gold g ON g.query_id = p.anchor_id GROUP BY p.query_id, p.path_id) SELECT query_id, min(size)::INTEGER AS need, CASE WHEN min(size) IS NULL THEN 'unresolved' WHEN min(size) > 1 THEN 'infeasible' ELSE 'feasible' END AS state FROM c GROUP BY query_id",
)
def coverage_feasibility(spark, sf_dir):
    """Whether one document can hold a question's whole evidence (top_k 1); paths have two anchors, so the SQL needs no search."""
    covers = min_cover(spark, sf_dir).select("query_id", "path_id", F.size(F.split("cover", ",")).alias("size"))
    return audits.feasibility(covers.withColumn("size", F.when(F.col("size") > 0, F.col("size"))), 1)


@query(
    "pass_but_miss",
    "WITH s AS (SELECT item_id, text, EXISTS (SELECT 1 FROM {bmh} b SEMI JOIN {gold} USING (query_id, doc_id) WHERE b.rank <= 1 AND b.query_id = item_id) AS satisfied, EXISTS (SELECT 1 FROM {bm} b JOIN documents USING (doc_id) WHERE b.rank <= 6 AND b.query_id = item_id AND contains(documents.text, benchmark.text)) AS supported, (SELECT count(*) FROM bm b WHERE b.rank <= 6 AND b.query_id = item_id) AS n FROM benchmark) SELECT item_id AS query_id, CASE WHEN item_id % 2 = 1 OR satisfied THEN NULL WHEN supported THEN 'missing_label' WHEN n > 0 THEN 'ungrounded' ELSE 'unknown' END AS reason FROM s",
)
def pass_but_miss(spark, sf_dir):
    """Even questions count as passed; the short list's first document is the labelled evidence, the long list's six are the contexts."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("pattern"))
    gold = w.gold(spark, sf_dir)
    first = w.best(spark, sf_dir, 1, 5, 3).join(gold, ["query_id", "doc_id"], "left_semi").select("query_id", F.lit(True).alias("satisfied"))
    shown = w.best(spark, sf_dir, 6).join(table(spark, sf_dir, DOCS).select("doc_id", "text"), "doc_id").join(asked, "query_id")
    support = shown.groupBy("query_id").agg(F.max(F.contains("text", "pattern")).alias("supported"), F.count(F.lit(1)).alias("n"))
    rows = asked.select("query_id").join(first, "query_id", "left").join(support, "query_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return rows.select("query_id", audits.pass_but_miss(F.col("query_id") % 2 == 0, no("satisfied"), no("supported"), F.coalesce("n", F.lit(0))).alias("reason"))


@query(
    "profile_summary",
    "WITH t AS (SELECT user_id, sum(value) AS total, coalesce(sum(value) FILTER (event_type IN ('click', 'view')), 0) AS looped FROM events GROUP BY user_id) SELECT count(*) AS n_queries, round(100 * sum(looped) / sum(total), 4) AS loop_share, round(100 * avg((user_id % 3 = 0)::INTEGER), 4) AS rewrite_rate, round(quantile_cont(total, 0.5), 4) AS median_total, round(quantile_cont(total, 0.5) FILTER (user_id % 3 = 0), 4) AS median_rewritten, round(quantile_cont(total, 0.5) FILTER (user_id % 3 <> 0), 4) AS median_plain FROM t",
)
def profile_summary(spark, sf_dir):
    """A user's events are a query's steps; every third user's query counts as rewritten."""
    sums = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("sec"))
    traces = sums.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "sec"))).alias("timings"))
    return metrics.profile_summary(traces.withColumn("rewrites", F.when(F.col("user_id") % 3 == 0, 1).otherwise(0)), ("click", "view"))


@query("regrade", "SELECT doc_id, quality = 1 AS before, regexp_matches(text, '[0-9]') AS after FROM documents JOIN labels USING (doc_id) WHERE (quality = 1) <> regexp_matches(text, '[0-9]')")
def regrade(spark, sf_dir):
    """Stored answers graded again by their criteria (here: a digit); those whose grade flips."""
    stored = table(spark, sf_dir, DOCS).select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id")
    after = metrics.passes(F.col("text"), F.array(F.lit("[0-9]")), F.lit(None).cast("array<string>"), F.lit(False))
    return stored.select("doc_id", (F.col("quality") == 1).alias("before"), after.alias("after")).where("before <> after")


@query("sweep_chunk_size")
def sweep_chunk_size(spark, sf_dir):
    """By chunk size: chunks, their median length, recall of a chunk that holds the passage, and passages that no chunk holds whole."""
    docs = table(spark, sf_dir, DOCS).select("doc_id", "text")
    anchors = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("anchor"))
    rows = []
    for size, overlap in ((400, 50), (800, 100), (1600, 200)):
        pieces = docs.select("doc_id", F.posexplode(chunking.recursive_chunks(F.col("text"), size, overlap)).alias("pos", "piece"))
        pieces = written(pieces.select(F.struct("doc_id", "pos").alias("chunk"), F.col("piece").alias("text")), "pieces")
        held = metrics.anchor_hits(anchors, pieces, "chunk").select("query_id", "chunk").distinct()
        found = metrics.gold_rank(anchors, lexical.bm25_topk(pieces, w.questions(spark, sf_dir), "chunk", 6), held, "chunk")
        lost = anchors.select("query_id").join(held, "query_id", "left_anti").agg(F.count(F.lit(1)).alias("lost"))
        lengths = pieces.agg(F.count(F.lit(1)).alias("n_chunks"), F.median(F.length("text")).alias("median_chars"))
        rows.append(metrics.recall_mrr(found).crossJoin(F.broadcast(lost)).crossJoin(F.broadcast(lengths)).withColumn("size", F.lit(size)))  # a row each
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("retrieval_quadrants", "WITH h AS (SELECT DISTINCT query_id FROM {bmh} SEMI JOIN {gold} USING (query_id, doc_id) WHERE rank <= 6), t AS (SELECT DISTINCT query_id FROM {bm} SEMI JOIN {gold} USING (query_id, doc_id) WHERE rank = 1), r AS (SELECT item_id IN (SELECT query_id FROM h) AS retrieved, item_id IN (SELECT query_id FROM t) AS passed FROM benchmark) SELECT retrieved, passed, count(r.retrieved) AS n FROM (SELECT unnest([true, true, false, false]) AS retrieved, unnest([true, false, true, false]) AS passed) LEFT JOIN r USING (retrieved, passed) GROUP BY ALL")
def retrieval_quadrants(spark, sf_dir):
    """Evidence found by three words of a passage, against an answer taken from the first document for twelve."""
    gold = written(w.gold(spark, sf_dir), "gold")
    hit = lambda df, k, name: df.select("query_id", F.coalesce(F.col("gold_rank") <= k, F.lit(False)).alias(name))
    return metrics.quadrants(hit(ranks(spark, sf_dir, 5, 3, gold), 6, "retrieved").join(hit(ranks(spark, sf_dir, gold=gold), 1, "passed"), "query_id"))


@query("verdict_flips", "SELECT count(*) AS n_cases, count(*) FILTER (k > 1) AS flipped FROM (SELECT doc_id, count(DISTINCT v) AS k FROM (SELECT doc_id, unnest([contains(text[:length(text) // 2], '. '), contains(text[length(text) // 2 + 1:], '. '), contains(text, '. ')]) AS v FROM documents) GROUP BY doc_id)")
def verdict_flips(spark, sf_dir):
    """The same check made of a text's first half, its second half and the whole."""
    half = F.floor(F.length("text") / 2).cast("int")
    views = F.array(F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text")), F.col("text"))
    rows = table(spark, sf_dir, DOCS).select("doc_id", F.explode(views).alias("t")).select("doc_id", F.contains("t", F.lit(". ")).alias("v"))
    return metrics.flips(rows, "doc_id", "v")


def compared(spark, sf_dir, questions, arms, base, **hooks):
    """arm, n, passed, rescued, broken: through the engine, whether each question's passage is in its context, against the base arm.

    Arms ask the same questions: what they rank alike is ranked once, and documents that they find alike are read once. A batch of questions
    pays for no index: the texts are read once for all lists of all arms.
    """
    from ..engine import HYPO_VECTORS, Engine
    from ..functions.text import tokens

    chunks, marks = w.engine_texts(spark, sf_dir), w.engine_marks(spark, sf_dir)
    anchors = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("anchor"))
    listed, fused, out = {}, {}, None
    for arm, settings in arms.items():
        engine = Engine(chunks, settings, marks=marks, analyse=tokens, **hooks)
        # All that `Engine.lists` reads of the settings, but for hyde: lists of made-up passages come beside the others.
        ranking = tuple(getattr(settings, name) for name in ("top_k", "version_filter", "hyde_mode", "max_hypothetical_chars", "bm25_k1", "bm25_b", "bm25_epsilon"))
        if ranking not in listed:
            widest = replace(engine, settings=replace(settings, hyde=any(s.hyde for s in arms.values())))
            listed[ranking] = written(widest.lists(questions), "lists")
        finding = (*ranking, settings.rrf_k, settings.hyde)
        if finding not in fused:
            lists = listed[ranking] if settings.hyde else listed[ranking].where(F.col("list_id") < HYPO_VECTORS)
            fused[finding] = written(engine.fused(lists), "found")
        held = engine.contexts(questions, engine.reranked(questions, fused[finding])).join(anchors, "query_id")
        rows = held.select("query_id", F.lit(arm).alias("arm"), F.contains("context", "anchor").alias("passed"))
        out = rows if out is None else out.unionByName(rows)
    return metrics.ab_values(written(out, "arms"), "arm", base)


AB_SQL = "SELECT o.arm, count(*) AS n, count(*) FILTER (o.passed) AS passed, count(*) FILTER (o.passed AND NOT b.passed) AS rescued, count(*) FILTER (NOT o.passed AND b.passed) AS broken FROM o JOIN o b ON o.query_id = b.query_id AND b.arm = '{base}' GROUP BY o.arm"


@query(
    "ab_neighbor_window",
    "WITH p AS (SELECT e.query_id, max((contains(e.text, q.text))::INTEGER) AS own, max((contains(coalesce(d.text, ''), q.text))::INTEGER) AS near FROM {eng} e JOIN benchmark q ON q.item_id = e.query_id LEFT JOIN documents d ON d.source = e.source AND d.doc_id BETWEEN e.doc_id - 1 AND e.doc_id + 1 WHERE e.rank <= 3 GROUP BY e.query_id), o AS (SELECT item_id AS query_id, arm, CASE arm WHEN 'none' THEN coalesce(own, 0) ELSE coalesce(near, 0) END = 1 AS passed FROM benchmark CROSS JOIN (SELECT unnest(['none', 'one']) AS arm) LEFT JOIN p ON p.query_id = item_id) " + AB_SQL.format(base="none"),
)
def ab_neighbor_window(spark, sf_dir):
    """Contexts of three documents as they are, or widened by the documents beside them."""
    arms = {"none": Settings(generate_top_n=3, type_routing=False), "one": Settings(generate_top_n=3, neighbor_window=1, type_routing=False)}
    return compared(spark, sf_dir, w.questions(spark, sf_dir), arms, "none")


@query(
    "ab_rerank",
    "WITH e AS (SELECT query_id, text, rank, row_number() OVER (PARTITION BY query_id ORDER BY length(text), rank) AS shortest FROM {eng}), p AS (SELECT query_id, max((rank <= 2 AND contains(e.text, q.text))::INTEGER) AS off, max((shortest <= 2 AND contains(e.text, q.text))::INTEGER) AS on_ FROM e JOIN benchmark q ON q.item_id = e.query_id GROUP BY query_id), o AS (SELECT item_id AS query_id, arm, CASE arm WHEN 'off' THEN coalesce(off, 0) ELSE coalesce(on_, 0) END = 1 AS passed FROM benchmark CROSS JOIN (SELECT unnest(['off', 'shortest']) AS arm) LEFT JOIN p ON p.query_id = item_id) " + AB_SQL.format(base="off"),
)
def ab_rerank(spark, sf_dir):
    """Contexts of two documents in the fused order, or of the two shortest of the list (what stands in for a model)."""

    def shortest(rows):
        sized = F.transform("documents", lambda d, i: F.struct(F.length(d).alias("n"), i.alias("i")))
        return rows.withColumn("permutation", F.transform(F.array_sort(sized), lambda x: x["i"]))

    arms = {"off": Settings(generate_top_n=2, type_routing=False), "shortest": Settings(generate_top_n=2, type_routing=False, rerank=True)}
    return compared(spark, sf_dir, w.questions(spark, sf_dir), arms, "off", permute=shortest)


@query(
    "ab_hyde",
    "WITH l AS (SELECT query_id, doc_id, text, 0 AS l, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM {bmh} JOIN {ver} USING (doc_id) WHERE NOT superseded QUALIFY r <= 6 UNION ALL SELECT query_id, doc_id, text, 1, rank FROM {eng}), f AS (SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0::DOUBLE / (60 + r)), 9) DESC, min(l * 1000 + r)) AS rank FROM l GROUP BY query_id, text), p AS (SELECT item_id AS query_id, 'off' AS arm, count(*) FILTER (contains(l.text, q.text)) > 0 AS passed FROM benchmark q LEFT JOIN l ON l.query_id = item_id AND l = 0 AND r <= 3 GROUP BY item_id UNION ALL SELECT item_id, 'full', count(*) FILTER (contains(f.text, q.text)) > 0 FROM benchmark q LEFT JOIN f ON f.query_id = item_id AND rank <= 3 GROUP BY item_id), o AS (SELECT * FROM p) " + AB_SQL.format(base="off"),
)
def ab_hyde(spark, sf_dir):
    """Three words asked alone, or fused with a list for a made-up passage (here the first twelve words of the real one)."""
    longer = w.questions(spark, sf_dir).select("query_id", F.col("question").alias("raw"))
    arms = {"off": Settings(generate_top_n=3, type_routing=False), "full": Settings(generate_top_n=3, type_routing=False, hyde=True)}
    return compared(spark, sf_dir, w.questions(spark, sf_dir, 5, 3), arms, "off", hypothesize=lambda rows: rows.join(longer, "query_id", "left"))


@query("ab_route")
def ab_route(spark, sf_dir):
    """Questions with intents, routed by type or all alike. Without SQL: a test holds the routed contexts against the engine's parts."""
    arms = {"alike": Settings(generate_top_n=2, type_routing=False), "routed": Settings(generate_top_n=2)}
    return compared(spark, sf_dir, w.asked(spark, sf_dir), arms, "alike")
