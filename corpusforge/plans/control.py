"""Queries on routing, the loop, small parsers, caches, traces and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs
from ..operators import lexical, routing
from ..settings import DEFAULTS
from ..sources import store
from ..sources.shared import fresh, written
from ..streaming import cache, profiles, traces
from . import workload as w
from .workload import query, table

TYPE_SQL = f"CASE WHEN regexp_matches(question, '{T.COMPARISON}') THEN 'comparison' WHEN regexp_matches(question, '{T.AGGREGATION}') THEN 'aggregation' WHEN regexp_matches(question, '{T.ENUMERATION}') THEN 'enumeration' ELSE 'fact' END"


@query("route_classify", f"SELECT query_id, {TYPE_SQL} AS type FROM {{qa}}")
def route_classify(spark, sf_dir):
    return w.asked(spark, sf_dir).select("query_id", T.question_type(F.col("question")).alias("type"))


@query("route_strategy", f"SELECT query_id, type, CASE WHEN type IN ('aggregation', 'enumeration') THEN 1 ELSE 0 END::INTEGER AS neighbor_window, CASE WHEN type = 'aggregation' THEN 3 ELSE 5 END::INTEGER AS generate_top_n, type = 'comparison' AS use_team FROM (SELECT query_id, {TYPE_SQL} AS type FROM {{qa}})")
def route_strategy(spark, sf_dir):
    import dataclasses

    return routing.routed(w.asked(spark, sf_dir), dataclasses.replace(DEFAULTS, team_routing=True)).select("query_id", "type", "neighbor_window", "generate_top_n", "use_team")


@query(
    "loop_transitions",
    "SELECT doc_id, CASE WHEN rewrites >= 1 THEN 'generate' ELSE 'grade' END AS after_retrieve, CASE WHEN sufficient OR rewrites >= 1 THEN 'generate' ELSE 'rewrite' END AS after_grade, CASE WHEN failed THEN 'generate' ELSE 'retrieve' END AS after_rewrite FROM (SELECT doc_id, (doc_id % 2)::INTEGER AS rewrites, toxic = 0 AS sufficient, rewrote AS failed FROM {ans})",
)
def loop_transitions(spark, sf_dir):
    rows = w.answers(spark, sf_dir)
    rewrites, grade = (F.col("doc_id") % 2).cast("int"), F.when(F.col("toxic") == 0, "sufficient").otherwise("insufficient")
    return rows.select("doc_id", routing.after_retrieve(rewrites).alias("after_retrieve"), routing.after_grade(grade, rewrites).alias("after_grade"), routing.after_rewrite(F.col("rewrote")).alias("after_rewrite"))


@query("grade_fail_open", "SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'insufficient' ELSE 'sufficient' END AS verdict FROM documents")
def grade_fail_open(spark, sf_dir):
    said = F.element_at(F.array(F.lit("yes"), F.lit(" No, it is not"), F.lit("??"), F.lit(None).cast("string")), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", routing.verdict(said).alias("verdict"))


@query("corrective_loop", "SELECT q.query_id, (f.query_id IS NULL)::INTEGER AS rewrites, CASE WHEN f.query_id IS NULL THEN q.question ELSE qh.question END AS query FROM {q} JOIN {qh} USING (query_id) LEFT JOIN (SELECT DISTINCT query_id FROM {bmh} SEMI JOIN {gold} USING (query_id, doc_id) WHERE rank <= 6) f USING (query_id)")
def corrective_loop(spark, sf_dir):
    """Three words of each passage are asked. Where none of the six documents found holds the passage, twelve words are asked instead."""
    docs, gold = table(spark, sf_dir, "documents"), written(w.gold(spark, sf_dir), "gold")
    longer = w.questions(spark, sf_dir).select("query_id", F.col("question").alias("new_query"))

    def retrieve(rows):
        found = lexical.bm25_topk(docs, rows.select("query_id", F.col("query").alias("question")), "doc_id", 6)
        return rows.join(found.groupBy("query_id").agg(F.collect_list("doc_id").alias("documents")), "query_id", "left")

    def grade(rows):
        good = rows.select("query_id", F.explode("documents").alias("doc_id")).join(gold, ["query_id", "doc_id"], "left_semi").select("query_id").distinct()
        return rows.join(good.withColumn("good", F.lit("yes")), "query_id", "left").withColumn("judged", F.coalesce("good", F.lit("no"))).drop("good")

    rewrite = lambda rows: rows.join(longer, "query_id", "left")
    out = routing.corrective_loop(w.questions(spark, sf_dir, 5, 3), retrieve, grade, rewrite, settle=lambda df: written(df, "loop"))
    return out.select("query_id", "rewrites", "query")


FOREIGN_TAIL = " 这是一个中文句子。 古語 하나는 남는다."
SPLIT_SQL = "list_filter(string_split_regex(regexp_replace(t, '([.!?。])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')"


@query(
    "script_filter",
    f"""WITH d AS (SELECT conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN '{FOREIGN_TAIL}' ELSE '' END AS t FROM conversations),
    k AS (SELECT *, regexp_replace(array_to_string(list_filter({SPLIT_SQL}, lambda x: length(x) - length(regexp_replace(x, '[一-鿿]', '', 'g')) < 3), ' '), '^\\s+|\\s+$', '', 'g') AS kept FROM d)
    SELECT conv_id, turn, md5(CASE WHEN regexp_matches(t, '[一-鿿]') AND length(kept) >= 20 THEN kept ELSE t END) AS text_md5 FROM k""",
)
def script_filter(spark, sf_dir):
    """Every other turn has slipped into a foreign script."""
    text = F.concat("text", F.when(F.col("turn") % 2 == 0, FOREIGN_TAIL).otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.keep_script(text).cast("binary")).alias("text_md5"))


@query("clean_rewrite", "SELECT query_id, CASE query_id % 5 WHEN 1 THEN NULL WHEN 3 THEN NULL ELSE question END AS query FROM {q}")
def clean_rewrite(spark, sf_dir):
    """Questions as a model would give them back: labelled and quoted, unchanged, after an announcement, announced only, among blank lines."""
    q = F.col("question")
    said = [F.concat(F.lit('재작성된 질문: "'), q, F.lit('"')), q, F.concat(F.lit("다음과 같습니다:\n"), q, F.lit("\nmore")), F.lit("안내:"), F.concat(F.lit("\n\n  '"), q, F.lit("'  "))]
    raw = F.get(F.array(*said), (F.col("query_id") % 5).cast("int"))
    original = F.when(F.col("query_id") % 5 == 1, q).otherwise(F.lit("what was asked"))
    return w.questions(spark, sf_dir).select("query_id", T.clean_rewrite(raw, original).alias("query"))


@query("timings_merge", "SELECT user_id, event_type AS step, round(sum(value), 4) AS seconds FROM events GROUP BY ALL")
def timings_merge(spark, sf_dir):
    """Two maps a user, of even and odd events, added step by step."""
    events = table(spark, sf_dir, "events")
    sums = events.groupBy("user_id", "event_type", (F.col("event_id") % 2).alias("half")).agg(F.sum("value").alias("v"))
    maps = sums.groupBy("user_id").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("half") == h, F.struct("event_type", "v")))).alias(f"m{h}") for h in (0, 1)])
    return maps.select("user_id", F.explode(routing.merged_timings(F.col("m0"), F.col("m1"))).alias("step", "seconds")).withColumn("seconds", F.round("seconds", 4))


@query("plan_parse", "SELECT query_id, CASE query_id % 4 WHEN 0 THEN p[1] || '|' || p[2] WHEN 2 THEN p[1] || '|' || p[2] || '|' || p[3] ELSE question END AS questions FROM (SELECT query_id, question, string_split(question, ' ') AS p FROM {q})")
def plan_parse(spark, sf_dir):
    """Plans as a model would write them, from each question's words: with talk around, none, too many parts, cut off."""
    word, q = (lambda i: F.get(F.split("question", " "), F.lit(i))), F.col("question")
    plans = [F.concat(F.lit('Sure: [" '), word(0), F.lit(' ", "'), word(1), F.lit('", ""] done')), q, F.concat(F.lit("["), F.array_join(F.transform(F.split(q, " "), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]")), F.concat(F.lit('["'), word(0))]
    raw = F.get(F.array(*plans), (F.col("query_id") % 4).cast("int"))
    return w.questions(spark, sf_dir).select("query_id", F.array_join(T.parse_plan(raw, q), "|").alias("questions"))


FIRST_SENTENCE = "regexp_replace(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n{2,}')[1], '^\\s+|\\s+$', '', 'g')"


@query("fanout_fanin", f"SELECT conv_id AS query_id, md5(string_agg({FIRST_SENTENCE}, '|' ORDER BY turn)) AS answers_md5, array_to_string(list_sort(list_distinct(list(role))), ',') AS sources, count(*) = 1 AS single FROM conversations GROUP BY conv_id")
def fanout_fanin(spark, sf_dir):
    """Turns as parts of a question; the stand-in model answers with a part's first sentence."""
    turns = table(spark, sf_dir, "conversations")
    plans = turns.groupBy(F.col("conv_id").alias("query_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "text", "role"))).alias("s")).select("query_id", F.col("s").alias("sub_questions"))
    answered = routing.fan_out(plans).select("query_id", "pos", F.get(T.sentences(F.col("question.text")), F.lit(0)).alias("answer"), F.array("question.role").alias("sources"))
    return routing.fan_in(answered).select("query_id", F.md5(F.array_join("answers", "|").cast("binary")).alias("answers_md5"), F.array_join("sources", ",").alias("sources"), "single")


@query(
    "calculate",
    "SELECT l_orderkey, l_linenumber, round(CASE l_linenumber % 4 WHEN 0 THEN (l_quantity - l_linenumber) / l_linenumber * 100 WHEN 1 THEN l_linenumber ** 2 ** 2 - -l_quantity WHEN 2 THEN NULL ELSE 2 * (l_quantity + 3) - 10 / (l_linenumber + 1) END, 6) AS result FROM lineitem",
)
def calculate(spark, sf_dir):
    """Arithmetic written out from each order line; every fourth isn't arithmetic and gives nothing."""
    n, q = F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string")
    forms = [F.concat(F.lit("("), q, F.lit("-"), n, F.lit(")/"), n, F.lit("*100")), F.concat(n, F.lit("**2**2 - -"), q), F.concat(F.lit("price of "), n), F.concat(F.lit("2*("), q, F.lit(" + 3) - 10/("), n, F.lit("+1)"))]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.get(F.array(*forms), F.col("l_linenumber") % 4).alias("expression"))
    return rows.select("l_orderkey", "l_linenumber", F.round(udfs.calculate("expression").try_cast("double"), 6).alias("result"))


@query("nfkc")
def nfkc(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(udfs.nfkc("text").cast("binary")).alias("text_md5"))


@query("cache_lookup", "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN md5(text) END AS payload FROM benchmark")
def cache_lookup(spark, sf_dir):
    """Every third question's answer is written into the cache by a stream; then all questions are looked up."""
    folder = fresh(spark, "cache")
    key = store.cache_key(F.lit(DEFAULTS.fingerprint()), F.lit("index"), F.col("text"))
    questions = table(spark, sf_dir, "benchmark")
    stream = spark.readStream.schema(questions.schema).option("pathGlobFilter", "benchmark*.parquet").parquet(sf_dir)
    answered = stream.where("item_id % 3 = 0").select(key.alias("cache_key"), F.md5(F.col("text").cast("binary")).alias("payload"), F.timestamp_seconds(F.lit(0)).alias("at"))
    cache.feed(answered, folder, fresh(spark, "cache-checkpoint")).awaitTermination()
    kept = cache.current(cache.entries(spark, folder), F.current_timestamp()).drop("at")
    cached, new = store.cached_and_new(questions.select("item_id", key.alias("cache_key")), kept)
    return cached.select("item_id", "payload").unionByName(new.select("item_id", F.lit(None).cast("string").alias("payload")))


@query("trace_rollup", "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def trace_rollup(spark, sf_dir):
    return traces.rollup(traces.timed(table(spark, sf_dir, "events"))).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("trace_rollup_stream", "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def trace_rollup_stream(spark, sf_dir):
    """The same roll-up by Structured Streaming over the file as it lies there."""
    import uuid

    name = f"trace_rollup_{uuid.uuid4().hex}"
    traces.run_to_table(traces.rollup(traces.read(spark, sf_dir, "events.parquet")), name, "complete", fresh(spark, name))
    return spark.table(name).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


IDLE_SQL = """WITH s AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 24 HOUR, true) AS new FROM events)),
    g AS (SELECT user_id, s, count(*) AS n, round(sum(value), 4) AS total, max(ts) AS until, max(s) OVER (PARTITION BY user_id) AS last FROM s GROUP BY user_id, s)
    SELECT user_id, n, total, until FROM g WHERE s < last OR until + INTERVAL 25 HOUR <= (SELECT max(ts) FROM events)"""


@query("idle_profiles", IDLE_SQL)
def idle_profiles(spark, sf_dir):
    """A stream of events as profiles of users, given out once idle for a day; users still active stay in the state."""
    import uuid

    name = f"idle_profiles_{uuid.uuid4().hex}"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", profiles.PROVIDER)
    try:
        traces.run_to_table(profiles.profiles(traces.read(spark, sf_dir, "events.parquet")), name, "append", fresh(spark, name))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.table(name).select("user_id", "n", F.round("total", 4).alias("total"), F.col("until").cast("timestamp_ntz").alias("until"))


@query("trace_sliding", "SELECT (date_trunc('day', ts) - to_days(k::INTEGER))::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def trace_sliding(spark, sf_dir):
    return traces.sliding(traces.timed(table(spark, sf_dir, "events"))).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("trace_sessions", "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM (SELECT *, sum(new::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR, true) AS new FROM events)) GROUP BY user_id, s")
def trace_sessions(spark, sf_dir):
    out = traces.sessions(traces.timed(table(spark, sf_dir, "events")))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})
