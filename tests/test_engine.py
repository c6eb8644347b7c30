"""The engine with every model plugged in: small functions stand for the models, and rows are counted by hand."""

import json

import pytest
from pyspark.sql import functions as F

from corpusforge.engine import Engine
from corpusforge.functions.text import tokens
from corpusforge.operators import kgraph, lexical, routing
from corpusforge.settings import Settings
from corpusforge.sources import store

TEXTS = ["spark shuffles rows by key", "arrow moves batches to python", "parquet keeps columns apart", "catalyst rewrites a plan", "parquet files hold row groups"]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, f"s{i}", "current", False, None, t, f"m{i}", [float(i == j) for j in range(5)]) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "chunk_index int, source string, version string, superseded boolean, kind string, page_content string, md5 string, embedding array<double>")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, question string")


def towards(i):
    return lambda df: df.withColumn("query_vector", F.array(*[F.lit(float(i == j)) for j in range(5)]))


def ranked(rows):
    return [(r["query_id"], r["chunk_index"]) for r in sorted(rows.collect(), key=lambda r: (r["query_id"], r["rank"]))]


def test_vectors_and_words_are_fused_and_vectors_win_ties(spark, chunks):
    lists = Engine(chunks, Settings(top_k=1), embed=towards(1)).lists(asked(spark, "catalyst plan")).collect()
    assert sorted((r["list_id"], r["chunk_index"]) for r in lists) == [(0, 1), (1, 3)]
    assert ranked(Engine(chunks, Settings(top_k=2), embed=towards(1)).search(asked(spark, "catalyst plan")))[0] == (0, 1)


def test_full_width_questions_find_plain_text_and_analysers_plug_in(spark, chunks):
    wide = "ｃａｔａｌｙｓｔ"
    assert ranked(Engine(chunks).search(asked(spark, wide))) == [(0, 3)]
    assert ranked(Engine(chunks, analyse=tokens).search(asked(spark, wide))) == []
    by_letters = lambda c: F.filter(F.split(c, ""), lambda x: x == "q")
    assert [r["chunk_index"] for r in lexical.bm25_topk(chunks, asked(spark, "quiz"), "chunk_index", 9, "page_content", analyse=by_letters).collect()] == [2, 4]


def test_hypothetical_text_adds_lists(spark, chunks):
    say = lambda text: lambda df: df.withColumn("raw", F.lit(text))
    q = asked(spark, "catalyst")
    assert {c for _, c in ranked(Engine(chunks, Settings(hyde=True), hypothesize=say("arrow batches")).search(q))} == {1, 3}
    assert {c for _, c in ranked(Engine(chunks, Settings(hyde=True, hyde_mode="terms"), hypothesize=say("catalyst arrow")).search(q))} == {1, 3}
    assert {c for _, c in ranked(Engine(chunks, Settings(hyde=True, hyde_mode="terms"), hypothesize=say("catalyst")).search(q))} == {3}
    both = Engine(chunks, Settings(hyde=True, top_k=1), embed=towards(0), hypothesize=say("arrow batches")).lists(q)
    assert sorted((r["list_id"], r["chunk_index"]) for r in both.collect()) == [(0, 0), (1, 3), (2, 0), (3, 1)]


def test_lists_asked_together_are_the_lists_asked_apart(spark, chunks, monkeypatch):
    calls = []
    monkeypatch.setattr(lexical, "bm25_topk", lambda *a, _was=lexical.bm25_topk, **k: calls.append(1) or _was(*a, **k))
    q, said = asked(spark, "parquet row", "zzz", "a plan to python"), "parquet batches by key"
    listed = lambda rows: sorted((r["query_id"], r["list_id"], r["rank"], r["key"]) for r in rows.collect())
    both = listed(Engine(chunks, Settings(hyde=True), hypothesize=lambda df: df.withColumn("raw", F.lit(said)), analyse=tokens).lists(q))
    assert len(calls) == 1
    plain = listed(Engine(chunks, analyse=tokens).lists(q))
    made_up = listed(Engine(chunks, analyse=tokens).lists(q.withColumn("question", F.lit(said))))
    assert both == sorted(plain + [(i, 3, *rest) for i, _, *rest in made_up]) and plain and made_up


def test_permutation_reorders(spark, chunks):
    q = asked(spark, "parquet row groups")
    plain = ranked(Engine(chunks).search(q))
    turned = Engine(chunks, Settings(rerank=True), permute=lambda df: df.withColumn("permutation", F.reverse(F.sequence(F.lit(0), F.size("documents") - 1)))).search(q)
    assert len(plain) == 2 and ranked(turned) == plain[::-1]


def test_insufficient_documents_lead_to_one_rewrite(spark, chunks):
    grade = lambda df: df.withColumn("judged", F.when(F.col("query_id") == 0, "no").otherwise("yes"))
    rewrite = lambda df: df.withColumn("new_query", F.lit("arrow"))
    got = Engine(chunks, grade=grade, rewrite=rewrite).ask(asked(spark, "nothing here", "catalyst plan"))
    assert {r["query_id"]: r["sources"] for r in got.collect()} == {0: ["s1"], 1: ["s3"]}


def test_questions_without_documents_are_answered_too(spark, chunks):
    rows = Engine(chunks).ask(asked(spark, "zzz", "")).collect()
    assert [(r["context"], r["sources"], r["grounded"]) for r in rows] == [("", [], None)] * 2
    assert Engine(chunks).ask(asked(spark, "zzz").where("false")).count() == 0


def test_verdicts_are_recorded_and_never_change_the_answer(spark):
    said = spark.createDataFrame([(0, "a", '{"grounded": true, "unsupported_claim": ""}'), (1, "b", '{"grounded": false, "unsupported_claim": "x"}'), (2, "c", "no json"), (3, None, None)], "query_id long, answer string, s string")
    judge = lambda df: df.withColumn("raw", F.col("s"))
    on = routing.verified(said, judge, Settings(verify_grounding=True)).orderBy("query_id").collect()
    assert [(r["answer"], r["grounded"], r["unsupported_claim"]) for r in on] == [("a", True, None), ("b", False, "x"), ("c", None, None), (None, None, None)]
    assert all(r["grounded"] is None for r in routing.verified(said, judge, Settings()).collect())


def test_only_lost_answers_are_repaired(spark):
    good, foreign = "이 문장은 한국어로 쓰여 있고 충분히 길다.", "这是一个中文句子。"
    rows = spark.createDataFrame([(0, f"{good} {foreign}"), (1, foreign), (2, f"x{foreign}"), (3, None), (4, "plain")], "query_id long, answer string")
    seen = []

    def repair(df):
        seen.extend(r["query_id"] for r in df.collect())
        return df.withColumn("repaired", F.when(F.col("query_id") == 1, "짧다").otherwise(F.lit(foreign)))

    got = {r["query_id"]: r["answer"] for r in routing.repaired(rows, repair).collect()}
    assert got == {0: good, 1: "짧다", 2: f"x{foreign}", 3: None, 4: "plain"} and sorted(seen) == [1, 2]


def test_comparisons_are_taken_apart(spark, chunks):
    plan = lambda df: df.withColumn("raw", F.lit('["catalyst plan", "arrow batches"]'))
    q = asked(spark, "둘 중 더 빠른 것", "keeps columns")
    got = {r["query_id"]: r for r in Engine(chunks, Settings(team_routing=True), plan=plan).ask(q).collect()}
    assert got[0]["answer"] == f"{TEXTS[3]}\n\n{TEXTS[1]}" and got[0]["sources"] == ["s1", "s3"]
    assert got[1]["answer"] == TEXTS[2]
    one = Engine(chunks, Settings(team_routing=True), plan=lambda df: df.withColumn("raw", F.lit("none"))).ask(asked(spark, "arrow spark 중 더")).collect()
    assert one[0]["sources"] == ["s0", "s1"]


def test_search_text_names_sources(spark, chunks):
    assert [r["text"] for r in Engine(chunks).search_text(asked(spark, "catalyst")).collect()] == [f"[s3] {TEXTS[3]}"]


def test_triples_of_a_model(spark, chunks):
    many = json.dumps([{"subject": f"A{i}", "relation": "r", "object": "B"} for i in range(12)])
    said = F.when(F.col("chunk_index") == 0, many).when(F.col("chunk_index") == 1, "[{").when(F.col("chunk_index") == 2, '[{"subject": "x", "relation": "r"}]')
    got = kgraph.extracted(chunks, lambda df: df.withColumn("raw", said)).collect()
    assert [(r["subject"], r["chunk_index"], r["source"]) for r in got] == [(f"A{i}", 0, "s0") for i in range(8)]


def test_templates_cover_the_relations(spark):
    assert len(kgraph.TEMPLATES) == 29 and all("{s}" in t for t in kgraph.TEMPLATES.values())
    rows = spark.createDataFrame([(0, "서울", "org:founded", "x"), (1, "회사", "org:founded", "x"), (2, "회사", "no_relation", "x")], "chunk_index int, subject string, relation string, object string")
    assert [r["question"] for r in kgraph.questions_of(rows).orderBy("query_id").collect()] == ["서울은 언제 설립되었나요?", "회사는 언제 설립되었나요?"]


def test_stores_give_back_what_was_saved_and_replace(spark, chunks, tmp_path):
    folder = str(tmp_path)
    embed = lambda df: df.withColumn("embedding", F.array(F.col("chunk_index").cast("float"), F.lit(1.0)))
    for _ in range(2):
        store.build_vectors(chunks.drop("embedding"), embed, folder)
    assert [(r["vec_id"], r["embedding"], r["source"]) for r in store.load_vectors(spark, folder).orderBy("vec_id").collect()] == [(i, [float(i), 1.0], f"s{i}") for i in range(5)]
    triples = spark.createDataFrame([("A", "r", "B", 0, "s"), ("A", "r", "B", 0, "s")], "subject string, relation string, object string, chunk_index int, source string")
    edges = kgraph.edges(triples)
    store.save_graph(kgraph.nodes(edges), edges, folder)
    n, e = store.load_graph(spark, folder)
    assert sorted(r["name"] for r in n.collect()) == ["a", "b"] and e.count() == 2
    store.write_manifest(store.manifest(chunks, Settings()), folder)
    assert store.consistency(store.manifest(chunks, Settings()), store.read_manifest(spark, folder)).collect()[0]["status"] == "ok"
    store.write_chunks(chunks.drop("embedding"), folder)
    assert store.read_chunks_json(spark, f"{folder}/chunks.jsonl").count() == 5


def test_run_fingerprint_holds_knobs_and_versions(spark):
    got = Settings(top_k=3).run_fingerprint(spark.version, {"llm": "m"}, {"chunks_md5": "x", "n_chunks": 5})
    assert got["settings"]["top_k"] == 3 and got["versions"]["spark"] == spark.version and got["index_chunks_md5"] == "x" and got["host"]["os"]


def test_merged_team_answers_are_mended_and_judged_on_the_contexts_of_their_parts(spark, chunks):
    plan = lambda df: df.withColumn("raw", F.lit(json.dumps(["arrow batches", "parquet columns"])))
    judge = lambda df: df.withColumn("raw", F.when(F.contains("context", F.lit("arrow moves")) & F.contains("context", F.lit("parquet keeps")), F.lit('{"grounded": true}')).otherwise(F.lit('{"grounded": false, "unsupported_claim": "x"}')))
    merge = lambda df: df.withColumn("answer", F.concat(F.array_join("answers", " and "), F.lit(", so both. 这是一个中文句子。")))
    repair = lambda df: df.withColumn("repaired", F.col("answer"))
    engine = Engine(chunks, Settings(team_routing=True, verify_grounding=True), plan=plan, judge=judge, synthesize=merge, repair=repair, analyse=tokens)
    got = {r["query_id"]: r for r in engine.ask(asked(spark, "arrow parquet 중 더", "catalyst plan")).collect()}
    assert got[0]["grounded"] is True and "arrow moves" in got[0]["context"] and "parquet keeps" in got[0]["context"]
    assert got[0]["answer"].endswith("so both.") and "中" not in got[0]["answer"]
    assert got[1]["grounded"] is False and got[1]["unsupported_claim"] == "x"


@pytest.mark.parametrize("window", [0, 1])
def test_contexts_move_no_texts(spark, tmp_path, monkeypatch, window):
    """Without a window the texts aren't read again; with one, places are sent to them, also where the kept texts are too large to be sent."""
    from corpusforge import engine as module

    rows = spark.range(2000).select(F.col("id").alias("chunk_index"), F.lit("s").alias("source"), F.lit("current").alias("version"), F.lit(False).alias("superseded"), F.lit(None).cast("string").alias("kind"), F.repeat(F.sha2(F.col("id").cast("string"), 512), F.lit(50)).alias("page_content"), F.col("id").cast("string").alias("md5"))
    rows.write.parquet(str(tmp_path / "c"))
    chunks = spark.read.parquet(str(tmp_path / "c"))
    questions = asked(spark, *[f"question {i}" for i in range(20)])
    found = chunks.where("chunk_index < 20").select("*", F.col("chunk_index").alias("query_id"), F.lit(1).alias("rank"))
    found.coalesce(1).write.parquet(str(tmp_path / "found"))
    plans, was = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or was(df, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50000")
    try:
        out = Engine(chunks, Settings(generate_top_n=1, neighbor_window=window, type_routing=False), analyse=tokens).contexts(questions, spark.read.parquet(str(tmp_path / "found")))
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        got = {r["query_id"]: r["context"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    reading = [p for p in plans if f"{tmp_path}/c]" in p]
    assert len(reading) == window and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in reading)
    texts = [r["page_content"] for r in chunks.where("chunk_index < 21").orderBy("chunk_index").collect()]
    assert got == {i: "\n".join(texts[max(0, i - window) : i + window + 1]) for i in range(20)}
