"""Stored index, versioned artefacts, passage search and ordinals."""

import random

import pytest
from pyspark.sql import functions as F

from corpusforge.engine import Engine
from corpusforge.functions.text import tokens
from corpusforge.operators import chunking, lexical, passages
from corpusforge.settings import Settings
from corpusforge.sources import postings
from corpusforge.sources.catalog import Catalog, Conflict


def word(i):
    """A word of letters alone: the tokenizer takes digits apart."""
    return "q" + chr(97 + i // 26) + chr(97 + i % 26)


def corpus(spark, n, seed, first=0):
    r = random.Random(seed)
    vocabulary = [word(i) for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(first + i, None if i % 41 == 7 else " ".join(r.choices(vocabulary, weights, k=r.randrange(0, 60)))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def asked(spark):
    texts = [" ".join(map(word, x)) for x in ((3, 250, 17), (1, 1, 2), (299,), (600,), (), (0, 0, 0), (120, 121, 122, 0))]
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, question string")


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("span", [16, 4096])
def test_stored_search_equals_bm25(spark, tmp_path, monkeypatch, span):
    monkeypatch.setattr(postings, "SPAN", span)
    monkeypatch.setattr(postings, "PER_BUCKET", 8 * span)
    a, b = corpus(spark, 400, 1), corpus(spark, 150, 2, 1000)
    postings.append(spark, str(tmp_path / "i"), a, "doc_id")
    first = postings.opened(spark, str(tmp_path / "i"))
    index = postings.append(spark, str(tmp_path / "i"), b, "doc_id")
    questions = asked(spark)
    assert rows_of(postings.search(index, questions, 5)) == rows_of(lexical.bm25_topk(a.unionByName(b), questions, "doc_id", 5))
    # The snapshot before the second segment still answers for the first alone.
    assert rows_of(postings.search(first, questions, 5)) == rows_of(lexical.bm25_topk(a, questions, "doc_id", 5))


def test_spans_are_skipped_and_few_bytes_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SPAN", 8)
    monkeypatch.setattr(postings, "PER_BUCKET", 25)
    docs = corpus(spark, 1500, 3)
    index = postings.append(spark, str(tmp_path / "i"), docs, "doc_id")
    read = {r["query_id"]: r for r in postings.reading(index, asked(spark).where("query_id in (0, 2)"), 3).collect()}
    assert read[0]["spans"] > 100 and read[0]["spans_read"] < read[0]["spans"] / 4
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(index.snapshot.folders("words.postings")[0]).select("path", "length").collect()
    bucket = docs.select(postings.bucket(F.lit(word(299)), index.manifest["buckets"])).first()[0]
    one = sum(s["length"] for s in sizes if f"bucket={bucket}/" in s["path"])
    assert 0 < one < sum(s["length"] for s in sizes) / 10
    plan = index.postings([bucket])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or f"bucket#" in plan.split("PartitionFilters")[1][:80]


def test_empty_index(spark, tmp_path):
    index = postings.append(spark, str(tmp_path / "i"), corpus(spark, 0, 1), "doc_id")
    assert postings.search(index, asked(spark), 3).count() == 0
    grown = postings.append(spark, str(tmp_path / "i"), corpus(spark, 50, 1), "doc_id")
    assert rows_of(postings.search(grown, asked(spark), 3)) == rows_of(lexical.bm25_topk(corpus(spark, 50, 1), asked(spark), "doc_id", 3))


def test_engine_reads_the_stored_index(spark, tmp_path):
    texts = ["spark shuffles rows by key", "arrow moves batches to python", "parquet keeps columns apart", "parquet files hold row groups"]
    chunks = spark.createDataFrame([(i, f"s{i}", "current", False, None, t, f"m{i}", [float(i == j) for j in range(4)]) for i, t in enumerate(texts)], "chunk_index long, source string, version string, superseded boolean, kind string, page_content string, md5 string, embedding array<double>")
    index = postings.append(spark, str(tmp_path / "i"), chunks, "chunk_index", "page_content", tokens)
    embed = lambda df: df.withColumn("query_vector", F.array(*[F.lit(float(j == 1)) for j in range(4)]))
    questions = spark.createDataFrame([(0, "parquet columns"), (1, "shuffles")], "query_id long, question string")
    stored = Engine(chunks.drop("embedding"), Settings(top_k=2), analyse=tokens, embed=embed, index=index, vectors=chunks.select(F.col("chunk_index").alias("vec_id"), "embedding"))
    plain = Engine(chunks, Settings(top_k=2), analyse=tokens, embed=embed)
    seen = lambda e: sorted((r["query_id"], r["rank"], r["chunk_index"]) for r in e.search(questions).collect())
    assert seen(stored) == seen(plain) and len(seen(stored)) == 4


def test_catalog_pins_readers_and_refuses_stale_writers(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    assert c.snapshot().version == 0 and c.versions() == []
    one = c.write("fixed", spark.range(3).toDF("x"), {"fingerprint": "a"})
    both = c.write("parents", spark.range(5).toDF("x"))
    reader = c.read("fixed", one)
    new = c.write("fixed", spark.range(10).toDF("x"), {"fingerprint": "b"})
    assert reader.count() == 3 and c.read("fixed").count() == 10 and c.read("parents", new).count() == 5
    assert c.snapshot(2).artefacts == both.artefacts and c.versions() == [1, 2, 3]
    with pytest.raises(Conflict):
        c.publish(both, {})
    assert c.require("fixed", "b").version == 3
    with pytest.raises(ValueError, match="built from b"):
        c.require("fixed", "a")
    with pytest.raises(KeyError):
        c.snapshot(9)
    with pytest.raises(KeyError):
        c.read("absent")
    gone = c.vacuum(keep=1)
    assert len(gone) == 1 and c.versions() == [3] and c.read("fixed").count() == 10 and c.read("parents").count() == 5


@pytest.mark.parametrize("inline", [1000, 2])
def test_passages(spark, inline):
    r = random.Random(5)
    words = ["a", "bb", "ccc", "", "d\ne", "ccc"]
    texts = [" ".join(r.choices(words, k=r.randrange(1, 30))) for _ in range(120)] + [None, "", "xccc bb y"]
    anchors = [" ".join(r.choices(words, k=r.randrange(1, 7))) for _ in range(40)] + [None, "", "c", "cc bb", "zz top zz", "   "]
    chunks = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts)], "k long, text string, more int")
    asked = spark.createDataFrame(list(enumerate(anchors)), "id long, anchor string")
    got = sorted((x["k"], x["id"]) for x in passages.containing(chunks, asked, inline=inline).collect())
    assert got == sorted((i, j) for i, t in enumerate(texts) for j, a in enumerate(anchors) if t is not None and a is not None and a in t)


def test_long_passages_need_no_comparison_of_all_with_all(spark):
    chunks = spark.createDataFrame([(1, "one two three four")], "k long, text string")
    found = passages.containing(chunks, spark.createDataFrame([(1, "two three four")], "id long, anchor string"))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 1


def test_ordinals(spark):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.6 else f"s{r.randrange(40)}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "source string, n int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chunking.with_positions(df, "source", ["n"])
        placed = sorted((x["chunk_index"], x["source"], x["n"], x["doc_index"], x["doc_total"]) for x in got.collect())
        parts = chunking.dealt(df, ["source", "n"]).groupBy(F.shiftright("_at", chunking.ROW_BITS)).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, size = sorted(rows), {s: sum(x[0] == s for x in rows) for s, _ in rows}
    first = {s: next(i for i, x in enumerate(want) if x[0] == s) for s in size}
    assert placed == [(i, s, n, i - first[s], size[s]) for i, (s, n) in enumerate(want)]
    # A source with most rows is dealt over several partitions.
    assert len(parts) >= 3 and max(p["count"] for p in parts) < 1500


def test_parents_of_whole_blocks_are_themselves(spark):
    text = "# Plan\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\n\n" + "prose goes on here. " * 60
    rows = chunking.parent_child(spark.createDataFrame([("s", text)], "source string, text string")).collect()
    block = [x for x in rows if x["kind"] == "table"]
    assert len(block) == 1 and block[0]["parent"] == block[0]["child"] and block[0]["child"].startswith("# Plan\n\n| a | b |")
    prose = [x for x in rows if x["kind"] is None]
    assert len(prose) > 3 and all(x["child"] in x["parent"] for x in prose) and len({x["parent_id"] for x in rows}) == len({x["parent"] for x in rows})


def test_build_chunks_keeps_order_and_places_blocks(spark):
    filler = "plain words of the body come here again. " * 40
    text = f"{filler}\n\nthe numbers are in this table:\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\n\n{filler}"
    rows = chunking.build_chunks(spark.createDataFrame([("s1", text), ("s0", filler), ("s2", None)], "source string, text string")).orderBy("chunk_index").collect()
    assert [x["chunk_index"] for x in rows] == list(range(len(rows))) and [x["source"] for x in rows] == sorted(x["source"] for x in rows)
    at = next(i for i, x in enumerate(rows) if x["kind"] == "table")
    assert "[table: 1]" in rows[at - 1]["page_content"] and rows[at]["marker"] == "[table: 1]"


def test_span_rows_against_plain_code(spark):
    import pyarrow as pa

    r = random.Random(4)
    texts = [None if i % 11 == 5 else [r.choice(["a", "b", "b", "c", word(i), None]) for _ in range(r.randrange(0, 9))] for i in range(90)]
    keys = [(f"s{i % 7}", i // 7) for i in range(90)]
    rows = postings.span_rows(pa.array([{"s": s, "n": n} for s, n in keys], pa.struct({"s": pa.string(), "n": pa.int64()})), pa.array(texts, pa.list_(pa.string())), 5).to_pylist()
    held = {t for x in texts for t in x or [] if t is not None}
    assert len(rows) == len(held)
    for row in rows:
        pairs = sorted((k, x.count(row["term"]), len(x)) for k, x in zip(keys, texts, strict=True) if x and row["term"] in x)
        assert pairs == [((k["s"], k["n"]), tf, dl) for k, tf, dl in zip(row["keys"], row["tfs"], row["dls"], strict=True)]
        best = {(tf, dl) for _, tf, dl in pairs if not any((t > tf and d <= dl) or (t >= tf and d < dl) for _, t, d in pairs)}
        assert {(p["tf"], p["dl"]) for p in row["peaks"]} == best and len(row["peaks"]) == len(best)
        assert row["n"] == len(pairs) and row["tokens"] == sum(p[1] for p in pairs) and row["span"] == 5


@pytest.mark.parametrize("longest", [40, 1 << 21])
def test_postings_are_made_where_texts_are_read(spark, tmp_path, monkeypatch, longest):
    monkeypatch.setattr(postings, "TOKENS", longest)
    monkeypatch.setattr(postings, "SPAN", 50)
    docs = corpus(spark, 300, 6).select(F.struct(F.lit("s").alias("s"), "doc_id").alias("doc_id"), "text")
    sized = docs.select(F.col("doc_id").alias("key"), tokens(F.col("text")).alias("t"))
    made = postings._spans(sized, docs.schema["doc_id"].dataType.simpleString(), 0)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    spans = made.select("span", F.explode(F.arrays_zip("keys", "dls")).alias("x")).distinct().groupBy("span").agg(F.count("*").alias("n"), F.sum("x.dls").alias("t")).collect()
    assert all(x["n"] <= 50 and (x["n"] == 1 or x["t"] <= longest) for x in spans) and (len(spans) > 50) == (longest == 40)
    index = postings.append(spark, str(tmp_path / "i"), docs, "doc_id")
    assert index.manifest["tokens"] == docs.agg(F.sum(F.when(F.col("text").isNotNull(), F.size(tokens(F.col("text")))))).first()[0]
    got = sorted((r["query_id"], r["rank"], tuple(r["doc_id"]), r["score"]) for r in postings.search(index, asked(spark), 4).collect())
    assert got == sorted((r["query_id"], r["rank"], tuple(r["doc_id"]), r["score"]) for r in lexical.bm25_topk(docs, asked(spark), "doc_id", 4).collect())


def test_few_rows_are_sent_to_many_chunks(spark, tmp_path):
    from corpusforge.operators import context

    spark.range(3000).select(F.col("id").alias("chunk_index"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("kind"), F.concat(F.lit("t"), "id", F.sha2(F.col("id").cast("string"), 512)).alias("page_content")).write.parquet(str(tmp_path / "c"))
    chunks = spark.read.parquet(str(tmp_path / "c"))
    chunks.where("chunk_index in (0, 7, 2999)").withColumn("rank", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / "s"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50000")
    try:
        wide = context.neighbours_of(spark.read.parquet(str(tmp_path / "s")), chunks, 1)
        plan = wide._jdf.queryExecution().executedPlan().toString()
        got = {r["chunk_index"]: [int(x[1:-128]) for x in r["page_content"].split("\n")] for r in wide.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert got == {0: [0, 1], 7: [6, 7, 8], 2999: [2998, 2999]}


def test_superseded_texts_are_no_window_over_copies(spark, tmp_path):
    from corpusforge.plans import workload

    rows = [(i, f"s{i % 3}", None if i % 10 == 3 else "same" if i % 2 else f"text {i}") for i in range(200)] + [(0, "s1", "same"), (500, "s1", "text 4")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    chunks = workload.engine_chunks(spark, str(tmp_path))
    assert "Window" not in chunks._jdf.queryExecution().executedPlan().toString()
    first = {}
    for i, _, t in sorted(rows, key=lambda x: x[0]):
        first.setdefault(t, i)
    got = sorted((r["chunk_index"], str(r["page_content"]), r["superseded"], r["version"]) for r in chunks.collect())
    assert got == sorted((i, str(t), i != first[t], "current" if i == first[t] else "v1") for i, _, t in rows)


@pytest.mark.parametrize("repeated", [True, False])
def test_marks_beside_the_texts(spark, tmp_path, repeated):
    """An engine whose marks lie beside its chunks finds what it finds with both in one table; marks move no text."""
    from corpusforge.plans import workload

    rows = [(i, f"s{i % 3}", None if i % 10 == 3 else "same words" if i % 2 else f"text {i} words") for i in range(60)] + [(4 if repeated else 61, "s1", "other words of four"), (500, "s1", "text 4 words")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    chunks, texts, marks = (f(spark, str(tmp_path)) for f in (workload.engine_chunks, workload.engine_texts, workload.engine_marks))
    sorted_rows = lambda df: sorted(map(str, df.collect()))
    assert sorted_rows(marks) == sorted_rows(chunks.select(*marks.columns))
    assert set(texts.columns) | set(marks.columns) == set(chunks.columns)
    asked = spark.createDataFrame([(0, "text 4"), (1, "same words 예전"), (2, "other four"), (3, "zzz")], "query_id long, question string")
    columns = ["query_id", "rank", "chunk_index", "source", "version", "superseded", "kind", "page_content", "md5"]
    for s in (Settings(top_k=40), Settings(top_k=5, version_filter=False), Settings(top_k=3, neighbor_window=1, type_routing=False)):
        whole, beside = Engine(chunks, s, analyse=tokens), Engine(texts, s, analyse=tokens, marks=marks)
        found = [e.search(asked) for e in (whole, beside)]
        assert sorted_rows(found[0].select(*columns)) == sorted_rows(found[1].select(*columns))
        # The rows of a repeated id have one rank, so which of them comes first in a context is open.
        assert repeated or sorted_rows(whole.contexts(asked, found[0])) == sorted_rows(beside.contexts(asked, found[1]))
