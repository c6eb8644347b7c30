"""Order statistics, the cache's write path, state that ends, counts in passing, SQL functions, text vectors."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusforge import sql
from corpusforge.operators import chunking, lexical, quantiles, textvectors
from corpusforge.settings import DEFAULTS
from corpusforge.sources import postings
from corpusforge.streaming import cache, profiles
from tests.test_streaming import stream_of


@pytest.mark.parametrize(("few", "bins"), [(4096, 1024), (3, 4), (1, 2)])
def test_order_statistics(spark, few, bins):
    r = random.Random(few)
    draw = lambda: r.choice((r.random(), r.random() * 1e300, -r.random() * 1e300, 5.0, 5e-324, 0.0, float(r.randrange(4))))
    rows = [(None if r.random() < 0.1 else r.choice("ab"), draw()) for _ in range(400)] + [("one", 7.0), ("nulls", None), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(x["g"], x["rank"]): (x["n"], x["v"]) for x in quantiles.order_statistics(df, "v", ("g",), F.array(F.lit(0), F.floor(F.col("n") / 2), F.col("n") - 1, F.lit(9999)), few, bins).collect()}
    want = {}
    for g in (None, "a", "b", "one"):
        vs = sorted(v for k, v in rows if k == g)
        want |= {(g, i): (len(vs), vs[i]) for i in (0, len(vs) // 2, len(vs) - 1)}
    assert got == want
    whole = sorted(v for _, v in rows if v is not None and not math.isnan(v))
    assert [x["v"] for x in quantiles.order_statistics(df, "v", (), F.array(F.lit(17)), few, bins).collect()] == [whole[17]]


def test_interpolated_quantiles(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 4, 8)] + [("b", 3.0)], "g string, v double")
    assert {x["g"]: x["v"] for x in quantiles.interpolated(df, "v", ("g",), 0.5).collect()} == {"a": 3.0, "b": 3.0}
    assert quantiles.order_statistics(df.where("v > 99"), "v", ("g",), F.array(F.lit(0))).count() == 0


def test_cache_batches_replay_replace_and_expire(spark, tmp_path):
    folder, at = str(tmp_path / "cache"), lambda h: dt.datetime(2024, 1, 1, h)
    entry = lambda *rows: spark.createDataFrame(rows, "cache_key string, payload string, at timestamp")
    cache.write_batch(entry(("k", "old", at(1)), ("x", "1", at(1)), (None, "?", at(1)), ("empty", None, at(2))), 0, folder)
    cache.write_batch(entry(("k", "new", at(5)), ("late", "z", at(0))), 1, folder)
    now = F.lit(dt.datetime(2024, 1, 1, 6))
    seen = lambda keep=None: {r["cache_key"]: r["payload"] for r in cache.current(cache.entries(spark, folder), now, keep).collect()}
    first = seen()
    assert first == {"k": "new", "x": "1", "late": "z"}
    before = cache.entries(spark, folder).count()
    cache.write_batch(entry(("k", "new", at(5)), ("late", "z", at(0))), 1, folder)  # run again after a failure
    assert seen() == first and cache.entries(spark, folder).count() == before
    cache.write_batch(entry(("k", "overtaken", at(4))), 2, folder)
    assert seen() == first and seen(2) == {"k": "new"} and seen(5.5) == {"k": "new", "x": "1"}
    cache.compact(spark, folder, now)
    assert seen() == first and cache.entries(spark, folder).count() == 3
    cache.write_batch(entry(("k", "again", at(5))), 3, folder)
    assert seen()["k"] == "again"


def test_idle_users_leave_the_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", profiles.PROVIDER)
    folder = tmp_path / "in"
    folder.mkdir()
    at = lambda d, h=0: f"2024-01-{d:02d} {h:02d}:00:00"
    batches = [[(1, at(1), 1, "a", 1.0), (2, at(1, 1), 1, "b", 2.0), (3, at(1), 2, "a", 5.0)], [(4, at(1, 3), 1, "a", 4.0), (5, at(1, 4), 1, "a", 8.0)], [(6, at(5), 3, "c", 1.0)], [(7, at(6), 1, "b", 9.0)], [(8, at(9), 4, "a", 1.0)], [(9, at(9, 1), 4, "a", 1.0)]]
    try:
        query = profiles.profiles(stream_of(spark, folder, batches)).writeStream.outputMode("append").format("memory").queryName("idle_users").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r["user_id"], r["n"], r["total"], r["kinds"], r["last_values"]) for r in spark.table("idle_users").collect())
    assert got == [(1, 1, 9.0, "b:1", "9"), (1, 4, 15.0, "a:3,b:1", "2,4,8"), (2, 1, 5.0, "a:1", "5"), (3, 1, 1.0, "c:1", "1")]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) > held[-1] > 0


def test_counts_in_passing(spark):
    texts = [("s0", "x"), ("s1", None), ("s2", "long enough to be a chunk of its own, surely so"), ("s3", "tiny\n\n" + "words " * 400)]
    report = chunking.Report()
    chunks = chunking.placed_chunks(spark.createDataFrame(texts, "source string, text string"), report=report)
    pieces = [p for _, t in texts for p in chunking.split_recursive(t, DEFAULTS.chunk_size, DEFAULTS.chunk_overlap)]
    short = sum(len(p) < DEFAULTS.min_chunk_chars for p in pieces)
    assert report.counts() == {"documents": 4, "empty": 2, "pieces": len(pieces), "dropped": short} and short > 0
    assert sorted(r["source"] for r in report.empty_sources().collect()) == ["s0", "s1"] and chunks.count() == len(pieces) - short


def test_table_functions_give_what_the_data_frames_give(spark):
    sql.register(spark)
    texts = ["# A\n\n" + "words of a text. " * 90, "", None, "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.createOrReplaceTempView("texts_of_test")
    got = spark.sql("SELECT d.doc_id, c.ord, c.page_content FROM texts_of_test d, LATERAL recursive_chunks(d.text, 300, 40) c").collect()
    want = df.select("doc_id", F.posexplode(chunking.recursive_chunks(F.col("text"), 300, 40))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 4
    blocks = spark.sql("SELECT d.doc_id, b.kind, b.marker FROM texts_of_test d, LATERAL whole_blocks(d.text) b").collect()
    assert [tuple(b) for b in blocks] == [(3, "table", "[table: 1]")]


def test_search_from_sql(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red green", "green blue blue", "blue", "red red sky", "sky over sea", "sea of green"])], "doc_id long, text string")
    index = postings.append(spark, str(tmp_path / "i"), docs, "doc_id")
    sql.register_index(spark, index, "colours")
    asked = spark.createDataFrame([(0, "blue green"), (1, "sky red")], "query_id long, question string")
    lexical.query_terms(asked).createOrReplaceTempView("asked_terms")
    got = sorted(map(tuple, spark.sql(sql.search_statement(index, "asked_terms", 3, "colours")).collect()))
    want = sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.bm25_topk(docs, asked, "doc_id", 3).collect())
    assert got == want and len(got) == 5


def test_text_vectors(spark):
    docs = spark.createDataFrame([(0, "a b c"), (1, "a b c"), (2, "x y z"), (3, None), (4, "")], "id long, text string")
    got = {r["id"]: r["embedding"] for r in textvectors.text_vectors(docs, "id", "text").collect()}
    assert got[0] == got[1] != got[2] and set(got) == {0, 1, 2} and len(got[0]) == textvectors.DIMENSIONS
    assert all(v in (-3.0, -1.0, 1.0, 3.0) for v in got[0])
    rare = textvectors.text_vectors(docs, "id", "text", lexical.doc_freq(docs).where("term <> 'c'"), 5)
    assert all(abs(v) < 3 for v in {r["id"]: r["embedding"] for r in rare.collect()}[0])


def test_bm25_hands_on_the_best_of_each_task_alone(spark):
    rows = [(i // 3, i % 3, " ".join(["the", f"w{i % 7}", f"w{i % 5}", "the" if i % 2 else "a"])) for i in range(300)] + [(200, 0, None), (201, 0, "")]
    docs = spark.createDataFrame(rows, "a long, b int, text string").select(F.struct("a", "b").alias("key"), "text").repartition(3)
    asked = spark.createDataFrame([(1, "the w1 w1"), (2, "w3 w4 a"), (3, "nothing"), (4, "")], "query_id long, question string")
    got = lexical.bm25_topk(docs, asked, "key", 5)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row for each pair of a chunk and a question
    want = lexical.bm25_topk(docs, asked, "key", 5, inline=0)
    listed = lambda df: sorted((r["query_id"], r["rank"], tuple(r["key"]), r["score"]) for r in df.collect())
    assert listed(got) == listed(want) and len(listed(got)) == 10
    assert lexical.bm25_topk(docs.limit(0), asked, "key", 5).count() == 0


@pytest.mark.parametrize(("most", "back"), [(1 << 20, 1 << 20), (5, 1 << 20), (40, 3), (7, 20)])
def test_bm25_reads_each_text_once(spark, monkeypatch, most, back):
    from pyspark.sql import types as T

    monkeypatch.setattr(lexical, "TOKENS", most)
    monkeypatch.setattr(lexical, "HELD", back)
    rows = [(i // 3, i % 3, " ".join(["the", f"w{i % 7}", f"w{i % 5}", f"rare{i}", "the" if i % 2 else "a"])) for i in range(120)] + [(200, 0, None), (201, 0, "")]
    docs = spark.createDataFrame(rows, "a long, b int, text string").select(F.struct("a", "b").alias("key"), "text").repartition(3).localCheckpoint()
    asked = spark.createDataFrame([(1, "the w1 w1"), (2, "w3 w4 a rare7"), (3, "nothing"), (4, "")], "query_id long, question string").localCheckpoint()
    read = spark.sparkContext.accumulator(0)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def words(texts: pd.Series) -> pd.Series:
        read.add(int(texts.fillna("").str.contains("rare[0-9]+ ").sum()))
        return texts.map(lambda t: None if t is None else [w if w != "a" else None for w in t.split()])

    listed = lambda df: sorted((r["query_id"], r["rank"], tuple(r["key"]), r["score"]) for r in df.collect())
    got = listed(lexical.bm25_topk(docs, asked, "key", 5, analyse=words))
    assert read.value == 120
    assert got == listed(lexical.bm25_topk(docs, asked, "key", 5, analyse=words, inline=0)) and len(got) == 10


def test_profiles_call_the_state_once_a_batch():
    """Each call goes from Python to the JVM and back: stretches that end within a batch need none."""
    import pandas as pd

    calls = []

    class Value:
        held = None
        exists = lambda self: calls.append("exists") or self.held is not None
        get = lambda self: calls.append("get") or self.held

        def update(self, row):
            calls.append("update")
            self.held = row

    class Handle:
        getValueState = lambda self, *_: Value()  # noqa: E731, N815
        registerTimer = deleteTimer = lambda self, at: calls.append("timer")  # noqa: E731, N815

    p = profiles.Profile(24 * 3_600_000_000)
    p.init(Handle())
    days = [1, 1, 4, 8, 12, 16, 20]
    batch = lambda n: pd.DataFrame({"ts": pd.to_datetime([f"2024-{n:02d}-{d:02d}" for d in days]), "event_id": range(7), "event_type": ["a"] * 7, "value": [1.0] * 6 + [None]})
    first = pd.concat(list(p.handleInputRows((5,), iter([batch(1)]), None)))
    assert first["n"].tolist() == [2, 1, 1, 1, 1] and first["total"].tolist() == [2, 1, 1, 1, 1]
    second = pd.concat(list(p.handleInputRows((5,), iter([batch(2)]), None)))
    assert second["n"].tolist() == [1, 2, 1, 1, 1, 1] and second["total"].tolist()[0] == 0 and len(calls) <= 8


def test_text_vectors_are_summed_where_texts_are_read(spark, monkeypatch):
    """Rare and common terms, long texts, null and empty ones, against plain code; without frequencies nothing is shuffled."""
    import hashlib
    import math
    import random

    from corpusforge.operators import lexical, textvectors

    r = random.Random(8)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)]
    texts = [None, ""] + [" ".join(r.choices(vocabulary, [1 / (i + 1) for i in range(150)], k=k)) for k in (1, 5, 700, *[r.randrange(60) for _ in range(60)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    monkeypatch.setattr(textvectors, "HELD", 10)
    terms = {i: {w: t.split().count(w) for w in t.split()} for i, t in enumerate(texts) if t}
    df = {w: sum(w in x for x in terms.values()) for w in vocabulary}
    sign = lambda w, j: 1 if int(hashlib.md5(w.encode()).hexdigest()[:12], 16) >> j & 1 else -1
    plain = textvectors.text_vectors(docs, "id", "text")
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
    for got, weight in ((plain, lambda w: 1.0), (textvectors.text_vectors(docs, "id", "text", lexical.doc_freq(docs), len(texts)), lambda w: math.log1p(len(texts) / df[w]))):
        vectors = {x["id"]: x["embedding"] for x in got.collect()}
        assert set(vectors) == {i for i, x in terms.items() if x}
        for i, v in vectors.items():
            want = [sum((1 + math.log(n)) * weight(w) * sign(w, j) for w, n in terms[i].items()) for j in range(textvectors.DIMENSIONS)]
            assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(v, want, strict=True))


def test_nearest_sends_the_best_alone(spark):
    """Ties, zero, null, short and non-finite vectors: the rows that all pairs give, and no pair of a usual vector is a row."""
    import random

    from pyspark.sql import functions as F

    from corpusforge.operators import vectors
    from corpusforge.operators.lexical import top_k

    r = random.Random(9)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5]) for _ in range(3)], i % 2) for i in range(150)]
    rows += [(200, None, 0), (201, [1.0, None, 0.0], 1), (202, [1.0], 0), (203, [float("nan"), 1.0, 0.0], 1), (204, [float("inf"), 1.0, 0.0], 1), (205, [0.0, 0.0, 0.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    asked = spark.createDataFrame([(1, [1.0, 0.5, 0.0]), (2, [0.0, 0.0, 0.0]), (3, [-1.0, -1.0, 0.25])], "query_id long, query_vector array<double>")
    for metric in ("cosine", "l2"):
        order = F.col("score").desc() if metric == "cosine" else F.col("score")
        want = top_k(vectors.scored_pairs(table, asked, metric), 7, order, F.col("vec_id"))
        got = vectors.nearest(table, asked, 7, metric)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    mixed = asked.unionByName(spark.createDataFrame([(4, [1.0]), (5, None)], asked.schema))
    assert vectors.nearest(table, mixed, 3).count() == 15
