"""Every query with SQL gives DuckDB's rows; the others run. Small scale."""

import os

import duckdb
import pandas as pd
import pytest

from corpusforge import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if isinstance(x, float):
            return None if x != x else round(x, 6)
        return None if x is None or x is pd.NaT or x is pd.NA else x.item() if hasattr(x, "item") else x

    df = df[sorted(df.columns)]
    return sorted((tuple(cell(x) for x in row) for row in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, DATA).toPandas()
    if name in plans.SQL:
        want = duck.sql(plans.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)
    else:
        assert len(got) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1


def test_streamed_rollup_equals_the_batch(spark):
    a, b = (normal(plans.QUERIES[n](spark, DATA).toPandas()) for n in ("trace_rollup", "trace_rollup_stream"))
    assert a == b


def test_min_cover_takes_every_anchor_of_each_path(spark, tmp_path):
    items = [(0, "aa"), (1, "bb"), (2, "cc"), (3, "dd"), (4, "ee"), (6, "zz"), (5, "ff"), (7, "gg")]
    docs = [(10, "aa ff"), (11, "cc"), (12, "aa cc"), (13, "bb"), (14, "dd"), (15, "ee"), (16, "ff gg")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["query_id"], r["path_id"]): r["cover"] for r in plans.QUERIES["min_cover"](spark, str(tmp_path)).collect()}
    assert got == {(0, 0): "12", (0, 1): "13,14", (1, 0): None, (1, 1): "16"}


def test_chunk_sizes_against_the_plain_splitter(spark, tmp_path):
    from statistics import median

    from corpusforge.operators.chunking import split_recursive

    passages = {0: "zebra quartz lantern " * 3, 1: "velvet orchid " * 60, 2: "absent words"}
    docs = {10: "plain filler text. " * 40 + passages[0].strip() + ". " + "more filler text. " * 60, 11: passages[1].strip(), 12: "other filler. " * 90}
    spark.createDataFrame([(i, t.strip()) for i, t in passages.items()], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["size"]: r for r in plans.QUERIES["sweep_chunk_size"](spark, str(tmp_path)).collect()}
    for size, overlap in ((400, 50), (800, 100), (1600, 200)):
        pieces = [p for t in docs.values() for p in split_recursive(t, size, overlap)]
        lost = sum(all(t.strip() not in p for p in pieces) for t in passages.values())
        row = got[size]
        assert (row["n"], row["n_chunks"], row["median_chars"], row["lost"]) == (3, len(pieces), median(map(len, pieces)), lost)
        assert row["recall_at_6"] == round((3 - lost) / 3, 6)
    assert got[400]["lost"] > got[1600]["lost"]


def _documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()


def _md5(text):
    import hashlib

    return hashlib.md5(text.encode()).hexdigest()


def test_recursive_queries_against_plain_code(spark):
    """Both forms of the recursive query, positions of all chunks, and parents with children, over all documents."""
    from corpusforge.functions.text import clean_markdown
    from corpusforge.operators.chunking import split_blocks, split_recursive
    from corpusforge.settings import DEFAULTS as S

    run = lambda name, *columns: sorted(tuple(r[c] for c in columns) for r in plans.QUERIES[name](spark, DATA).collect())
    docs = _documents(spark)
    plain = sorted((d["doc_id"], i, len(p), _md5(p)) for d in docs for i, p in enumerate(split_recursive(d["text"], 800, 100)))
    assert run("chunk_recursive", "doc_id", "ord", "size", "md5") == run("chunk_recursive_sql", "doc_id", "ord", "size", "md5") == plain
    assert not any(split_blocks(d["text"], S.table_marker, S.diagram_marker)["blocks"] for d in docs)
    bodies = spark.createDataFrame([(str(d["doc_id"]), split_blocks(d["text"], S.table_marker, S.diagram_marker)["body"]) for d in docs], "source string, text string")
    cleaned = sorted((r["source"], r["t"]) for r in bodies.select("source", clean_markdown(bodies["text"]).alias("t")).collect())
    kept = [(source, i, p) for source, t in cleaned for i, p in enumerate(split_recursive(t, 800, 100)) if len(p) >= S.min_chunk_chars]
    assert run("build_chunks", "chunk_index", "source", "md5") == [(n, source, _md5(p)) for n, (source, _, p) in enumerate(kept)]
    children = [(source, i, j, _md5(c)) for source, i, p in kept for j, c in enumerate(split_recursive(p, S.child_size, S.child_overlap)) if len(c) >= S.min_chunk_chars]
    assert run("parent_child", "source", "parent_ord", "child_ord", "child_md5") == sorted(children)


def test_nfkc_and_semantic_queries_against_plain_code(spark):
    import unicodedata

    from corpusforge.functions.text import sentences
    from corpusforge.operators.chunking import merge_sentences
    from corpusforge.settings import DEFAULTS as S

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert sorted(map(tuple, plans.QUERIES["nfkc"](spark, DATA).collect())) == sorted((d["doc_id"], _md5(unicodedata.normalize("NFKC", d["text"]))) for d in docs.collect())
    cut = docs.select("doc_id", sentences(docs["text"]).alias("s")).collect()
    want = sorted((d["doc_id"], i, _md5(c)) for d in cut for i, c in enumerate(merge_sentences(d["s"], set(range(3, len(d["s"]), 4)), S.semantic_max_chars, S.min_chunk_chars)))
    assert sorted(map(tuple, plans.QUERIES["semantic_chunks"](spark, DATA).collect())) == want


def test_routed_contexts_against_the_engines_parts(spark):
    """ab_route's arms: contexts of each question as cut, widened and ordered by hand for its type."""
    from corpusforge.engine import Engine
    from corpusforge.functions.text import tokens
    from corpusforge.operators import routing
    from corpusforge.plans import workload as w
    from corpusforge.settings import Settings

    chunks, questions, s = w.engine_chunks(spark, DATA).cache(), w.asked(spark, DATA), Settings(generate_top_n=2)
    engine = Engine(chunks, s, analyse=tokens)
    found = engine.search(questions).cache()
    got = {r["query_id"]: r["context"] for r in engine.contexts(questions, found).collect()}
    texts = {r["chunk_index"]: (r["source"], r["page_content"]) for r in chunks.collect()}
    kinds = {r["query_id"]: (r["type"], r["generate_top_n"], r["neighbor_window"]) for r in routing.routed(questions, s).collect()}
    ranked = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        ranked.setdefault(r["query_id"], []).append((r["chunk_index"], r["superseded"], r["version"]))
    for query, (_, n, window) in kinds.items():
        parts = []
        for i, old, version in ranked.get(query, [])[:n]:
            beside = [texts[j][1] for j in range(i - window, i + window + 1) if j in texts and texts[j][0] == texts[i][0]]
            parts.append((f"[archived {version}] " if old else "") + "\n".join(beside))
        assert got[query] == "\n---\n".join(reversed(parts)), query
    assert {k[0] for k in kinds.values()} == {"fact", "aggregation", "enumeration", "comparison"}


@pytest.mark.parametrize("name", ["ab_neighbor_window", "ab_rerank", "ab_hyde"])
def test_arms_rank_once_and_need_no_index(spark, monkeypatch, name):
    """The texts are ranked in one pass for all arms, and what arms find alike is read once."""
    from corpusforge.engine import Engine
    from corpusforge.operators import lexical
    from corpusforge.sources import postings

    calls = []
    counted = lambda owner, f: monkeypatch.setattr(owner, f, lambda *a, _was=getattr(owner, f), **k: calls.append(f) or _was(*a, **k))
    for owner, f in ((lexical, "bm25_topk"), (postings, "append"), (Engine, "search"), (Engine, "whole")):
        if hasattr(owner, f):
            counted(owner, f)
    plans.QUERIES[name](spark, DATA)
    assert calls.count("bm25_topk") == 1 and not {"append", "search"} & set(calls)
    assert calls.count("whole") == (2 if name == "ab_hyde" else 1)


@pytest.mark.parametrize("name", ["ab_rerank", "ab_hyde"])
def test_arms_without_a_window_look_for_no_neighbours(spark, monkeypatch, name):
    from corpusforge.operators import context

    asked = []
    monkeypatch.setattr(context, "neighbours_of", lambda *a, _was=context.neighbours_of: asked.append(a[2]) or _was(*a))
    plans.QUERIES[name](spark, DATA)
    assert asked == []
