"""Queries on tokens, lexical and vector retrieval, fusion and context."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context, fusion, lexical, textvectors, vectors
from ..sources import postings as postings_store
from ..sources.shared import fresh, written
from . import workload as w
from .workload import WORDS, query, table

DOCS = "documents"


@query("tokenize", f"SELECT doc_id, len(regexp_extract_all(lower(text), {WORDS}))::INTEGER AS n_tokens, md5(array_to_string(regexp_extract_all(lower(text), {WORDS}), ' ')) AS tokens_md5 FROM documents")
def tokenize(spark, sf_dir):
    words = table(spark, sf_dir, DOCS).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return words.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


@query("postings", "SELECT doc_id, term, tf FROM {post}")
def postings(spark, sf_dir):
    return lexical.postings(table(spark, sf_dir, DOCS), "doc_id")


@query("doc_freq", "SELECT term, count(*) AS df FROM {post} GROUP BY term")
def doc_freq(spark, sf_dir):
    return lexical.doc_freq(table(spark, sf_dir, DOCS))


@query("term_stats", "SELECT term, df, round(idf, 6) AS idf FROM {stat}")
def term_stats(spark, sf_dir):
    return lexical.term_stats(table(spark, sf_dir, DOCS)).withColumn("idf", F.round("idf", 6))


@query("bm25_topk", "SELECT query_id, rank, doc_id, score FROM {bm} WHERE rank <= 6")
def bm25_topk(spark, sf_dir):
    return w.best(spark, sf_dir, 6).select("query_id", "rank", "doc_id", "score")


@query("bm25_topk_short", "SELECT query_id, rank, doc_id, score FROM {bmh} WHERE rank <= 6")
def bm25_topk_short(spark, sf_dir):
    return w.best(spark, sf_dir, 6, 5, 3).select("query_id", "rank", "doc_id", "score")


@query("bm25_stored", "SELECT query_id, rank, doc_id, score FROM {bm} WHERE rank <= 6")
def bm25_stored(spark, sf_dir):
    """The same from a stored index: half of the languages built first, the others appended; questions read postings only."""
    docs, folder = table(spark, sf_dir, DOCS), fresh(spark, "index")
    early = F.coalesce(F.col("lang").isin("en", "fr"), F.lit(False))
    postings_store.append(spark, folder, docs.where(early), "doc_id")
    index = postings_store.append(spark, folder, docs.where(~early), "doc_id")
    return postings_store.search(index, w.questions(spark, sf_dir), 6).select("query_id", "rank", "doc_id", "score")


@query(
    "expansion_terms",
    f"""SELECT query_id, CASE WHEN len(n) > 0 THEN array_to_string(n, ' ') END AS terms FROM (SELECT item_id AS query_id, list_filter(list_distinct_ordered, lambda t: regexp_full_match(t, '[a-z0-9]+') AND NOT list_contains(qt, t)) AS n
    FROM (SELECT item_id, list_transform(list_filter(list_zip(a, range(1, len(a) + 1)), lambda p: list_position(a, p[1]) = p[2]), lambda p: p[1]) AS list_distinct_ordered, a[1:12] AS qt FROM (SELECT item_id, regexp_extract_all(lower(text), {WORDS}) AS a FROM benchmark)))""",
)
def expansion_terms(spark, sf_dir):
    asked = F.array_join(F.slice(T.tokens(F.col("text")), 1, 12), " ")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.expansion_terms(asked, F.col("text")).alias("terms"))


FUSED = "SELECT query_id, rank, key, first_list, first_rank, score FROM (SELECT query_id, key, round(sum({w} / ({k} + rank)), 9) AS score, min(list_id * 1000 + rank) // 1000 AS first_list, min(list_id * 1000 + rank) % 1000 AS first_rank, row_number() OVER (PARTITION BY query_id ORDER BY round(sum({w} / ({k} + rank)), 9) DESC, min(list_id * 1000 + rank))::INTEGER AS rank FROM {{lists}} GROUP BY query_id, key) WHERE rank <= 6"


@query("rrf_fusion", FUSED.format(w="1.0::DOUBLE", k="60.0::DOUBLE"))
def rrf_fusion(spark, sf_dir):
    return fusion.fuse(w.ranked_lists(spark, sf_dir), 6, 60)


@query("hyde_fused", FUSED.format(w="(CASE WHEN list_id = 1 THEN 0.5 ELSE 1.0 END)::DOUBLE", k="60.0::DOUBLE"))
def hyde_fused(spark, sf_dir):
    """The expansion's list joins the fusion, here at half weight."""
    return fusion.fuse(w.ranked_lists(spark, sf_dir).withColumn("weight", F.when(F.col("list_id") == 1, 0.5).otherwise(1.0)), 6, 60)


@query(
    "sweep_rrf_k",
    "SELECT rrf_k, query_id, rank, key FROM (SELECT rrf_k, query_id, key, row_number() OVER (PARTITION BY query_id, rrf_k ORDER BY round(sum(1.0::DOUBLE / (rrf_k::DOUBLE + rank)), 9) DESC, min(list_id * 1000 + rank))::INTEGER AS rank FROM {lists}, (SELECT unnest([1, 5, 10, 20, 40, 60, 100, 200])::INTEGER AS rrf_k) GROUP BY rrf_k, query_id, key) WHERE rank <= 6",
)
def sweep_rrf_k(spark, sf_dir):
    return fusion.sweep_constant(w.ranked_lists(spark, sf_dir), 6).select("rrf_k", "query_id", "rank", "key")


@query("version_filter", "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS rank, doc_id, score FROM {bm} JOIN {ver} USING (doc_id) WHERE NOT superseded QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 6")
def version_filter(spark, sf_dir):
    old = w.versions(spark, sf_dir).select("doc_id", "superseded")
    return fusion.version_filtered(w.best(spark, sf_dir, 12).join(old, "doc_id"), w.questions(spark, sf_dir), 6).select("query_id", "rank", "doc_id", "score")


HISTORY_SQL = T.HISTORY
@query("history_intent", f"SELECT query_id, regexp_matches(question, '{HISTORY_SQL}') AS history FROM {{qa}}")
def history_intent(spark, sf_dir):
    return w.asked(spark, sf_dir).select("query_id", T.wants_history(F.col("question")).alias("history"))


@query("rerank_permutation", "SELECT query_id, CASE WHEN n > 1 AND query_id % 3 <> 0 THEN n - rank + 1 ELSE rank END::INTEGER AS rank, doc_id FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM {bm} WHERE rank <= 6)")
def rerank_permutation(spark, sf_dir):
    """Every third query's permutation is invalid and leaves its list as it was."""
    ranked = w.best(spark, sf_dir, 6)
    sizes = ranked.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    given = F.when(F.col("query_id") % 3 == 0, F.array(F.lit(0), F.lit(0))).otherwise(F.reverse(F.sequence(F.lit(0), F.col("n") - 1)))
    return fusion.permuted(ranked, sizes.select("query_id", given.alias("permutation"))).select("query_id", F.col("new_rank").alias("rank"), "doc_id")


@query("cosine_topk", "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM {pair} QUALIFY rank <= 6")
def cosine_topk(spark, sf_dir):
    return vectors.nearest(table(spark, sf_dir, "embeddings"), w.vector_queries(spark, sf_dir), 6).select("query_id", "rank", "vec_id", "score")


@query(
    "l2_topk",
    "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM (SELECT query_id, vec_id, round(list_distance(qv::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM {vq}, embeddings) QUALIFY rank <= 6",
)
def l2_topk(spark, sf_dir):
    return vectors.nearest(table(spark, sf_dir, "embeddings"), w.vector_queries(spark, sf_dir), 6, "l2").select("query_id", "rank", "vec_id", "score")


@query("filtered_topk", "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM {pair} WHERE label = 3 QUALIFY rank <= 6")
def filtered_topk(spark, sf_dir):
    return vectors.nearest(table(spark, sf_dir, "embeddings"), w.vector_queries(spark, sf_dir), 6, prefilter=F.col("label") == 3).select("query_id", "rank", "vec_id", "score")


@query(
    "postfilter_topk",
    "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY r)::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM {pair}) WHERE r <= 60 AND label = 3 QUALIFY rank <= 6",
)
def postfilter_topk(spark, sf_dir):
    return vectors.nearest_postfiltered(table(spark, sf_dir, "embeddings"), w.vector_queries(spark, sf_dir), 6, F.col("label") == 3).select("query_id", "rank", "vec_id", "score")


@query("store_parity", "SELECT query_id, rank, vec_id AS a_key, vec_id AS b_key FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM {pair}) WHERE false")
def store_parity(spark, sf_dir):
    """Unit vectors: cosine and distance must agree, so nothing is returned."""
    v, q = table(spark, sf_dir, "embeddings"), w.vector_queries(spark, sf_dir)
    return vectors.parity(vectors.nearest(v, q, 6), vectors.nearest(v, q, 6, "l2"), "vec_id")


@query(
    "overfetch_study",
    "SELECT query_id, factor, least(coalesce(n, 0), 6)::BIGINT AS filled FROM (SELECT query_id, factor FROM {vq}, (SELECT unnest([1, 2, 5, 10])::INTEGER AS factor)) LEFT JOIN (SELECT query_id, f.factor, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM {pair}), (SELECT unnest([1, 2, 5, 10])::INTEGER AS factor) f WHERE r <= f.factor * 6 AND label = 3 GROUP BY ALL) USING (query_id, factor)",
)
def overfetch_study(spark, sf_dir):
    return vectors.over_fetch_study(table(spark, sf_dir, "embeddings"), w.vector_queries(spark, sf_dir), 6, F.col("label") == 3)


@query("context_topn", "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS rank, chunk_index FROM {sel} WHERE kind IS NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5")
def context_topn(spark, sf_dir):
    rows = w.selected(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "table", "diagram"))
    return context.cut(rows, 5, True).select("query_id", "rank", "chunk_index")


@query(
    "neighbor_expand",
    "SELECT s.query_id, s.rank, s.chunk_index, CASE WHEN s.kind IS NOT NULL THEN s.page_content ELSE (SELECT string_agg(n.page_content, chr(10) ORDER BY n.chunk_index) FROM {ch} n WHERE n.source = s.source AND n.kind IS NULL AND n.chunk_index BETWEEN s.chunk_index - 1 AND s.chunk_index + 1) END AS page_content FROM {sel} s WHERE s.rank <= 3",
)
def neighbor_expand(spark, sf_dir):
    rows = w.selected(spark, sf_dir).where("rank <= 3").select("query_id", "rank", "chunk_index", "source", "kind", "page_content")
    return context.neighbours_of(rows, w.chunks(spark, sf_dir), 1).select("query_id", "rank", "chunk_index", "page_content")


@query(
    "neighbor_expand_window",
    "SELECT c.chunk_index, (SELECT string_agg(n.page_content, chr(10) ORDER BY n.chunk_index) FROM {ch} n WHERE n.source = c.source AND n.kind IS NULL AND n.chunk_index BETWEEN c.chunk_index - 1 AND c.chunk_index + 1) AS page_content FROM {ch} c WHERE kind IS NULL",
)
def neighbor_expand_window(spark, sf_dir):
    return context.widened(w.chunks(spark, sf_dir), 1).select("chunk_index", "page_content")


@query(
    "context_order",
    "SELECT query_id, array_to_string(list_reverse(i), ',') AS reversed, array_to_string(CASE WHEN len(i) >= 3 THEN list_concat(i[1:1], list_reverse(i[2:]), i[1:1]) ELSE list_reverse(i) END, ',') AS sandwich FROM (SELECT query_id, list(chunk_index::VARCHAR ORDER BY rank) AS i FROM {sel} WHERE rank <= 5 GROUP BY query_id)",
)
def context_order(spark, sf_dir):
    lists = w.selected(spark, sf_dir).where("rank <= 5").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("chunk_index").cast("string").alias("c")))).alias("i"))
    return lists.select("query_id", *[F.array_join(context.ordered(F.col("i.c"), o), ",").alias(o) for o in ("reversed", "sandwich")])


CONTEXT = "SELECT query_id, string_agg(CASE WHEN query_id % 2 = 0 THEN '[archived v1] ' || page_content ELSE page_content END, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM {sel} WHERE rank <= 5 GROUP BY query_id"


@query("context_text", CONTEXT)
def context_text(spark, sf_dir):
    rows = w.selected(spark, sf_dir).where("rank <= 5").withColumns({"superseded": F.col("query_id") % 2 == 0, "version": F.lit("v1")})
    return context.context_text(rows).select("query_id", "context")


@query("context_sources", "SELECT query_id, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM {bm} JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id")
def context_sources(spark, sf_dir):
    docs = table(spark, sf_dir, DOCS).select("doc_id", "source", F.lit(False).alias("superseded"), F.lit("current").alias("version"), F.lit("").alias("page_content"))
    return context.context_text(w.best(spark, sf_dir, 5).join(docs, "doc_id")).select("query_id", F.array_join("sources", ",").alias("sources"))


@query(
    "parent_expand",
    "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first_rank)::INTEGER AS rank, parent_id, first_rank FROM (SELECT query_id, source AS parent_id, min(rank) AS first_rank FROM {bm} JOIN documents USING (doc_id) WHERE source <> 'src3' GROUP BY ALL)",
)
def parent_expand(spark, sf_dir):
    """Sources are parents of their documents; one is unknown."""
    docs = table(spark, sf_dir, DOCS).select("doc_id", F.col("source").alias("parent_id"))
    parents = docs.select("parent_id").distinct().where("parent_id <> 'src3'")
    return context.parents_of(w.best(spark, sf_dir, 12).join(docs, "doc_id"), parents).select("query_id", "rank", "parent_id", "first_rank")


@query("sweep_top_k", "SELECT top_k, round(avg(CASE WHEN g <= top_k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM (SELECT item_id AS query_id FROM benchmark) LEFT JOIN (SELECT query_id, min(rank) AS g FROM {bm} SEMI JOIN {gold} USING (query_id, doc_id) GROUP BY query_id) USING (query_id), (SELECT unnest([1, 2, 3, 6, 10, 12])::INTEGER AS top_k) GROUP BY top_k")
def sweep_top_k(spark, sf_dir):
    from ..operators import metrics

    ranks = metrics.gold_rank(w.questions(spark, sf_dir), w.best(spark, sf_dir, 12), w.gold(spark, sf_dir), "doc_id")
    asked_k = spark.createDataFrame([(k,) for k in (1, 2, 3, 6, 10, 12)], "top_k int")
    return ranks.crossJoin(F.broadcast(asked_k)).groupBy("top_k").agg(F.round(F.avg(F.when(F.col("gold_rank") <= F.col("top_k"), 1.0).otherwise(0.0)), 6).alias("recall"))


@query("retriever_ranks", "SELECT query_id, max(CASE WHEN l = 0 THEN g END) AS long_rank, max(CASE WHEN l = 1 THEN g END) AS short_rank FROM (SELECT 0 AS l, query_id, min(rank) AS g FROM {bm} SEMI JOIN {gold} USING (query_id, doc_id) GROUP BY query_id UNION ALL SELECT 1, query_id, min(rank) FROM {bmh} SEMI JOIN {gold} USING (query_id, doc_id) GROUP BY query_id) GROUP BY query_id")
def retriever_ranks(spark, sf_dir):
    gold = w.gold(spark, sf_dir)
    both = [r.join(gold, ["query_id", "doc_id"], "left_semi").select("query_id", "rank", F.lit(n).alias("list")) for r, n in ((w.best(spark, sf_dir, 12), "long_rank"), (w.best(spark, sf_dir, 12, 5, 3), "short_rank"))]
    return both[0].unionByName(both[1]).groupBy("query_id").pivot("list", ["long_rank", "short_rank"]).agg(F.min("rank"))


@query("retriever_diff", "SELECT 'long' AS only_in, query_id, doc_id FROM (SELECT query_id, doc_id FROM {bm} WHERE rank <= 6 EXCEPT SELECT query_id, doc_id FROM {bmh} WHERE rank <= 6) UNION ALL SELECT 'short', query_id, doc_id FROM (SELECT query_id, doc_id FROM bmh WHERE rank <= 6 EXCEPT SELECT query_id, doc_id FROM bm WHERE rank <= 6)")
def retriever_diff(spark, sf_dir):
    a, b = (w.best(spark, sf_dir, 6, *x).select("query_id", "doc_id") for x in ((1, 12), (5, 3)))
    mark = lambda df, name: df.select(F.lit(name).alias("only_in"), "query_id", "doc_id")
    return mark(a.subtract(b), "long").unionByName(mark(b.subtract(a), "short"))


SENTENCES_SQL = "list_filter(list_transform(string_split_regex(regexp_replace(context, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n{2,}'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


@query(
    "answer_contexts",
    f"""WITH c AS (SELECT query_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY rank DESC) AS context, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM {{eng}} WHERE rank <= 5 GROUP BY query_id)
    SELECT item_id AS query_id, md5(coalesce(context, '')) AS context_md5, coalesce(sources, '') AS sources, {SENTENCES_SQL}[1] AS answer FROM benchmark LEFT JOIN c ON item_id = query_id""",
)
def answer_contexts(spark, sf_dir):
    """The engine end to end from a stored index: BM25, version filter, fusion, routing, neighbours, context and a stand-in answer."""
    from ..engine import Engine
    from ..functions.udfs import nfkc_tokens

    rows = written(w.engine_chunks(spark, sf_dir), "chunks")
    index = postings_store.append(spark, fresh(spark, "index"), rows, "chunk_index", "page_content", nfkc_tokens)
    return Engine(rows, index=index).ask(w.questions(spark, sf_dir)).select("query_id", F.md5(F.col("context").cast("binary")).alias("context_md5"), F.array_join("sources", ",").alias("sources"), "answer")


#: Two spaces of the same texts: terms weighted by rarity, and terms alike. Signs of a term: the first 12 digits of its md5.
VECTOR_SQL = "(SELECT {id}, [" + ", ".join(f"sum(CASE WHEN (s >> {j}) & 1 = 1 THEN w ELSE -w END)" for j in range(textvectors.DIMENSIONS)) + "] AS v FROM (SELECT {id}, ('0x' || substr(md5(term), 1, 12))::BIGINT AS s, (1 + ln(tf)) * {weight} AS w FROM {rows}) GROUP BY {id})"
RARE_SQL = "ln(1 + n / df::DOUBLE)"
QUESTION_TERMS = f"(SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest(regexp_extract_all(lower(question), {WORDS})) AS term FROM {{q}}) GROUP BY ALL)"


def _space_sql(name, weight, more):
    docs, asked_ = (VECTOR_SQL.format(id=i, weight=weight, rows=f"{r}{more}") for i, r in (("doc_id", "{post}"), ("query_id", QUESTION_TERMS)))
    score = "round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6)"
    return f"(SELECT '{name}' AS space, query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, doc_id) AS rank FROM {asked_} a, {docs} b QUALIFY rank <= 6)"


@query(
    "embedding_comparison",
    f"""WITH r AS (SELECT * FROM {_space_sql("rarity", RARE_SQL, " JOIN {df} USING (term) CROSS JOIN {size}")} UNION ALL SELECT * FROM {_space_sql("plain", "1", "")}),
    g AS (SELECT space, query_id, min(rank) AS gold_rank FROM r SEMI JOIN {{gold}} USING (query_id, doc_id) GROUP BY ALL)
    SELECT space, count(*) AS n, {", ".join(f"round(avg(CASE WHEN gold_rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_at_{k}" for k in (1, 3, 6))}, round(avg(coalesce(1.0 / gold_rank, 0.0)), 6) AS mrr
    FROM (SELECT item_id AS query_id, unnest(['rarity', 'plain']) AS space FROM benchmark) LEFT JOIN g USING (space, query_id) GROUP BY space""",
)
def embedding_comparison(spark, sf_dir):
    """Recall and MRR of two vector spaces on the same texts and questions; vectors are stored, then searched."""
    from ..operators import metrics

    docs, asked_, gold = table(spark, sf_dir, DOCS), w.questions(spark, sf_dir), written(w.gold(spark, sf_dir), "gold")
    n, frequencies = docs.count(), written(lexical.doc_freq(docs), "frequencies")
    out = None
    for space, more in (("rarity", {"frequencies": frequencies, "n": n}), ("plain", {})):
        stored = written(textvectors.text_vectors(docs, "doc_id", "text", **more).withColumnRenamed("doc_id", "vec_id"), space)
        questions = textvectors.text_vectors(asked_, "query_id", "question", **more).withColumnRenamed("embedding", "query_vector")
        ranked = vectors.nearest(stored, questions, 6).withColumnRenamed("vec_id", "doc_id")
        rows = metrics.gold_rank(asked_, ranked, gold, "doc_id").withColumn("space", F.lit(space))
        out = rows if out is None else out.unionByName(rows)
    return metrics.recall_mrr(out, by=("space",))
