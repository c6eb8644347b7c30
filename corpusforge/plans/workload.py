"""Stand-ins: the engine's abstractions on the driver's tables, as DataFrames and as the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import chunking, lexical, metrics
from ..sources.shared import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its DuckDB text (CTEs named in CTES may be used as {name})."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_ctes(sql)
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Questions that no document of the corpus is about.
OUT_OF_SCOPE = ("what is the weather tomorrow", "recommend a restaurant nearby", "how do I renew a passport", "who won the match last night")
#: Endings that ask for history, a comparison, a count, a list, or none of these.
ASKED = ["예전 버전에서는 어땠나요", "v2 에서는 무엇이 달랐나요", "2023년 기준 매출은", "지금 버전은 무엇인가요", "A와 B 중 더 큰 것은", "논문은 몇 편인가요", "제품들을 모두 나열해 주세요", "기준 세 가지는 무엇인가요", "주소는 어디인가요", "개정 전 규정은", ""]
WORDS = r"'\p{L}+|\p{N}+'"
#: name: (CTE text, CTEs that it needs)
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "q": (f"q AS (SELECT item_id AS query_id, array_to_string(regexp_extract_all(lower(text), {WORDS})[1:12], ' ') AS question FROM benchmark)", ()),
    "qh": (f"qh AS (SELECT item_id AS query_id, array_to_string(regexp_extract_all(lower(text), {WORDS})[5:7], ' ') AS question FROM benchmark)", ()),
    "qa": (f"qa AS (SELECT item_id AS query_id, array_to_string(regexp_extract_all(lower(text), {WORDS})[1:12], ' ') || ' ' || [{', '.join(repr(q) for q in ASKED)}][item_id % {len(ASKED)} + 1] AS question FROM benchmark)", ()),
    "qo": ("qo AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{q}')" for i, q in enumerate(OUT_OF_SCOPE)) + ") t(query_id, question))", ()),
    "tok": (f"tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {WORDS})) AS term FROM documents)", ()),
    "post": ("post AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)", ("tok",)),
    "df": ("df AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY term)", ("post",)),
    "size": ("size AS MATERIALIZED (SELECT count(*) AS n FROM documents)", ()),
    "raw": ("raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df CROSS JOIN size)", ("df", "size")),
    "mean": ("mean AS MATERIALIZED (SELECT avg(raw) AS mean FROM raw)", ("raw",)),
    "stat": ("stat AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw CROSS JOIN mean)", ("raw", "mean")),
    "len": (f"len AS (SELECT doc_id, len(regexp_extract_all(lower(text), {WORDS})) AS dl FROM documents)", ()),
    "part": ("part AS (SELECT post.doc_id, post.term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM len))) AS part FROM post JOIN stat USING (term) JOIN len USING (doc_id))", ("post", "stat", "len")),
    **{f"bm{x}": (f"bm{x}0 AS (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM (SELECT query_id, unnest(regexp_extract_all(lower(question), {WORDS})) AS term FROM q{x}) JOIN part USING (term) GROUP BY ALL HAVING round(sum(part), 6) > 0), bm{x} AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM bm{x}0 QUALIFY rank <= 12)", (f"q{x}", "part")) for x in ("", "h", "o", "a")},
    "gold": ("gold AS (SELECT item_id AS query_id, doc_id FROM benchmark, documents WHERE contains(documents.text, benchmark.text))", ()),
    "lists": ("lists AS (SELECT query_id, 0 AS list_id, rank, md5(text) AS key FROM bm JOIN documents USING (doc_id) WHERE rank <= 6 UNION ALL SELECT query_id, 1, rank, md5(text) FROM bmh JOIN documents USING (doc_id) WHERE rank <= 6)", ("bm", "bmh")),
    "ver": ("ver AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 AS superseded FROM documents)", ()),
    "eng": ("eng AS (SELECT query_id, doc_id, source, text, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS rank FROM bm JOIN ver USING (doc_id) WHERE NOT superseded QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 6)", ("bm", "ver")),
    "ch": ("ch AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS chunk_index, conv_id AS source, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS doc_index, count(*) OVER (PARTITION BY conv_id) AS doc_total, CASE WHEN role = 'system' THEN 'table' END AS kind, text AS page_content FROM conversations)", ()),
    "sel": ("sel AS (SELECT source AS query_id, (row_number() OVER (PARTITION BY source ORDER BY length(page_content) DESC, chunk_index))::INTEGER AS rank, * FROM ch)", ("ch",)),
    "vq": ("vq AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label))", ()),
    "pair": ("pair AS (SELECT query_id, vec_id, label, round(list_dot_product(qv::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(qv::DOUBLE[], qv::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS score FROM vq, embeddings)", ("vq",)),
    "edge": (
        "edge AS (SELECT 'order ' || o_orderkey AS src, 'customer ' || o_custkey AS dst, 'placed_by' AS relation, o_orderkey AS chunk_index FROM orders UNION ALL SELECT 'customer ' || c_custkey, lower(n_name), 'located_in', c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT lower(n_name), lower(r_name), 'part_of', n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'supplier ' || s_suppkey, lower(n_name), 'located_in', s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)",
        (),
    ),
    "node": ("node AS (SELECT DISTINCT src AS name FROM edge UNION SELECT dst FROM edge)", ("edge",)),
    "kq": ("kq AS (SELECT n_nationkey::BIGINT AS query_id, 'which customers are located in ' || lower(n_name) || ' of ' || lower(r_name) AS question FROM nation JOIN region ON n_regionkey = r_regionkey)", ()),
    "kov": (f"kov AS (SELECT query_id, name, count(*) / n AS ratio FROM (SELECT name, len(list_distinct(regexp_extract_all(lower(name), {WORDS}))) AS n, unnest(list_distinct(regexp_extract_all(lower(name), {WORDS}))) AS token FROM node) JOIN (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(question), {WORDS}))) AS token FROM kq) USING (token) GROUP BY query_id, name, n)", ("node", "kq")),
    "khop": ("khop AS (SELECT query_id, chunk_index, count(*) AS score, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, chunk_index)::INTEGER AS rank FROM (SELECT query_id, chunk_index FROM kov JOIN edge ON name = src WHERE ratio >= 0.7 UNION ALL SELECT query_id, chunk_index FROM kov JOIN edge ON name = dst WHERE ratio >= 0.7) GROUP BY query_id, chunk_index QUALIFY rank <= 6)", ("kov", "edge")),
    "ans": (
        "ans AS (SELECT doc_id, lang AS type, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS arm, quality, toxic, n_chars, quality = 1 AS passed, doc_id % 3 = 0 AS rewrote, (n_chars / 1000.0)::DOUBLE AS latency FROM documents JOIN labels USING (doc_id))",
        (),
    ),
}


def with_ctes(sql: str) -> str:
    """WITH ... for every CTE that the text names in braces, in order of need."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for n in CTES[name][1]:
            need(n)
        if name not in wanted:
            wanted.append(name)

    for name in CTES:
        if "{" + name + "}" in sql:
            need(name)
            sql = sql.replace("{" + name + "}", name)
    if not wanted:
        return sql
    head = ", ".join(CTES[n][0] for n in wanted)
    return f"WITH {head}, {sql.lstrip()[5:]}" if sql.lstrip().upper().startswith("WITH ") else f"WITH {head} {sql}"


def questions(spark: SparkSession, sf_dir: str, first: int = 1, n: int = 12) -> DataFrame:
    """Benchmark passages as questions: n of their tokens from the first."""
    words = F.slice(tokens(F.col("text")), first, n)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("question"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same questions, each followed by one of the endings in turn."""
    ending = F.element_at(F.array(*[F.lit(q) for q in ASKED]), (F.col("query_id") % len(ASKED) + 1).cast("int"))
    return questions(spark, sf_dir).withColumn("question", F.concat_ws(" ", "question", ending))


def best(spark: SparkSession, sf_dir: str, k: int = 12, first: int = 1, n: int = 12) -> DataFrame:
    return lexical.bm25_topk(table(spark, sf_dir, "documents"), questions(spark, sf_dir, first, n), "doc_id", k)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("anchor"))
    return metrics.anchor_hits(passages, table(spark, sf_dir, "documents"), "doc_id").select("query_id", "doc_id")


def ranked_lists(spark: SparkSession, sf_dir: str, k: int = 6) -> DataFrame:
    """query_id, list_id, rank, key: BM25 by twelve tokens and by three."""
    keys = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"))
    both = best(spark, sf_dir, k).withColumn("list_id", F.lit(0)).unionByName(best(spark, sf_dir, k, 5, 3).withColumn("list_id", F.lit(1)))
    return both.join(keys, "doc_id").select("query_id", "list_id", "rank", "key")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts the lowest doc_id is current, the others superseded. Texts aren't moved unless the superseded rows are many."""
    md5 = F.md5(F.col("text").cast("binary")).alias("md5")
    hashed = table(spark, sf_dir, "documents").select("doc_id", md5)
    firsts = hashed.groupBy("md5").agg(F.min("doc_id").alias("first"))
    # By document too: rows of one text are many.
    current = (F.col("h.doc_id") == F.col("first")) & F.col("h.md5").eqNullSafe(F.col("f.md5"))
    old = written(hashed.alias("h").join(firsts.alias("f"), current, "left_anti").distinct(), "superseded")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", md5)
    met = (docs["doc_id"] == F.col("old_id")) & docs["md5"].eqNullSafe(F.col("old_md5"))
    marked = docs.join(old.select(F.col("doc_id").alias("old_id"), F.col("md5").alias("old_md5"), F.lit(True).alias("old")), met, "left")
    return marked.select("doc_id", "source", "text", "md5", F.coalesce("old", F.lit(False)).alias("superseded"))


def engine_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as the engine's chunks; of equal texts all but the first are superseded."""
    return versions(spark, sf_dir).select(F.col("doc_id").alias("chunk_index"), "source", F.when(F.col("superseded"), "v1").otherwise("current").alias("version"), "superseded", F.lit(None).cast("string").alias("kind"), F.col("text").alias("page_content"), "md5")


def engine_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as the engine's chunks, whose marks lie beside them."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_index"), "source", F.lit(None).cast("string").alias("kind"), F.col("text").alias("page_content"))


def engine_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_index, version, superseded, md5 of documents, as in `engine_chunks`: texts are read once and never moved, however many are superseded."""
    hashed = written(table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5")), "hashes")
    firsts = hashed.groupBy("md5").agg(F.min("doc_id").alias("first"))
    # By document too: rows of one text are many.
    met = hashed.alias("h").join(firsts.alias("f"), (F.col("h.doc_id") == F.col("first")) & F.col("h.md5").eqNullSafe(F.col("f.md5")), "left")
    superseded = F.col("first").isNull()
    return written(met.select(F.col("h.doc_id").alias("chunk_index"), F.when(superseded, "v1").otherwise("current").alias("version"), superseded.alias("superseded"), F.col("h.md5").alias("md5")), "marks")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as positioned chunks; system turns stand for tables."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source"), "turn", F.when(F.col("role") == "system", "table").alias("kind"), F.col("text").alias("page_content"))
    return chunking.with_positions(turns, "source", ["turn"]).drop("turn")


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns ranked by length: ranked lists with a query for each source."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.length("page_content").desc(), "chunk_index"))
    return chunks(spark, sf_dir).withColumns({"query_id": F.col("source"), "rank": rank})


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first vector of each label asks."""
    vectors = table(spark, sf_dir, "embeddings")
    first = vectors.groupBy("label").agg(F.min("vec_id").alias("query_id"))
    return vectors.join(first.select("query_id"), F.col("vec_id") == F.col("query_id")).select("query_id", F.col("embedding").alias("query_vector"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, relation, chunk_index of the star schema as a graph."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    placed = table(spark, sf_dir, "orders").select(text("order ", "o_orderkey").alias("src"), text("customer ", "o_custkey").alias("dst"), F.lit("placed_by").alias("relation"), F.col("o_orderkey").alias("chunk_index"))
    lives = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(text("customer ", "c_custkey").alias("src"), F.lower("n_name").alias("dst"), F.lit("located_in").alias("relation"), F.col("c_custkey").alias("chunk_index"))
    part = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("n_name").alias("src"), F.lower("r_name").alias("dst"), F.lit("part_of").alias("relation"), F.col("n_nationkey").cast("long").alias("chunk_index"))
    sells = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(text("supplier ", "s_suppkey").alias("src"), F.lower("n_name").alias("dst"), F.lit("located_in").alias("relation"), F.col("s_suppkey").alias("chunk_index"))
    return placed.unionByName(lives).unionByName(part).unionByName(sells)


def node_names(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.select(F.col("src").alias("name")).unionByName(edge_rows.select(F.col("dst").alias("name"))).distinct()


def graph_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    asked = F.concat(F.lit("which customers are located in "), F.lower("n_name"), F.lit(" of "), F.lower("r_name"))
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("query_id"), asked.alias("question"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as graded answers: type, arm, passed, rewrote, latency."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    df = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return df.select("doc_id", F.col("lang").alias("type"), F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("arm"), "quality", "toxic", "n_chars", (F.col("quality") == 1).alias("passed"), (F.col("doc_id") % 3 == 0).alias("rewrote"), (F.col("n_chars") / 1000.0).alias("latency"))
