"""Queries on the knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fusion, kgraph
from . import workload as w
from .workload import query, table

@query("entity_normalize", r"SELECT p_partkey, CASE WHEN regexp_full_match(n, '[\x00-\x7F]*') THEN lower(n) ELSE n END AS name FROM (SELECT p_partkey, trim(regexp_replace(CASE WHEN p_partkey % 3 = 0 THEN '  ' || p_name || chr(9) || ' Part ' ELSE '부품  ' || p_brand || chr(10) || ' X ' END, '\s+', ' ', 'g')) AS n FROM part)")
def entity_normalize(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), "p_name", F.lit("\t Part "))).otherwise(F.concat(F.lit("부품  "), "p_brand", F.lit("\n X ")))
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_entity(name).alias("name"))


def triples(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.when(F.col("s_suppkey") % 10 == 0, " ").otherwise(F.col("s_name")).alias("subject"), F.lit("located_in").alias("relation"), F.col("n_name").alias("object"), F.col("s_suppkey").alias("chunk_index"), F.lit("supplier").alias("source"))


TRIPLES = "SELECT lower(s_name) AS src, lower(n_name) AS dst, 'located_in' AS relation, s_suppkey AS chunk_index, s_name AS src_label, n_name AS dst_label FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 10 <> 0"


@query("kg_edges", f"SELECT src, dst, relation, chunk_index FROM ({TRIPLES})")
def kg_edges(spark, sf_dir):
    return kgraph.edges(triples(spark, sf_dir)).select("src", "dst", "relation", "chunk_index")


@query("kg_nodes", f"SELECT name, max_by(label, o) AS label FROM (SELECT src AS name, src_label AS label, chunk_index AS o FROM ({TRIPLES}) UNION ALL SELECT dst, dst_label, chunk_index FROM ({TRIPLES})) GROUP BY name")
def kg_nodes(spark, sf_dir):
    return kgraph.nodes(kgraph.edges(triples(spark, sf_dir)))


@query("kg_stats", f"SELECT count(*) AS chunks_seen, count(*) FILTER (n IS NULL) AS chunks_empty, coalesce(sum(n), 0)::BIGINT AS triples FROM (SELECT s_suppkey AS chunk_index FROM supplier) LEFT JOIN (SELECT chunk_index, count(*) AS n FROM ({TRIPLES}) GROUP BY 1) USING (chunk_index)")
def kg_stats(spark, sf_dir):
    chunks = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chunk_index"), F.lit(None).cast("string").alias("kind"))
    return kgraph.stats(chunks, kgraph.edges(triples(spark, sf_dir)))


@query("kg_seeds", "SELECT query_id, name FROM {kov} WHERE ratio >= 0.7")
def kg_seeds(spark, sf_dir):
    return kgraph.seeds(w.node_names(w.edges(spark, sf_dir)), w.graph_questions(spark, sf_dir))


@query("kg_search", "SELECT query_id, rank, chunk_index, score FROM {khop}")
def kg_search(spark, sf_dir):
    edges = w.edges(spark, sf_dir)
    return kgraph.one_hop(kgraph.seeds(w.node_names(edges), w.graph_questions(spark, sf_dir)), edges, 6).select("query_id", "rank", "chunk_index", "score")


@query(
    "kg_fused",
    "SELECT query_id, rank, key FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)), 9) DESC, min(list_id * 1000 + rank))::INTEGER AS rank FROM (SELECT query_id, 0 AS list_id, rank, chunk_index::VARCHAR AS key FROM {khop} UNION ALL SELECT query_id, 1, row_number() OVER (PARTITION BY query_id ORDER BY c_custkey), c_custkey::VARCHAR FROM (SELECT c_nationkey::BIGINT AS query_id, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 6)) GROUP BY query_id, key) WHERE rank <= 6",
)
def kg_fused(spark, sf_dir):
    """The graph's list and a plain list of each nation's first customers."""
    edges = w.edges(spark, sf_dir)
    graph = kgraph.one_hop(kgraph.seeds(w.node_names(edges), w.graph_questions(spark, sf_dir)), edges, 6).select("query_id", F.lit(0).alias("list_id"), "rank", F.col("chunk_index").cast("string").alias("key"))
    plain = kgraph.top_k(table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("query_id"), "c_custkey"), 6, F.col("c_custkey"))
    lists = graph.unionByName(plain.select("query_id", F.lit(1).alias("list_id"), "rank", F.col("c_custkey").cast("string").alias("key")))
    return fusion.fuse(lists, 6, 60).select("query_id", "rank", "key")


RELATIONS = "SELECT o_orderkey AS ord, 'order of ' || o_custkey AS sentence, 'customer ' || o_custkey AS subject, CASE o_orderkey % 3 WHEN 0 THEN 'no_relation' WHEN 1 THEN 'placed' ELSE 'rated' END AS relation, o_orderpriority AS object FROM orders"


def relation_rows(spark, sf_dir):
    kind = F.when(F.col("o_orderkey") % 3 == 0, "no_relation").when(F.col("o_orderkey") % 3 == 1, "placed").otherwise("rated")
    who = F.col("o_custkey").cast("string")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("order of "), who).alias("sentence"), F.concat(F.lit("customer "), who).alias("subject"), kind.alias("relation"), F.col("o_orderpriority").alias("object"))


@query("sentence_group", f"SELECT (row_number() OVER (ORDER BY first_ord) - 1)::INTEGER AS chunk_index, sentence, n_triples FROM (SELECT sentence, min(ord) AS first_ord, count(*) FILTER (relation <> 'no_relation')::INTEGER AS n_triples FROM ({RELATIONS}) GROUP BY sentence ORDER BY first_ord LIMIT 1500)")
def sentence_group(spark, sf_dir):
    return kgraph.sentence_chunks(relation_rows(spark, sf_dir), 1500).select("chunk_index", "sentence", F.size("triples").alias("n_triples"))


#: Question templates by relation (the caller's table in use); particles agree with the subject.
TEMPLATES = [("placed", "{s}{eun_neun} 무엇을 주문했나요?"), ("rated", "{s}{i_ga} 매긴 등급은?")]


@query("render_question", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN s || CASE WHEN closed THEN '은' ELSE '는' END || ' 어디' WHEN 1 THEN s || CASE WHEN closed THEN '이' ELSE '가' END || ' 좋다' ELSE s || CASE WHEN closed THEN '을' ELSE '를' END || ' 본다' END AS question FROM (SELECT c_custkey, c_custkey % 2 = 0 AS closed, c_name || CASE WHEN c_custkey % 4 = 1 THEN '' WHEN c_custkey % 2 = 0 THEN '상점' ELSE '회사' END AS s FROM customer)")
def render_question(spark, sf_dir):
    """Names end in a closed syllable, an open one, or a digit; each template asks for another particle."""
    i = F.col("c_custkey")
    template = F.get(F.array(F.lit("{s}{eun_neun} 어디"), F.lit("{s}{i_ga} 좋다"), F.lit("{s}{eul_reul} 본다")), (i % 3).cast("int"))
    subject = F.concat("c_name", F.when(i % 4 == 1, "").when(i % 2 == 0, "상점").otherwise("회사"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.render_question(template, subject).alias("question"))


@query(
    "capped_questions",
    f"SELECT row_number() OVER (ORDER BY chunk_index, relation, subject, object) AS query_id, CASE relation WHEN 'placed' THEN subject || '는 무엇을 주문했나요?' ELSE subject || '가 매긴 등급은?' END AS question, relation, chunk_index FROM (SELECT ord AS chunk_index, relation, subject, object FROM ({RELATIONS}) WHERE relation <> 'no_relation' QUALIFY row_number() OVER (PARTITION BY relation ORDER BY ord, subject, object) <= 6 ORDER BY ord, relation, subject, object LIMIT 120)",
)
def capped_questions(spark, sf_dir):
    rows = relation_rows(spark, sf_dir).where("relation <> 'no_relation'").withColumnRenamed("ord", "chunk_index")
    return kgraph.questions_of(rows, spark.createDataFrame(TEMPLATES, "relation string, template string"), 6, 120)


@query("sweep_seed_ratio", "SELECT ratio_limit, count(*) AS n_seeds, count(DISTINCT query_id) AS n_queries FROM {kov}, (SELECT unnest([0.3, 0.5, 0.6, 0.7, 1.0])::DOUBLE AS ratio_limit) WHERE ratio >= ratio_limit GROUP BY ratio_limit")
def sweep_seed_ratio(spark, sf_dir):
    limits = spark.createDataFrame([(x,) for x in (0.3, 0.5, 0.6, 0.7, 1.0)], "ratio_limit double")
    rows = kgraph.overlaps(w.node_names(w.edges(spark, sf_dir)), w.graph_questions(spark, sf_dir)).crossJoin(F.broadcast(limits))
    return rows.where("ratio >= ratio_limit").groupBy("ratio_limit").agg(F.count(F.lit(1)).alias("n_seeds"), F.countDistinct("query_id").alias("n_queries"))
