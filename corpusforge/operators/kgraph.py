"""A property multigraph of triples: nodes, edges, seeded one-hop ranking, questions from triples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_entity, render_question, tokens
from .lexical import Analyser, top_k


#: A question for each relation; {s} is the subject, the other names are particles.
TEMPLATES = {
    "org:dissolved": "{s}{eun_neun} 언제 해체(폐업)되었나요?",
    "org:founded": "{s}{eun_neun} 언제 설립되었나요?",
    "org:place_of_headquarters": "{s}의 본사는 어디에 있나요?",
    "org:alternate_names": "{s}의 다른 이름(별칭)은 무엇인가요?",
    "org:member_of": "{s}{eun_neun} 어디에 소속되어 있나요?",
    "org:members": "{s}의 소속 구성원(회원)은 누구인가요?",
    "org:political/religious_affiliation": "{s}{eun_neun} 어떤 정치·종교 성향과 관련이 있나요?",
    "org:product": "{s}{i_ga} 만든 제품(생산물)은 무엇인가요?",
    "org:founded_by": "{s}{eul_reul} 설립한 사람(단체)은 누구인가요?",
    "org:top_members/employees": "{s}의 대표(임원)는 누구인가요?",
    "org:number_of_employees/members": "{s}의 구성원(직원) 수는 몇 명인가요?",
    "per:date_of_birth": "{s}{eun_neun} 언제 태어났나요?",
    "per:date_of_death": "{s}{eun_neun} 언제 사망했나요?",
    "per:place_of_birth": "{s}{eun_neun} 어디에서 태어났나요?",
    "per:place_of_death": "{s}{eun_neun} 어디에서 사망했나요?",
    "per:place_of_residence": "{s}{eun_neun} 어디에 거주하나요?",
    "per:origin": "{s}의 국적(출신)은 어디인가요?",
    "per:employee_of": "{s}{eun_neun} 어느 조직(회사)에 소속되어 있나요?",
    "per:schools_attended": "{s}{eun_neun} 어느 학교를 다녔나요?",
    "per:alternate_names": "{s}의 다른 이름(별칭)은 무엇인가요?",
    "per:parents": "{s}의 부모는 누구인가요?",
    "per:children": "{s}의 자녀는 누구인가요?",
    "per:siblings": "{s}의 형제자매는 누구인가요?",
    "per:spouse": "{s}의 배우자는 누구인가요?",
    "per:other_family": "{s}의 다른 가족 관계는 누구인가요?",
    "per:colleagues": "{s}의 동료는 누구인가요?",
    "per:product": "{s}{i_ga} 관여한 제품(작품)은 무엇인가요?",
    "per:religion": "{s}의 종교는 무엇인가요?",
    "per:title": "{s}의 직함(역할)은 무엇인가요?",
}


def extracted(chunks: DataFrame, model: Callable[[DataFrame], DataFrame], most: int = 8) -> DataFrame:
    """subject, relation, object, chunk_index, source of what a model finds in each chunk (diagrams aside).

    model adds `raw`: a JSON array of objects with subject, relation and object. The first `most` of a chunk are taken; what
    can't be parsed gives none, and a triple that lacks a part is left out.
    """
    said = model(chunks.where(~F.coalesce(F.col("kind") == "diagram", F.lit(False))))
    parsed = F.from_json("raw", "array<struct<subject:string,relation:string,object:string>>")
    taken = said.select("chunk_index", "source", F.explode(F.slice(parsed, 1, most)).alias("t"))
    return taken.where("t.subject is not null and t.relation is not null and t.object is not null").select("t.subject", "t.relation", "t.object", "chunk_index", "source")


def edges(triples: DataFrame) -> DataFrame:
    """src, dst, relation, chunk_index, source, src_label, dst_label of triples with both ends."""
    src, dst = normalize_entity(F.col("subject")), normalize_entity(F.col("object"))
    df = triples.select(src.alias("src"), dst.alias("dst"), "relation", "chunk_index", "source", F.trim("subject").alias("src_label"), F.trim("object").alias("dst_label"))
    return df.where((F.col("src") != "") & (F.col("dst") != ""))


def nodes(edge_rows: DataFrame, order: str = "chunk_index") -> DataFrame:
    """name, label: the label that was written last (by `order`, then the larger label)."""
    ends = edge_rows.select(F.col("src").alias("name"), F.col("src_label").alias("label"), F.col(order).alias("o")).unionByName(edge_rows.select(F.col("dst").alias("name"), F.col("dst_label").alias("label"), F.col(order).alias("o")))
    return ends.groupBy("name").agg(F.max(F.struct("o", "label"))["label"].alias("label"))


def stats(chunks: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """chunks_seen (diagrams aside), chunks_empty, triples."""
    seen = chunks.where(~F.coalesce(F.col("kind") == "diagram", F.lit(False))).select("chunk_index")
    counts = edge_rows.groupBy("chunk_index").agg(F.count(F.lit(1)).alias("n"))
    return seen.join(counts, "chunk_index", "left").agg(F.count(F.lit(1)).alias("chunks_seen"), F.coalesce(F.sum(F.when(F.col("n").isNull(), 1).otherwise(0)), F.lit(0)).cast("long").alias("chunks_empty"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("triples"))


def overlaps(node_rows: DataFrame, questions: DataFrame, analyse: Analyser = tokens) -> DataFrame:
    """query_id, name, ratio: share of a node's distinct tokens that the question has; an equi-join on tokens."""
    node_tokens = node_rows.select("name", F.array_distinct(analyse(F.col("name"))).alias("t")).select("name", F.size("t").alias("n"), F.explode("t").alias("token"))
    asked = questions.select("query_id", F.explode(F.array_distinct(analyse(F.col("question")))).alias("token"))
    return node_tokens.join(asked, "token").groupBy("query_id", "name", "n").agg(F.count(F.lit(1)).alias("hits")).select("query_id", "name", (F.col("hits") / F.col("n")).alias("ratio"))


def seeds(node_rows: DataFrame, questions: DataFrame, ratio: float | Column = 0.7, analyse: Analyser = tokens) -> DataFrame:
    """query_id, name of the nodes that a question mentions."""
    return overlaps(node_rows, questions, analyse).where(F.col("ratio") >= ratio).select("query_id", "name")


def one_hop(seed_rows: DataFrame, edge_rows: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """query_id, rank, chunk_index, score: incident edges of the seeds by chunk, out and in; an edge between seeds counts twice."""
    links = edge_rows.where("chunk_index is not null")
    out = seed_rows.join(links, F.col("name") == F.col("src")).select(*by, "chunk_index")
    back = seed_rows.join(links, F.col("name") == F.col("dst")).select(*by, "chunk_index")
    scored = out.unionByName(back).groupBy(*by, "chunk_index").agg(F.count(F.lit(1)).alias("score"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "chunk_index"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def sentence_chunks(rows: DataFrame, most: int = 1500) -> DataFrame:
    """rows (ord, sentence, subject, relation, object) to unique sentences in order of first appearance, with their triples.

    no_relation rows give a chunk but no triple.
    """
    triple = F.when(F.col("relation") != "no_relation", F.struct("ord", "subject", "relation", "object"))
    grouped = rows.groupBy("sentence").agg(F.min("ord").alias("first_ord"), F.sort_array(F.collect_list(triple)).alias("triples"))
    # TakeOrdered: `most` rows at most are numbered in one task.
    first = grouped.orderBy("first_ord").limit(most)
    return first.withColumn("chunk_index", F.row_number().over(Window.orderBy("first_ord")) - 1)


def questions_of(triples: DataFrame, templates: DataFrame | None = None, per_relation: int = 6, most: int = 120) -> DataFrame:
    """query_id, question, relation, chunk_index: in order of chunks, per_relation of each relation, `most` in all. templates: relation, template."""
    if templates is None:
        templates = triples.sparkSession.createDataFrame(list(TEMPLATES.items()), "relation string, template string")
    capped = triples.join(F.broadcast(templates), "relation").withColumn("n", F.row_number().over(Window.partitionBy("relation").orderBy("chunk_index", "subject", "object"))).where(F.col("n") <= per_relation)
    first = capped.orderBy("chunk_index", "relation", "subject", "object").limit(most)
    number = F.row_number().over(Window.orderBy("chunk_index", "relation", "subject", "object"))
    return first.select(number.cast("long").alias("query_id"), render_question(F.col("template"), F.col("subject")).alias("question"), "relation", "chunk_index")


__all__ = ["edges", "extracted", "nodes", "one_hop", "questions_of", "seeds", "sentence_chunks", "stats", "top_k"]
