"""What of a ranked list goes into the prompt: cut, neighbours, parents, order, text and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexical import top_k


def cut(ranked: DataFrame, top_n: Column | int, exclude_whole_blocks: bool = False) -> DataFrame:
    """The first top_n rows, after diagrams are left out if asked for; rank is counted anew."""
    if exclude_whole_blocks:
        ranked = ranked.where(~F.coalesce(F.col("kind") == "diagram", F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= top_n)


def neighbours_of(selected: DataFrame, chunks: DataFrame, window: int) -> DataFrame:
    """selected with page_content widened to the prose chunks within `window` of the same source, in order.

    Each chunk is looked up at the few positions it needs, an equi-join on (source, chunk_index), not a range join.
    Whole blocks (a kind) are neither widened nor pulled in. A window of 0 or less changes nothing.
    """
    if window <= 0:
        return selected
    prose = chunks.where("kind is null").select("source", F.col("chunk_index").alias("near"), F.col("page_content").alias("near_content"))
    keys = [c for c in selected.columns if c != "page_content"]
    around = selected.where("kind is null").drop("page_content").withColumn("near", F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)))
    # An inner join, so that few selected rows can be sent to the chunks; the rows themselves come beside it.
    met = around.join(prose, ["source", "near"]).where("near_content is not null").select(*keys, F.lit(None).cast("string").alias("page_content"), F.struct("near", "near_content").alias("n"))
    both = met.unionByName(selected.withColumn("n", F.lit(None).cast(met.schema["n"].dataType)))
    met = both.groupBy(*keys).agg(F.min("page_content").alias("own"), F.sort_array(F.collect_list("n")).alias("n"))
    return met.select(*keys, F.when(F.col("kind").isNull(), F.array_join("n.near_content", "\n")).otherwise(F.col("own")).alias("page_content"))


def widened(chunks: DataFrame, window: int) -> DataFrame:
    """Every prose chunk widened, as one window pass over each source: the plan for whole corpora."""
    frame = Window.partitionBy("source").orderBy("chunk_index").rangeBetween(-window, window)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "page_content")).over(frame)), lambda x: x["page_content"]), "\n")
    return chunks.where("kind is null").withColumn("page_content", text)


def parents_of(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Parents in the order of their first child; unknown ids drop out."""
    first = children.groupBy("query_id", "parent_id").agg(F.min("rank").alias("first_rank")).join(parents, "parent_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("first_rank"))
    return first.withColumn("rank", rank)


def ordered(items: Column, order: str | Column = "reversed") -> Column:
    """An array in rank order, arranged for the prompt: ranked, sandwich (three or more: first, rest reversed, first), or reversed. The order may differ by row."""
    order = F.lit(order) if isinstance(order, str) else order
    head = F.slice(items, 1, 1)
    sandwich = F.concat(head, F.reverse(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))), head)
    return F.when(order == "ranked", items).when((order == "sandwich") & (F.size(items) >= 3), sandwich).otherwise(F.reverse(items))


def context_text(docs: DataFrame, order: str | Column = "ranked", separator: str = "\n---\n", prefix: str = "[archived {version}] ") -> DataFrame:
    """query_id, context, sources: texts joined (archived ones marked), and the sorted distinct sources used. order: one for all, or a column that is the same in a query's rows."""
    before, after = prefix.split("{version}")
    text = F.when(F.col("superseded"), F.concat(F.lit(before), F.col("version"), F.lit(after), F.col("page_content"))).otherwise(F.col("page_content"))
    arranged = F.lit(order) if isinstance(order, str) else order
    rows = docs.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", text.alias("t")))).alias("d"), F.array_sort(F.collect_set("source")).alias("sources"), F.min(arranged).alias("o"))
    return rows.select("query_id", F.array_join(ordered(F.col("d.t"), F.col("o")), separator).alias("context"), "sources")


__all__ = ["context_text", "cut", "neighbours_of", "ordered", "parents_of", "top_k", "widened"]
