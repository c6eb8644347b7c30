"""The engine from SQL: table functions that cut texts, and views of a stored index.

After `register(spark)`:

    SELECT d.doc_id, c.ord, c.page_content FROM documents d, LATERAL recursive_chunks(d.text, 800, 100) c
    SELECT d.doc_id, b.kind, b.marker, b.page_content FROM documents d, LATERAL whole_blocks(d.text) b

A null text gives no rows. `register_index` makes the views that the statement of `search_statement` reads.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .operators.chunking import split_blocks, split_recursive
from .settings import DEFAULTS
from .sources import postings


class RecursiveChunks:
    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        yield from enumerate(split_recursive(text, size, overlap))


class WholeBlocks:
    def eval(self, text: str) -> Iterator[tuple]:
        for b in split_blocks(text, DEFAULTS.table_marker, DEFAULTS.diagram_marker)["blocks"]:
            yield b["n"], b["kind"], b["marker"], b["page_content"]


def register(spark: SparkSession) -> None:
    spark.udtf.register("recursive_chunks", udtf(RecursiveChunks, returnType="ord int, page_content string"))
    spark.udtf.register("whole_blocks", udtf(WholeBlocks, returnType="n int, kind string, marker string, page_content string"))


def register_index(spark: SparkSession, index: postings.Index, view: str = "words") -> None:
    """Views `view`_postings (term, key, tf, dl) and `view`_terms (term, df) of one snapshot."""
    every = list(range(index.manifest["buckets"]))
    rows = index.postings(every).selectExpr("bucket", "term", "inline(arrays_zip(keys, tfs, dls)) as (key, tf, dl)")
    rows.createOrReplaceTempView(f"{view}_postings")
    index.terms(every).createOrReplaceTempView(f"{view}_terms")


def search_statement(index: postings.Index, questions: str, k: int, view: str = "words", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> str:
    """SQL that ranks chunks for the rows (query_id, term, qtf) of a table or view."""
    said = index.manifest
    mean = said["tokens"] / said["n_texts"]
    weight = f"ln({said['n']} - df + 0.5D) - ln(df + 0.5D)"
    return f"""WITH w AS (SELECT query_id, term, qtf, CASE WHEN {weight} < 0 THEN {said['mean_idf'] * epsilon!r}D ELSE {weight} END AS idf FROM {questions} JOIN {view}_terms USING (term)),
    s AS (SELECT query_id, key, round(sum(idf * qtf * tf * {k1 + 1}D / (tf + {k1}D * ({1 - b}D + {b}D * dl / {mean!r}D))), 6) AS score FROM w JOIN {view}_postings USING (term) GROUP BY query_id, key)
    SELECT query_id, rank, key, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM s WHERE score > 0) WHERE rank <= {k}"""
