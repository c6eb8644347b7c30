"""Queries on sources, cleaning, chunking, stores and data checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audits, chunking
from ..settings import DEFAULTS
from ..sources import files, store
from . import workload as w
from .workload import query, table

DOCS = "documents"
#: What the driver's texts lack: macros, images, links with encoded paths, leftover targets, tags, blanks at line ends and empty lines, put around each text.
MARKS = {0: ("$\\color{red}{Title}$ and ![logo](a.png) here ", " end   ~two  ~~~~  tail  ~"), 1: ("see [home](pages%20home/x.md) and [site](https://example.org/a%20b) ", " more](left%20over.md) x"), 2: ("a<br/>b <DIV class=\"x\">c</div>~~~~", "~~~"), 3: ("  ~", "")}
_quoted = lambda s: "replace('" + s.replace("'", "''") + "', '~', chr(10))"
_case = lambda side: "CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN {_quoted(m[side])}" for k, m in MARKS.items()) + " END"
NOISY_SQL = f"(SELECT doc_id, {_case(0)} || text || {_case(1)} AS text FROM documents)"


def noisy(spark, sf_dir):
    """documents with marks around each text."""
    side = lambda n: F.get(F.array(*[F.lit(m[n].replace("~", "\n")) for m in MARKS.values()]), (F.col("doc_id") % 4).cast("int"))
    return table(spark, sf_dir, DOCS).select("doc_id", F.concat(side(0), "text", side(1)).alias("text"))


@query("scan_documents", "SELECT source, count(*) AS n_docs, sum(n_chars)::BIGINT AS chars, min(doc_id) AS first_doc FROM documents GROUP BY source")
def scan_documents(spark, sf_dir):
    return table(spark, sf_dir, DOCS).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first_doc"))


PATHS = "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'archive/v' || (page_id % 5) || '/page' || page_id || '.md' WHEN page_id % 3 = 1 THEN 'notes/page' || page_id || '.docx' ELSE 'page' || page_id || CASE WHEN page_id % 2 = 0 THEN '.hwp' ELSE '.exe' END END AS path FROM pages"


def paths(spark, sf_dir):
    i, text = F.col("page_id"), lambda c: c.cast("string")
    old = F.concat(F.lit("archive/v"), text(i % 5), F.lit("/page"), text(i), F.lit(".md"))
    path = F.when(i % 3 == 0, old).when(i % 3 == 1, F.concat(F.lit("notes/page"), text(i), F.lit(".docx"))).otherwise(F.concat(F.lit("page"), text(i), F.when(i % 2 == 0, ".hwp").otherwise(".exe")))
    return files.described(table(spark, sf_dir, "pages").select("page_id", path.alias("path")), "path")


@query("version_from_path", f"SELECT page_id, CASE WHEN path LIKE 'archive/%/%' THEN string_split(path, '/')[2] ELSE 'current' END AS version, path LIKE 'archive/%/%' AS superseded, CASE WHEN path LIKE 'archive/%/%' THEN string_split(path, '/')[3] || '@' || string_split(path, '/')[2] ELSE path END AS source FROM ({PATHS})")
def version_from_path(spark, sf_dir):
    return paths(spark, sf_dir).select("page_id", "version", "superseded", "source")


@query("rejected_sources", f"SELECT page_id, regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) AS suffix FROM ({PATHS}) WHERE regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) NOT IN ('md', 'txt', 'docx', 'hwpx', 'pdf')")
def rejected_sources(spark, sf_dir):
    return files.rejected(paths(spark, sf_dir)).select("page_id", "suffix")


@query("normalize_ws", f"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?m)[ \\t]+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM {NOISY_SQL}")
def normalize_ws(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", F.md5(T.normalize_ws(F.col("text")).cast("binary")).alias("text_md5"))


@query("normalize_ws_documents", "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?m)[ \\t]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM documents")
def normalize_ws_documents(spark, sf_dir):
    return table(spark, sf_dir, DOCS).select("doc_id", F.md5(T.normalize_ws(F.col("text")).cast("binary")).alias("text_md5"))


CLEAN_SQL = [(r"\$\\color\{[^}]*\}\{([^}]*)\}\$", r"'\1'"), (r"!\[[^\]]*\]\([^)]*\)", "''"), (r"\[([^\]]*)\]\([^():]*%[^():]*\)", r"'\1'"), (r"\]\([^():]*%[0-9A-Fa-f]{2}[^():]*\)", "''"), (r"(?i)</?(?:br|div|span|aside|img|p)\b[^>]*/?>", "' '"), (r"\n{3,}", "chr(10) || chr(10)")]


def cleaned_sql(text: str) -> str:
    """DuckDB's expression for the cleaning rules in order. It has no look-ahead: a target with a colon stands for one with a scheme."""
    for pattern, by in CLEAN_SQL:
        text = f"regexp_replace({text}, '{pattern}', {by}, 'g')"
    return text


@query("clean_text", f"SELECT doc_id, md5({cleaned_sql('text')}) AS text_md5 FROM {NOISY_SQL}")
def clean_text(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", F.md5(T.clean_markdown(F.col("text")).cast("binary")).alias("text_md5"))


@query("strip_html", r"SELECT page_id, md5(regexp_replace(html, '(?i)</?(?:br|div|span|aside|img|p)\b[^>]*/?>', ' ', 'g')) AS text_md5 FROM pages")
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_html(F.col("html")).cast("binary")).alias("text_md5"))


@query("index_manifest", "SELECT n_chunks, n_chunks > 0 AS filled, 800 AS chunk_size, 100 AS chunk_overlap, 30 AS min_chunk_chars FROM (SELECT count(*) AS n_chunks FROM conversations)")
def index_manifest(spark, sf_dir):
    rows = w.chunks(spark, sf_dir).withColumn("md5", F.md5(F.col("page_content").cast("binary")))
    return store.manifest(rows, DEFAULTS).select("n_chunks", (F.col("n_chunks") > 0).alias("filled"), "chunk_size", "chunk_overlap", "min_chunk_chars")


FINGERPRINT = "SELECT count(*) AS n_chunks, md5(count(*)::VARCHAR || ':' || sum(('0x' || substr(d, 1, 12))::BIGINT)::VARCHAR || ':' || sum(('0x' || substr(d, 13, 12))::BIGINT)::VARCHAR) AS fingerprint FROM (SELECT md5(doc_id::VARCHAR || ':' || md5(text)) AS d FROM documents)"


@query("corpus_fingerprint", FINGERPRINT)
def corpus_fingerprint(spark, sf_dir):
    return audits.fingerprint(table(spark, sf_dir, DOCS), "doc_id", F.md5(F.col("text").cast("binary")))


@query("consistency_check", "SELECT 'same' AS compared, 'ok' AS status UNION ALL SELECT 'changed', 'mismatch' UNION ALL SELECT 'absent', 'unknown'")
def consistency_check(spark, sf_dir):
    def of(text):
        rows = table(spark, sf_dir, DOCS).select("doc_id", text.alias("t"))
        return audits.fingerprint(rows, "doc_id", F.md5(F.col("t").cast("binary"))).select(F.col("fingerprint").alias("chunks_md5"))

    now, then = of(F.col("text")), of(F.concat(F.col("text"), F.lit("x")))
    named = lambda df, name: df.select(F.lit(name).alias("compared"), "status")
    return named(store.consistency(now, of(F.col("text"))), "same").unionByName(named(store.consistency(now, then), "changed")).unionByName(named(store.consistency(now, None), "absent"))


@query("chunk_min_filter", "SELECT conv_id, turn FROM conversations WHERE length(text) >= 120")
def chunk_min_filter(spark, sf_dir):
    return chunking.long_enough(table(spark, sf_dir, "conversations"), 120, "text").select("conv_id", "turn")


@query("chunk_positions", "SELECT chunk_index, source, doc_index, doc_total FROM {ch}")
def chunk_positions(spark, sf_dir):
    return w.chunks(spark, sf_dir).select("chunk_index", "source", "doc_index", "doc_total")


@query(
    "place_blocks",
    """WITH c AS (SELECT conv_id AS source, turn AS ord, text AS page_content FROM conversations),
    b AS (SELECT conv_id AS source, min(turn) AS ord, 'table' AS kind, CASE WHEN conv_id % 4 = 0 THEN 'nowhere' ELSE substr(max_by(text, turn), 5, 12) END AS marker FROM conversations GROUP BY conv_id),
    a AS (SELECT b.source, min(c.ord) AS anchor FROM b JOIN c ON b.source = c.source AND contains(c.page_content, b.marker) GROUP BY b.source),
    u AS (SELECT source, NULL AS kind, ord::INTEGER AS a, 0 AS b, 0 AS c FROM c UNION ALL SELECT source, kind, coalesce(anchor, 2147483647)::INTEGER, 1, ord::INTEGER FROM b LEFT JOIN a USING (source))
    SELECT source, kind, (row_number() OVER (PARTITION BY source ORDER BY a, b, c) - 1)::INTEGER AS place FROM u""",
)
def place_blocks(spark, sf_dir):
    """A block for each conversation whose marker is a piece of its last turn, or missing."""
    prose = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source"), F.col("turn").alias("ord"), F.col("text").alias("page_content"))
    blocks = prose.groupBy("source").agg(F.min("ord").alias("ord"), F.max_by("page_content", "ord").alias("last"))
    marker = F.when(F.col("source") % 4 == 0, "nowhere").otherwise(F.substring("last", 5, 12))
    blocks = blocks.select("source", "ord", F.lit("table").alias("kind"), marker.alias("marker"), F.lit("").alias("page_content"))
    placed = chunking.place_blocks(prose, blocks)
    return placed.select("source", "kind", (F.row_number().over(Window.partitionBy("source").orderBy("place")) - 1).alias("place"))


@query("empty_sources", "SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE n_chars >= 15000)")
def empty_sources(spark, sf_dir):
    """Sources none of whose texts is long enough."""
    docs = table(spark, sf_dir, DOCS)
    return docs.select("source").distinct().join(docs.where("n_chars >= 15000").select("source"), "source", "left_anti")


EDGES = (0, 500, 1000, 1500, 2000, 4000, 8000, 16000, 200001)


@query("length_histogram", "SELECT low, high, count(*) AS n FROM documents JOIN (VALUES " + ", ".join(f"({a}, {b})" for a, b in zip(EDGES, EDGES[1:], strict=False)) + ") e(low, high) ON length(text) >= low AND length(text) < high GROUP BY ALL")
def length_histogram(spark, sf_dir):
    return audits.length_histogram(table(spark, sf_dir, DOCS), "text", EDGES)


@query("length_summary", "SELECT min(length(text))::INTEGER AS least, quantile_disc(length(text), 0.5)::INTEGER AS middle, (sum(length(text)) // count(*))::BIGINT AS mean, max(length(text))::INTEGER AS most FROM documents")
def length_summary(spark, sf_dir):
    size = F.length("text")
    return table(spark, sf_dir, DOCS).agg(F.min(size).alias("least"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY length(text))").cast("int").alias("middle"), F.floor(F.sum(size) / F.count(F.lit(1))).cast("long").alias("mean"), F.max(size).alias("most"))


@query("shortest_chunks", "SELECT doc_id, length(text)::INTEGER AS size, CASE WHEN length(text) < 30 THEN 'drop' ELSE 'keep' END AS mark FROM documents ORDER BY length(text), doc_id LIMIT 20")
def shortest_chunks(spark, sf_dir):
    size = F.length("text")
    return table(spark, sf_dir, DOCS).select("doc_id", size.alias("size"), F.when(size < 30, "drop").otherwise("keep").alias("mark")).orderBy("size", "doc_id").limit(20)


DEFECT_SQL = r"""SELECT rule, count(*) AS n_chunks FROM (SELECT page_id, unnest([CASE WHEN regexp_matches(html, '\$\\color\{') THEN 'color_macro' END, CASE WHEN regexp_matches(html, '!\[[^\]]*\]\(') THEN 'image_embed' END,
 CASE WHEN regexp_matches(html, '(?i)</?(?:br|div|span|aside|img|p)\b[^>]*>') THEN 'html_tag' END, CASE WHEN regexp_matches(regexp_replace(html, 'https?://\S+', ' ', 'g'), '%[0-9A-Fa-f]{2}') THEN 'encoded_path' END,
 CASE WHEN regexp_matches(html, '\n{3,}') THEN 'blank_lines' END]) AS rule FROM pages) WHERE rule IS NOT NULL GROUP BY rule"""


@query("defect_scan", DEFECT_SQL)
def defect_scan(spark, sf_dir):
    return audits.defects(table(spark, sf_dir, "pages"), "html")


@query("review_scan", "SELECT doc_id, 'mermaid' AS rule FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN chr(10) || '  flowchart TD ' ELSE '' END || text AS t FROM documents) WHERE regexp_matches(t, '(?m)```mermaid|^[\\s]*(?:graph|sequenceDiagram|flowchart)\\s')")
def review_scan(spark, sf_dir):
    """Every fifth document is given the first line of a drawn diagram."""
    text = F.concat(F.when(F.col("doc_id") % 5 == 0, "\n  flowchart TD ").otherwise(""), "text")
    return audits.for_review(table(spark, sf_dir, DOCS).select("doc_id", text.alias("t")), "doc_id", "t")


@query("systematic_sample", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, greatest(1, count(*) OVER () // 150) AS s FROM documents) WHERE p % s = 0 AND p / s < 150")
def systematic_sample(spark, sf_dir):
    rows = chunking.with_positions(table(spark, sf_dir, DOCS).select("doc_id", F.floor(F.col("doc_id") / 1000).alias("block")), "block", ["doc_id"])
    return audits.systematic(rows, "chunk_index", 150).select("doc_id")


@query("exact_duplicates", "SELECT md5(text) AS text_md5, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return table(spark, sf_dir, DOCS).groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query("adjacent_distance", "SELECT vec_id, round(1 - list_dot_product(e, nx) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(nx, nx))), 6) AS distance FROM (SELECT vec_id, embedding::DOUBLE[] AS e, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS nx FROM embeddings)")
def adjacent_distance(spark, sf_dir):
    return chunking.adjacent_distances(table(spark, sf_dir, "embeddings"), "label", "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query(
    "semantic_breakpoints",
    """WITH d AS (SELECT vec_id, label, round(1 - list_dot_product(e, nx) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(nx, nx))), 9) AS distance FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS nx FROM embeddings))
    SELECT vec_id FROM d JOIN (SELECT label, quantile_cont(distance, 0.95) AS p, stddev_pop(distance) AS s FROM d GROUP BY label) USING (label) WHERE s >= 1e-9 AND distance >= p""",
)
def semantic_breakpoints(spark, sf_dir):
    rows = chunking.adjacent_distances(table(spark, sf_dir, "embeddings"), "label", "vec_id").withColumn("distance", F.round("distance", 9))
    return chunking.breakpoints(rows, "label", 95.0).where("is_break").select("vec_id")


@query("sentences", r"SELECT doc_id, len(s)::INTEGER AS n, md5(array_to_string(s, '|')) AS sentences_md5 FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n{2,}'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)")
def sentence_split(spark, sf_dir):
    rows = table(spark, sf_dir, DOCS).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|").cast("binary")).alias("sentences_md5"))


@query("chunk_recursive")
def chunk_recursive(spark, sf_dir):
    rows = table(spark, sf_dir, DOCS).select("doc_id", F.posexplode(chunking.recursive_chunks(F.col("text"), 800, 100)).alias("ord", "page_content"))
    return rows.select("doc_id", "ord", F.length("page_content").alias("size"), F.md5(F.col("page_content").cast("binary")).alias("md5"))


@query("chunk_recursive_sql")
def chunk_recursive_sql(spark, sf_dir):
    """The same from SQL, by the table function."""
    from .. import sql

    sql.register(spark)
    table(spark, sf_dir, DOCS).createOrReplaceTempView("chunked_documents")
    return spark.sql("SELECT d.doc_id, c.ord, length(c.page_content) AS size, md5(c.page_content) AS md5 FROM chunked_documents d, LATERAL recursive_chunks(d.text, 800, 100) c")


@query("ingest_report")
def ingest_report(spark, sf_dir):
    """What the run that cuts the texts observes in passing: documents, those without a chunk, pieces, pieces too short."""
    docs = table(spark, sf_dir, DOCS).select(F.col("doc_id").cast("string").alias("source"), "text")
    report = chunking.Report()
    chunking.placed_chunks(docs, report=report)
    return spark.createDataFrame([tuple(report.counts()[c] for c in ("documents", "empty", "pieces", "dropped"))], "documents long, empty long, pieces long, dropped long")


@query("build_chunks")
def build_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, DOCS).select(F.col("doc_id").cast("string").alias("source"), "text")
    return chunking.build_chunks(docs).select("chunk_index", "source", "doc_index", "doc_total", "kind", "md5")


@query("parent_child")
def parent_child(spark, sf_dir):
    docs = table(spark, sf_dir, DOCS).select(F.col("doc_id").cast("string").alias("source"), "text")
    return chunking.parent_child(docs).select("source", "parent_id", "parent_ord", "child_ord", F.md5(F.col("child").cast("binary")).alias("child_md5"))


@query("semantic_chunks")
def semantic_chunks(spark, sf_dir):
    """Every fourth sentence ends a topic here; models give the breaks in use."""
    rows = table(spark, sf_dir, DOCS).select("doc_id", T.sentences(F.col("text")).alias("s"))
    breaks = F.filter(F.sequence(F.lit(0), F.greatest(F.size("s") - 1, F.lit(0))), lambda i: i % 4 == 3)
    out = rows.withColumn("c", chunking.semantic_chunks(F.col("s"), breaks))
    return out.select("doc_id", F.posexplode("c").alias("ord", "chunk")).select("doc_id", "ord", F.md5(F.col("chunk").cast("binary")).alias("md5"))


#: A block between two copies of a text: a table, rows without a rule, a diagram beside plain code, nothing. ~ is a line end.
TABLE = "| a | b |~| --- | --- |~| 1 | 2 |~| 3 | 4 |~"
BETWEEN = {0: TABLE, 1: "| not | a table |~| no | rule |~| at | all |~", 2: "```~┌──┐~│ x│~└──┘~```", 3: ""}
_collapsed = lambda e: f"regexp_replace({e}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
BLOCK_SQL = "WITH d AS (SELECT doc_id, doc_id % 4 AS k, '# Plan' || chr(10) || chr(10) || text || chr(10) || chr(10) AS a, chr(10) || 'after ' || text AS b FROM documents) SELECT doc_id, (k % 2 = 0)::INTEGER AS n_blocks, CASE k WHEN 0 THEN '[table: 1]' WHEN 2 THEN '[diagram: 1]' ELSE '' END AS markers, md5(CASE k " + " ".join([f"WHEN {k} THEN " + _collapsed(f"a || {m} || b") for k, m in ((0, "chr(10) || chr(10) || '[table: 1]' || chr(10) || chr(10)"), (1, _quoted(BETWEEN[1])), (2, "chr(10) || chr(10) || '[diagram: 1]' || chr(10) || chr(10)"), (3, "''"))]) + " END) AS body_md5, md5(CASE k WHEN 0 THEN '# Plan' || chr(10) || chr(10) || trim(" + _quoted(TABLE) + ", chr(10)) WHEN 2 THEN " + _quoted(BETWEEN[2]) + " ELSE '' END) AS block_md5 FROM d"


@query("extract_blocks", BLOCK_SQL)
def extract_blocks(spark, sf_dir):
    """A block in the middle of each document, under a heading."""
    between = F.get(F.array(*[F.lit(b.replace("~", "\n")) for b in BETWEEN.values()]), (F.col("doc_id") % 4).cast("int"))
    text = F.concat(F.lit("# Plan\n\n"), "text", F.lit("\n\n"), between, F.lit("\nafter "), "text")
    rows = table(spark, sf_dir, DOCS).select("doc_id", chunking.extract_blocks(text).alias("x"))
    md5 = lambda c: F.md5(c.cast("binary"))
    return rows.select("doc_id", F.size("x.blocks").alias("n_blocks"), F.array_join("x.blocks.marker", ",").alias("markers"), md5(F.col("x.body")).alias("body_md5"), md5(F.array_join("x.blocks.page_content", "")).alias("block_md5"))


@query("table_row_count", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, ' | ')))::INTEGER AS n_rows FROM documents WHERE contains(text, ' | ')")
def table_row_count(spark, sf_dir):
    rows = F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit(" | ")))
    return table(spark, sf_dir, DOCS).where(F.contains("text", F.lit(" | "))).select("doc_id", F.size(rows).alias("n_rows"))
