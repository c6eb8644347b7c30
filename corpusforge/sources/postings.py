"""A stored inverted index: postings written once, appended by segments, searched without reading the texts.

Chunks are dealt into spans of at most `SPAN`, and of `TOKENS` terms, in the order in which a task reads them. A row of the postings is a term
in a span: the keys, frequencies and lengths of the chunks that hold it, and its peaks, the few pairs of frequency and length that no other
pair beats in both. So no row is unbounded, however common its term, and rows are made where the texts are read: a term of a span is shuffled
once, to its bucket. Rows lie in a folder for each bucket of terms, sorted by term and span.

Search is exact and skips spans. From its peaks a term's highest weight in a span is known for any mean length, hence also
after appending; the sum over a question's terms bounds every chunk of the span. Of each question the spans of highest bound are scored, k of them or `FIRST`, as each may hold one of the k best alone; its k-th
score is a floor, and of the others only spans whose bound reaches it are read. The bounds alone are read for all spans of a
question's terms: a few numbers where a span's postings are thousands. Where the first spans of all questions together are half of all spans
or more, nothing would be saved, and all spans are scored at once. A span's postings meet in one task, for all questions: pairs of a
chunk and a question are never rows.

Appending writes one more segment and the merged document frequencies, and publishes both in one commit of the catalogue.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.udfs import give_back
from ..operators.lexical import CELLS, Analyser, best_rows, in_key_order, query_terms, question_blocks, top_k
from .catalog import Catalog, Snapshot
from .shared import written

SPAN, FIRST = 4096, 2
#: A span ends early with so many terms, repeats included.
TOKENS = 1 << 21
#: A bucket's rows of so many spans are written by one task.
SPANS_A_TASK = 1024
#: The first segment settles how many buckets of terms there are: one for so many chunks, MOST_BUCKETS at most.
PER_BUCKET, MOST_BUCKETS = 4096, 4096
#: Stated, as a segment of nothing has no file to read them from.
POSTINGS = "term string, span long, keys array<{key}>, tfs array<int>, dls array<int>, n int, tokens long, peaks array<struct<tf:int,dl:int>>, bucket int"
TERMS = "term string, df long, bucket int"
#: Spans of a segment are numbered from its number times this, those of a task from its partition's number times that.
SEGMENT, PARTITION = 1 << 48, 1 << 24
#: Scores are rounded to six places; a bound may be this much short of one.
SLACK = 1e-5


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Index:
    """One snapshot of an index. name: its artefacts are `name`.postings and `name`.terms."""

    catalog: Catalog
    snapshot: Snapshot
    name: str

    @property
    def manifest(self) -> dict:
        return self.snapshot.manifest(f"{self.name}.postings")

    def postings(self, buckets: list[int]) -> DataFrame:
        """bucket, term, span, keys, tfs, dls, n, peaks of the buckets; other folders aren't read."""
        schema = POSTINGS.format(key=self.manifest["key_type"])
        parts = [self.catalog.spark.read.schema(schema).parquet(f) for f in self.snapshot.folders(f"{self.name}.postings")]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.where(F.col("bucket").isin(buckets))

    def terms(self, buckets: list[int]) -> DataFrame:
        """bucket, term, df."""
        return self.catalog.spark.read.schema(TERMS).parquet(*self.snapshot.folders(f"{self.name}.terms")).where(F.col("bucket").isin(buckets))


def opened(spark: SparkSession, folder: str, name: str = "words", version: int | None = None) -> Index:
    catalog = Catalog(spark, folder)
    return Index(catalog, catalog.snapshot(version), name)


def idf(n: Column | int, df: Column) -> Column:
    return F.log(F.lit(n) - df + 0.5) - F.log(df + 0.5)


def peaks(group: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
    """Places of the pairs (tf, dl) that no other of their group beats in both: whatever the mean length, the highest weight is one of theirs. In order of groups, and by falling tf."""
    order = np.lexsort((dl, -tf, group))
    # A later group lies below every earlier one, so the least value so far is that of the own group.
    low = dl[order] - group[order] * (int(dl.max(initial=0)) + 1)
    before = np.concatenate([low[:1] + 1, np.minimum.accumulate(low)[:-1]])
    return order[low < before]


def span_rows(keys: pa.Array, terms: pa.Array, span: int) -> pa.RecordBatch:
    """The postings of one span: term, span, keys, tfs, dls, n, tokens, peaks."""
    order = pa.array(in_key_order(keys))
    keys, terms = keys.take(order), terms.take(order)
    dl = pc.fill_null(pc.list_value_length(terms), 0).to_numpy().astype(np.int64)
    flat, chunk = terms.flatten(), np.repeat(np.arange(len(keys)), dl)
    if flat.null_count:
        chunk, flat = chunk[np.asarray(flat.is_valid())], flat.drop_null()
    encoded = flat.dictionary_encode()
    pair, tf = np.unique(encoded.indices.to_numpy().astype(np.int64) * max(1, len(keys)) + chunk, return_counts=True)
    term, chunk = np.divmod(pair, max(1, len(keys)))
    size = len(encoded.dictionary)
    at = lambda group: pa.array(np.searchsorted(group, np.arange(size + 1)).astype(np.int32))  # noqa: E731  where each term's part begins
    small = lambda x: pa.array(x.astype(np.int32))
    top = peaks(term, tf, dl[chunk])
    pairs = pa.StructArray.from_arrays([small(tf[top]), small(dl[chunk[top]])], names=["tf", "dl"])
    lists = [pa.ListArray.from_arrays(at(term), x) for x in (keys.take(pa.array(chunk)), small(tf), small(dl[chunk]))]
    n, total = np.bincount(term, minlength=size), np.bincount(term, tf, minlength=size).astype(np.int64)
    return pa.RecordBatch.from_arrays([encoded.dictionary, pa.array(np.full(size, span)), *lists, small(n), pa.array(total), pa.ListArray.from_arrays(at(term[top]), pairs)], names=["term", "span", "keys", "tfs", "dls", "n", "tokens", "peaks"])


def _spans(sized: DataFrame, key_type: str, number: int) -> DataFrame:
    """sized (key, t) to the postings of its spans, made by each task of the rows that it reads."""
    most, longest = SPAN, TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done, waiting, rows, held = TaskContext.get().partitionId() * PARTITION + number * SEGMENT, 0, [], 0, 0

        def closed() -> Iterator[pa.RecordBatch]:
            keys, terms = (pa.concat_arrays([w.column(i) for w in waiting]) for i in (0, 1))
            whole = span_rows(keys, terms, first + done)
            for at in range(0, whole.num_rows, 10_000):
                yield whole.slice(at, 10_000)

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                gone = int(ends[at - 1]) if at else 0
                fit = int(np.searchsorted(ends, gone + longest - held, side="right")) - at
                take = min(most - rows, fit, batch.num_rows - at)
                if take <= 0 and not rows:
                    take = 1
                if take > 0:
                    waiting.append(batch.slice(at, take))
                    at, rows = at + take, rows + take
                    held += int(ends[at - 1]) - gone
                if take <= 0 or rows >= most:
                    yield from closed()
                    done, waiting, rows, held = done + 1, [], 0, 0
                    give_back()
        if rows:
            yield from closed()
        give_back()

    return sized.select("key", "t").mapInArrow(run, POSTINGS.format(key=key_type).rsplit(",", 1)[0])


def append(spark: SparkSession, folder: str, chunks: DataFrame, key: str, text: str = "text", analyse: Analyser = tokens, name: str = "words") -> Index:
    """Add chunks as a segment and publish it; the first segment builds the index. Chunks without a text count, but have no length.

    A key must not be there yet: an index doesn't look for it. An empty table publishes a segment of nothing. Chunks must come in the same
    order each time they are read, as a table's rows do.
    """
    catalog = Catalog(spark, folder)
    base = catalog.snapshot()
    old = base.artefacts.get(f"{name}.postings", {"folders": [], "manifest": {"segments": 0, "n": 0, "n_texts": 0, "tokens": 0, "buckets": 0}})
    number = old["manifest"]["segments"]
    sized = chunks.select(F.col(key).alias("key"), analyse(F.col(text)).alias("t"))
    total = chunks.agg(F.count(F.lit(1)), F.count(text)).first()
    buckets = old["manifest"]["buckets"] if old["manifest"]["n"] else min(MOST_BUCKETS, 1 + total[0] // PER_BUCKET)
    key_type = chunks.schema[key].dataType.simpleString()
    rows = _spans(sized, key_type, number).withColumn("bucket", bucket(F.col("term"), buckets))
    at, terms_at = catalog.aside(f"{name}.postings"), catalog.aside(f"{name}.terms")
    # A bucket of many spans is dealt over tasks; each file is sorted.
    part = F.pmod(F.xxhash64("span"), F.lit(1 + total[0] // (SPAN * SPANS_A_TASK)))
    rows.repartition("bucket", part).sortWithinPartitions("bucket", "term", "span").write.partitionBy("bucket").parquet(at)
    new = spark.read.schema(rows.schema).parquet(at)
    df = new.groupBy("bucket", "term").agg(F.sum("n").alias("df"))
    if old["folders"]:
        df = df.unionByName(spark.read.schema(TERMS).parquet(*base.folders(f"{name}.terms"))).groupBy("bucket", "term").agg(F.sum("df").alias("df"))
    df.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(terms_at)
    said = {k: old["manifest"][k] + v for k, v in (("n", total[0]), ("n_texts", total[1]), ("segments", 1))}
    # Every chunk's length is the sum of its frequencies.
    lengths = new.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    mean = spark.read.schema(df.schema).parquet(terms_at).agg(F.avg(idf(said["n"], F.col("df")))).first()[0]
    manifest = {**said, "tokens": old["manifest"]["tokens"] + lengths, "mean_idf": mean, "buckets": buckets, "key": key, "key_type": key_type}
    return Index(catalog, catalog.publish(base, {f"{name}.postings": ([*old["folders"], at], manifest), f"{name}.terms": ([terms_at], {})}), name)


def _weight(tf: Column, dl: Column, avgdl: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


@dataclass(frozen=True)
class _Search:
    """What a search has found out: spans (query_id, span, most), begun (the scores of the first spans), rest (the spans still to be read), whole (all were scored first)."""

    spans: DataFrame
    begun: DataFrame
    rest: DataFrame
    scored: Callable[[DataFrame], DataFrame]
    whole: bool


def _begun(index: Index, queries: DataFrame, k: int, question: str, k1: float, b: float, epsilon: float, analyse: Analyser, first: int) -> _Search:
    said = index.manifest
    terms = written(query_terms(queries, question, analyse).withColumn("bucket", bucket(F.col("term"), said["buckets"])), "asked-terms")
    buckets = [r[0] for r in terms.select("bucket").distinct().collect()]  # MOST_BUCKETS at most
    avgdl = said["tokens"] / said["n_texts"] if said["n_texts"] and said["tokens"] else 1.0
    raw = idf(said["n"], F.col("df"))
    floor = F.lit(said["mean_idf"]).cast("double") * epsilon
    asked = written(terms.join(index.terms(buckets), ["bucket", "term"]).select("query_id", "bucket", "term", "qtf", F.when(raw < 0, floor).otherwise(raw).alias("idf")), "asked")
    bounds = index.postings(buckets).select("bucket", "term", "span", "peaks").join(asked, ["bucket", "term"])
    # A negative weight can only lower a score, so it doesn't lower the bound.
    highest = F.array_max(F.transform("peaks", lambda x: _weight(x["tf"], x["dl"], avgdl, k1, b)))
    most = F.greatest(F.lit(0.0), F.col("idf") * F.col("qtf") * highest)
    spans = written(bounds.groupBy("query_id", "span").agg(F.sum(most).alias("most")), "spans")

    said_of, key, ids = asked.select("query_id", "term", (F.col("idf") * F.col("qtf") * (k1 + 1)).alias("w")).toArrow(), said["key"], queries.schema["query_id"].dataType.simpleString()
    shared = index.catalog.spark.sparkContext.broadcast(question_blocks(said_of))

    def of_span(group: pa.Table) -> pa.Table:
        """query_id, span, key, score: the k best of a span's chunks for each question that has a term there."""
        terms, blocks = shared.value
        rows = group.combine_chunks()
        keys, tf, dl = (rows[c].combine_chunks() for c in ("keys", "tfs", "dls"))
        counts = pc.list_value_length(keys).to_numpy()
        names, chunk = key_codes(keys.flatten())
        term = np.repeat(pc.index_in(rows["term"].combine_chunks(), value_set=terms).to_numpy(), counts)
        tf, dl = (x.flatten().to_numpy().astype(np.float64) for x in (tf, dl))
        part = tf / (tf + k1 * (1 - b + b * dl / avgdl))
        order = np.argsort(chunk, kind="stable")
        chunk, term, part = chunk[order], term[order], part[order]
        out = []
        step = max(1, CELLS // max((len(own) + len(q) for q, own, *_ in blocks), default=1))
        for first in range(0, len(names), step):
            here = slice(*np.searchsorted(chunk, (first, first + step)))
            for q, own, place, column, w in blocks:
                inside = np.minimum(np.searchsorted(own, term[here]), len(own) - 1)
                mine = own[inside] == term[here]
                a = np.zeros((len(own), len(q)))
                a[place, column] = w
                x = np.zeros((len(own), min(step, len(names) - first)))
                x[inside[mine], chunk[here][mine] - first] = part[here][mine]
                row, at, score = best_rows(a.T @ x, k)
                out.append(pa.table([q.take(pa.array(row)), pa.array(np.full(len(row), rows["span"][0].as_py())), names.take(pa.array(first + at)), pa.array(score)], names=["query_id", "span", key, "score"]))
        give_back()
        return pa.concat_tables(out)

    def scored(wanted: DataFrame) -> DataFrame:
        """The k best of the chunks in the wanted spans, with their whole scores."""
        some = index.postings(buckets).select("bucket", "term", "span", "keys", "tfs", "dls").join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi").join(wanted.select("span").distinct(), "span", "left_semi")
        each = some.select("term", "span", "keys", "tfs", "dls").groupBy("span").applyInArrow(of_span, f"query_id {ids}, span long, `{key}` {said['key_type']}, score double")
        return top_k(each.join(wanted.select("query_id", "span"), ["query_id", "span"], "left_semi").drop("span"), k, F.col("score").desc(), F.col(key))

    best = written(top_k(spans, max(first, k), F.col("most").desc(), F.col("span")).select("query_id", "span"), "best-spans")
    counts = spans.agg(F.count_distinct("span")).first()[0], best.agg(F.count_distinct("span")).first()[0]
    if 2 * counts[1] >= counts[0]:
        return _Search(spans, written(scored(spans), "begun"), spans.join(spans, ["query_id", "span"], "left_anti"), scored, True)
    begun = written(scored(best), "begun")
    floors = begun.where(F.col("rank") == k).select("query_id", (F.col("score") - SLACK).alias("floor"))
    rest = written(spans.join(best, ["query_id", "span"], "left_anti").join(floors, "query_id", "left").where(F.col("floor").isNull() | (F.col("most") >= F.col("floor"))), "rest")
    return _Search(spans, begun, rest, scored, False)


def key_codes(keys: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct keys (of any type that Spark sorts, structs too) in ascending order, and the place of each key among them."""
    code = np.zeros(len(keys), dtype=np.int64)
    for c in keys.flatten() if pa.types.is_struct(keys.type) else [keys]:
        encoded = c.dictionary_encode()
        code = np.unique(code * (len(encoded.dictionary) + 1) + encoded.indices.fill_null(len(encoded.dictionary)).to_numpy(), return_inverse=True)[1]
    _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    names = keys.take(pa.array(first))
    order = in_key_order(names)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return names.take(pa.array(order)), place[inverse]


def search(index: Index, queries: DataFrame, k: int, question: str = "question", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, analyse: Analyser = tokens, first: int = FIRST) -> DataFrame:
    """query_id, rank, key (under its own name), score: the rows that `bm25_topk` gives on all chunks of the index."""
    if not index.manifest["tokens"]:
        return index.catalog.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, `{index.manifest['key']}` {index.manifest['key_type']}, score double, rank int")
    s = _begun(index, queries, k, question, k1, b, epsilon, analyse, first)
    if s.whole:
        return s.begun
    both = s.begun.drop("rank").unionByName(s.scored(s.rest).drop("rank"))
    return written(top_k(both, k, F.col("score").desc(), F.col(index.manifest["key"])), "found")


def reading(index: Index, queries: DataFrame, k: int, question: str = "question", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, analyse: Analyser = tokens, first: int = FIRST) -> DataFrame:
    """query_id, spans, spans_read: in how many spans a question's terms occur, and of how many the postings are read."""
    s = _begun(index, queries, k, question, k1, b, epsilon, analyse, first)
    counted = s.spans.groupBy("query_id").agg(F.count(F.lit(1)).alias("spans"))
    read = s.rest.groupBy("query_id").agg(F.count(F.lit(1)).alias("more"))
    begun = F.col("spans") if s.whole else F.least("spans", F.lit(max(first, k)))
    return counted.join(read, "query_id", "left").select("query_id", "spans", (begun + F.coalesce("more", F.lit(0))).alias("spans_read"))
