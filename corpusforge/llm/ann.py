"""Approximate nearest neighbours by an inverted file with product-quantised residuals (IVF-PQ).

Method. Coarse centroids cut the space into about sqrt(n) lists; a vector is stored in the list of its nearest centroid with
the product code of its residual. A query looks into its nearest lists. Its distances to their members come from the codes
alone: the query isn't quantised (asymmetric), its table of inner products with all code words serves every list, and a
member brings one number for what doesn't depend on the query. The best max(RERANK, k) of all lists are ranked again by the
exact distance on the original vectors, in double precision; ties go to the smaller vec_id.

Centroids and code books are fitted on the driver on a bounded sample (PER_LIST rows a list, `SAMPLE` in all and
`SAMPLE_BYTES` as doubles, by the hash of vec_id); every row is indexed. Long vectors so get fewer lists, and neither the
driver nor a task ever holds distances of more than `AT_ONCE` pairs of a row and a center. How far a query looks is calibrated on the sample: the least share of rows, in the nearest
lists, that holds `TARGET` of the sample's own true neighbours. It is little where vectors cluster, and over half where they
don't (vectors spread evenly in many dimensions have no near lists); the same rule holds at every size.

Of equal vectors only the k + 1 smallest ids can be in any answer, so these alone are listed (they are counted off before the
shuffle); copies can neither crowd out others nor make a list hot. Queries are dealt to blocks by nearest list, a list with
many queries to several blocks; a block streams through the codes of its lists (ids, codes and a number, never vectors) and keeps its
best. So a list with a third of all rows, or a third of all queries, is many tasks' work. Queries are the stated rows (a
hundredth), so list by list this is no all-pairs join.

Vectors that are null, zero, or hold null or non-finite components, and rows with a null vec_id, take no part. Vectors of
different lengths have no distance: each length is searched among its own. A repeated vec_id counts as one query (its least vector);
candidates exclude rows of the query's own vec_id. Fewer candidates than asked for give them all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, written

#: Rows that the index is fitted on at most, and for each list; code words in a part (one byte) and components in a part.
SAMPLE, PER_LIST, CODES, PART = 65_536, 16, 256, 4
#: Bytes of the sample as doubles at most; distances, or components of rows that are placed, held at a time.
SAMPLE_BYTES, AT_ONCE = 64 << 20, 1 << 22
#: Calibration: part of the true neighbours in the sample that the lists looked into must hold; queries of the sample.
TARGET, TRIALS = 0.96, 256
#: Candidates ranked again exactly (k if that is more), queries in a block, least number of blocks, members compared at a time.
RERANK, QUERY_BLOCK, LEAST_BLOCKS, CHUNK = 256, 2_048, 32, 8_192


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # lists x components
    books: np.ndarray  # parts x CODES x PART

    @property
    def width(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centroids)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        residual = _padded(x - self.centroids[lists], self.width)
        parts = residual.reshape(len(x), -1, self.books.shape[2])
        return np.stack([np.argmin(_squares(parts[:, m], book), axis=1) for m, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def residuals(self, codes: np.ndarray) -> np.ndarray:
        """The residuals that codes stand for."""
        return np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)[:, : self.centroids.shape[1]]

    def own_parts(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """What a member's distance has beside the query's: |r|^2 + 2 c.r."""
        r = self.residuals(codes)
        return (r * r).sum(axis=1) + 2 * (r * self.centroids[lists]).sum(axis=1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner product of each query's parts with each code word: parts x queries x CODES."""
        parts = _padded(queries, self.width).reshape(len(queries), -1, self.books.shape[2])
        return np.stack([parts[:, m] @ book.T for m, book in enumerate(self.books)]).astype(np.float32)


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Number of the nearest center of each row, AT_ONCE distances at a time."""
    step = max(1, AT_ONCE // len(centers))
    return np.concatenate([np.argmin(_squares(x[i : i + step], centers), axis=1) for i in range(0, max(1, len(x)), step)])


def _k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    random = np.random.default_rng(seed)
    centers = x[random.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        nearest = _nearest(x, centers)
        counts = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, x)
        full = counts > 0
        centers[full] = sums[full] / counts[full, None]
        if (~full).any():  # an empty center starts anew at a random row
            centers[~full] = x[random.choice(len(x), int((~full).sum()))]
    return centers


def fit(sample: np.ndarray, lists: int, seed: int = 7) -> Index:
    centroids = _k_means(sample, max(1, min(lists, len(sample))), 12, seed)
    width = -(-sample.shape[1] // PART) * PART
    residual = _padded(sample - centroids[_nearest(sample, centroids)], width).reshape(len(sample), -1, PART)
    return Index(centroids, np.stack([_k_means(residual[:, m], CODES, 6, seed + m) for m in range(residual.shape[1])]))


def calibrated_share(index: Index, sample: np.ndarray, k: int = 10) -> float:
    """Share of rows to look through, nearest lists first, to meet TARGET of the true neighbours within the sample."""
    lists = index.lists_of(sample)
    held = np.bincount(lists, minlength=len(index.centroids))
    trial = np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(int)
    near = _squares(sample[trial], sample)
    near[np.arange(len(trial)), trial] = np.inf
    true = np.argsort(near, axis=1, kind="stable")[:, : max(1, min(k, len(sample) - 1))]
    order = np.argsort(_squares(sample[trial], index.centroids), axis=1, kind="stable")
    before = np.empty(order.shape)
    np.put_along_axis(before, order, np.cumsum(held[order], axis=1) - held[order], axis=1)
    needed = np.take_along_axis(before, lists[true], axis=1) / len(sample)
    return float(np.quantile(needed, TARGET)) + 1e-9


class _Best:
    """The nearest candidates that a block's queries have met so far."""

    def __init__(self, index: Index, ids: np.ndarray, queries: np.ndarray, wanted: np.ndarray, most: int):
        self.ids, self.wanted, self.most, self.tables = ids, wanted, most, index.tables(queries)
        self.to_lists = _squares(queries, index.centroids).astype(np.float32)
        self.found = [(np.empty(0, np.float32), np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
        self.worst = np.full(len(ids), np.inf, np.float32)

    def add(self, lists: np.ndarray, ids: np.ndarray, rows: np.ndarray, codes: np.ndarray, own: np.ndarray) -> None:
        near = self.to_lists[:, lists] + own.astype(np.float32)
        for m, table in enumerate(self.tables):
            near -= 2 * table[:, codes[:, m]]
        near[~self.wanted[:, lists]] = np.inf
        for j in range(len(self.ids)):
            met = np.flatnonzero((near[j] <= self.worst[j]) & (near[j] < np.inf) & (ids != self.ids[j]))
            if not len(met):
                continue
            d, i, r = (np.concatenate([old, new]) for old, new in zip(self.found[j], (near[j][met], ids[met], rows[met]), strict=True))
            if len(d) > self.most:
                keep = np.lexsort((i, d))[: self.most]
                d, i, r = d[keep], i[keep], r[keep]
                self.worst[j] = d[-1]
            self.found[j] = d, i, r


def neighbours(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row. vectors: vec_id, embedding; is_query: on vec_id."""
    v = F.col("v")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for width, n in rows.groupBy(F.size("v").alias("width")).count().orderBy("width").collect():  # mostly one
        out = out.unionByName(_of_width(rows.where(F.size("v") == width), is_query, k, width, n))
    return out


def _of_width(rows: DataFrame, is_query: Column, k: int, width: int, n: int) -> DataFrame:
    spark = rows.sparkSession
    fitted = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    lists = max(1, min(int(round(n**0.5)), fitted // PER_LIST))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(min(fitted, max(PER_LIST * lists, PER_LIST * CODES))).select("v").toArrow()["v"].combine_chunks()
    sample = picked.flatten().to_numpy().reshape(-1, width)
    index, most = fit(sample, lists), max(RERANK, k)
    share = calibrated_share(index, sample, k)
    shared = spark.sparkContext.broadcast(index)  # SAMPLE / PER_LIST centroids at most, and code books of fixed size

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in arrow_rows(batches, max(1, AT_ONCE // width)):
            x = matrix(batch.column("v"))
            where = ix.lists_of(x)
            codes = ix.codes(x, where)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(where, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(ix.own_parts(codes, where))], names=["vec_id", "v", "list", "code", "own"])

    first = F.row_number().over(Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id"))
    members = rows.withColumn("copy", first).where(F.col("copy") <= k + 1).select("vec_id", "v")
    placed = members.mapInArrow(place, "vec_id long, v array<double>, list int, code binary, own double")
    placed = written(placed.withColumn("row", F.monotonically_increasing_id()), "ann-index")
    held = np.zeros(len(index.centroids), np.int64)
    for r in placed.groupBy("list").count().collect():  # a row a list
        held[r["list"]] = r["count"]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(shared.value.lists_of(matrix(batch.column("v"))), pa.int32())], names=["vec_id", "v", "nearest"])

    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = written(asked.mapInArrow(nearest, "vec_id long, v array<double>, nearest int"), "ann-queries")
    # Lists in the order of their main direction; equal numbers of queries to a block.
    asking = np.zeros(len(index.centroids), np.int64)
    for r in asked.groupBy("nearest").count().collect():  # a row a list
        asking[r["nearest"]] = r["count"]
    total = int(asking.sum())
    blocks = max(LEAST_BLOCKS, -(-total // QUERY_BLOCK))
    centered = index.centroids - index.centroids.mean(axis=0)
    line = np.argsort(centered @ np.linalg.svd(centered, full_matrices=False)[2][0], kind="stable")
    after = np.cumsum(asking[line])
    begin, end = (after - asking[line]) * blocks // max(1, total), np.maximum(after - 1, 0) * blocks // max(1, total)
    block_of = spark.createDataFrame([(int(i), int(a), max(1, int(b - a + 1))) for i, a, b in zip(line, begin, end, strict=True)], "nearest int, first int, n_blocks int")
    block = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("n_blocks")).cast("int")
    asked = asked.join(F.broadcast(block_of), "nearest").select(block.alias("block"), "vec_id", "v")  # a row a list

    least = max(int(share * held.sum()), k + 1)
    limits = spark.sparkContext.broadcast((held, least))  # a number a list

    def wanted_of(ix: Index, queries: np.ndarray) -> np.ndarray:
        """Whether each query looks into each list: nearest first, until they hold enough rows."""
        held, least = limits.value
        order = np.argsort(_squares(queries, ix.centroids), axis=1, kind="stable")
        before = np.cumsum(held[order], axis=1) - held[order]
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, (before < least) & (held[order] > 0), axis=1)
        return out

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, QUERY_BLOCK):
            row, column = np.nonzero(wanted_of(shared.value, matrix(batch.column("v"))))
            pairs = np.unique(batch.column("block").to_numpy()[row].astype(np.int64) << 32 | column)
            yield pa.RecordBatch.from_arrays([pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32))], names=["block", "list"])

    pairs = asked.mapInArrow(needed, "block int, list int").distinct()
    stream = placed.join(pairs, "list").select("block", F.lit(1).alias("kind"), "vec_id", F.lit(None).cast("array<double>").alias("v"), "list", "code", "own", "row")
    stream = asked.select("block", F.lit(0).alias("kind"), "vec_id", "v", *[F.lit(None).cast(t).alias(c) for c, t in (("list", "int"), ("code", "binary"), ("own", "double"), ("row", "long"))]).unionByName(stream)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block, its queries first."""
        ix, now, best, ids, queries = shared.value, None, None, [], []

        def out() -> pa.RecordBatch:
            found = best.found if best else []
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(best.ids if best else np.empty(0, np.int64), [len(f[0]) for f in found]), pa.int64()), pa.array(np.concatenate([f[2] for f in found]) if found else np.empty(0, np.int64), pa.int64())], names=["query_id", "row"])

        for batch in arrow_rows(batches, CHUNK):
            of, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            turns = np.flatnonzero((of[1:] != of[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(of)], strict=True):
                part = batch.slice(a, b - a)
                if of[a] != now:
                    yield out()
                    now, best, ids, queries = of[a], None, [], []
                if kind[a] == 0:
                    ids.append(part.column("vec_id").to_numpy())
                    queries.append(matrix(part.column("v")))
                    continue
                if best is None:
                    asked_now = np.concatenate(queries)
                    best = _Best(ix, np.concatenate(ids), asked_now, wanted_of(ix, asked_now), most)
                codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                best.add(*[part.column(c).to_numpy() for c in ("list", "vec_id", "row")], codes, part.column("own").to_numpy())
        yield out()

    found = stream.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(search, "query_id long, row long")
    ranked = found.join(placed.select("row", "vec_id", "v"), "row").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    score = F.sqrt(F.aggregate(F.zip_with("v", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    ranked = ranked.select("query_id", "vec_id", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
