"""Near-duplicate documents by SimHash and meet-in-the-middle ball hashing.

Method. A document's fingerprint has a bit set where over half of its shingle hashes have it. Two fingerprints link at
`RADIUS` = 3 or fewer differing bits. Instead of comparing pairs, every distinct fingerprint emits all variants within
half the radius and meets the others on equal variants. Half of 3 is one and a half: a variant is one flipped bit, or
none, and the other half is an erased block (as an erasure counts half an error): the 64 bits make four blocks of 16,
and with each block erased in turn there are 1 + 48 variants, 196 in all. Three differing bits have at least one in
some block; with it erased at most two are left, and a variant halfway between is emitted by both sides. So no link is
lost. Variants are shuffled and sorted, colliding fingerprints are compared bit by bit, and a spanning forest of each
bucket's links goes on; all pairs of a bucket are never emitted. A bucket holds 49 * 2^16 distinct fingerprints at most,
whatever the input, and equal fingerprints are one before it, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, free_name, utf8, written
from .components import components

RADIUS = 3
BLOCK_BITS = 16
SHINGLE = 3
SEED = 42
#: Runs of up to so many fingerprints are compared by offsets, all runs at once; longer ones by a search of their own.
SHORT_RUN = 32
#: Linked fingerprints that one task holds before it hands its forest on.
FOREST = 1_000_000


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The fingerprint of UTF-8 text as an unsigned integer; 0 if it has no word."""
    import xxhash

    words = text.lower().split()  # bytes.lower() changes A-Z alone
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        shingles = [b" ".join(words)]
    elif width == 3:
        shingles = [b"%b %b %b" % s for s in zip(words, words[1:], words[2:], strict=False)]
    else:
        shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8)
        set_bits += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, 256):
            found = np.array([fingerprint(t, width) for t in utf8(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _variants() -> list[tuple[int, int]]:
    """(bits kept, bits flipped or marked) of each variant; the erased block carries the block's number."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for block in range(64 // BLOCK_BITS):
        erased = ((1 << BLOCK_BITS) - 1) << block * BLOCK_BITS
        mark = (block + 1) << block * BLOCK_BITS
        for flip in [0, *(1 << i for i in range(64) if not erased >> i & 1)]:
            out.append((signed(~erased & (1 << 64) - 1), signed(flip | mark)))
    return out


def differing_bits(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    """Of signed longs; counted unsigned, since numpy counts the bits of a signed number's absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest_of_run(run: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: each search step compares one with all not yet reached."""
    left = np.unique(run)
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            near = differing_bits(left, x) <= radius
            if near.any():
                for y in left[near].tolist():
                    yield int(x), y
                reached.extend(left[near])
                left = left[~near]


def links_of_runs(keys: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links (with those of long runs thinned to a forest) among fingerprints of equal key; keys are sorted."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    lengths = np.diff(np.append(starts, len(keys)))
    size = np.repeat(lengths, lengths)
    short = np.flatnonzero((size > 1) & (size <= SHORT_RUN))
    k, f, n = keys[short], fps[short], size[short]
    for offset in range(1, SHORT_RUN):
        wide = np.flatnonzero(n[: len(n) - offset] > offset) if len(n) > offset else np.empty(0, np.int64)
        if not len(wide):
            break
        a, b = f[wide], f[wide + offset]
        ok = (k[wide] == k[wide + offset]) & (a != b) & (differing_bits(a, b) <= radius)
        if ok.any():
            yield from map(tuple, np.unique(np.stack([a[ok], b[ok]], 1), axis=0).tolist())
    for s, n_run in zip(starts[lengths > SHORT_RUN].tolist(), lengths[lengths > SHORT_RUN].tolist(), strict=True):
        yield from forest_of_run(fps[s : s + n_run], radius)


class _Forest:
    """Union-find of the links that a task has met; it hands on one edge a node."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def add(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def batch(self) -> pa.RecordBatch:
        pairs = [(x, r) for x in list(self.parent) if (r := self.root(x)) != x]
        self.parent = {}
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def link_edges(distinct_fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) whose components are those of all links of `radius` or fewer bits among the distinct fingerprints `fp`."""
    if radius > RADIUS:
        raise ValueError(f"variants reach {RADIUS} differing bits")
    variants = F.array(*[F.struct(F.lit(k).alias("kept"), F.lit(f).alias("flip")) for k, f in _variants()])
    emitted = distinct_fps.select("fp", F.inline(variants)).select(F.col("fp").bitwiseAND(F.col("kept")).bitwiseXOR(F.col("flip")).alias("key"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, keys, fps = _Forest(), np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy()])
            if len(keys) < 1 << 18:
                continue
            # All but the last run are complete.
            cut = int(np.searchsorted(keys, keys[-1]))
            for a, b in links_of_runs(keys[:cut], fps[:cut], radius) if cut else ():
                forest.add(a, b)
            keys, fps = keys[cut:], fps[cut:]
            if len(forest.parent) > FOREST:
                yield forest.batch()
        if len(keys):
            for a, b in links_of_runs(keys, fps, radius):
                forest.add(a, b)
        yield forest.batch()

    return emitted.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def group_table(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint of fps (doc_id, fp). component_id: smallest non-null doc_id that it reaches, null if there is none."""
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-distinct")
    roots = components(link_edges(distinct.select("fp"), radius), "simhash-components").withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return rooted.join(first, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row; repeated rows are repeated, an empty table gives none."""
    fps = written(fingerprints(docs), "simhash-fingerprints")
    out = fps.join(group_table(fps, radius), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """docs with one row of each near-duplicate group, all columns kept whatever their names.

    Kept is the row of the smallest doc_id, of null ones only where a group has no other; of several such rows that of the
    smallest text hash. Groups are told apart by their texts, so equal doc_ids of different groups all stay.
    """
    names = ["doc_id", "text_hash", "fp"]
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, 256):
            found = np.array([fingerprint(t, width) for t in utf8(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found.view(np.int64))], names=names)

    fps = written(slim.mapInArrow(run, "doc_id long, text_hash long, fp long"), "simhash-fingerprints")
    roots = components(link_edges(fps.select("fp").distinct(), radius), "simhash-components").withColumnRenamed("node", "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("first")
    rows = fps.groupBy("fp").agg(first).join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    kept = written(rows.select(F.col("first.doc_id").alias("_doc"), F.col("first.text_hash").alias("_hash")), "simhash-kept")
    name = free_name([*docs.columns, "_doc", "_hash"], "text_hash")
    hashed = docs.withColumn(name, F.xxhash64(F.col("text").cast("string")))
    same = hashed["doc_id"].cast("long").eqNullSafe(kept["_doc"]) & (hashed[name] == kept["_hash"])
    return hashed.join(kept, same, "left_semi").dropDuplicates(["doc_id", name]).drop(name)
