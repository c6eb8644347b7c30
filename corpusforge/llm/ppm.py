"""Language-model scores by prediction by partial matching (PPM) over bytes.

Model. A text is its lower-cased words, each followed by one delimiter, and a bare delimiter as the end. Every byte is
coded after the `ORDER` = 6 bytes before it, across word boundaries (before the text stand delimiters). The byte-context
trie has all contexts of 6 bytes and less. A byte is coded in the longest context that training has seen; a context that
has not seen the byte adds its escape and passes on to the context one byte shorter, where all that it has seen itself
is excluded (symbol exclusion). Below the empty context all byte values left are alike. Counts: occurrences at order 6
and at orders 2, 1 and 0; at 5 to 3 the distinct longer contexts (update exclusion). Escape estimation: with n counts
left of which t are of symbols counted once, (ESCAPE_PRIOR + ESCAPE_SINGLE * t) / (n + ESCAPE_SHIFT), ESCAPE_MOST at
most; at n = 1 ESCAPE_ONCE; 0 where all 256 values were seen. The model is pretrained: training rows set all counts,
and a text's score is its log10 probability.

Distribution. A context with its byte is a 7-byte gram, one unsigned number: latest byte first, coded byte last. Texts
are packed into blocks of about `BLOCK` bytes, and a block sends each distinct gram once, sorted and delta-coded, to a
shard chosen by the last three context bytes. A context of three, four or five bytes that holds more grams than `SPLIT`
shards should (by a bounded sample, which has no say in the scores) is hot: its grams are dealt by one byte more. Contexts
that aren't hot lie whole in one shard; of hot ones the shards exchange the counts of that order first, 256 a context. A shard merges the
counts of all blocks, scores each block's grams and sends the scores (as single precision) back in the block's own order; the block adds them
up along its texts. Words travel the same way for the base score. So what moves is one row for a block and shard, at most a
gram each (never more rows than distinct grams of blocks), a passage that a third of all rows share is a few grams a
block, and no word or document is a key. Broadcast are only the order 2 counts, 2^24 of 12 bytes at most by construction,
and those of hot contexts, `HOT` of an order at most.

Null texts are empty: their only token is the end. A null doc_id counts as training. Repeated rows are rows of their
own, scored alike. Texts longer than a block go in segments cut after a word; their sums are added. An empty table gives
no rows, and without training rows all byte values are alike.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, held_out, utf8, written

#: Bytes of context, 7 at most, as a gram is an unsigned 64-bit number. Orders up to LOW are shared by all shards.
ORDER, LOW = 6, 2
#: Escape estimation, fitted to held-out rows.
ESCAPE_PRIOR, ESCAPE_SINGLE, ESCAPE_SHIFT, ESCAPE_ONCE, ESCAPE_MOST = 0.3, 0.8, 0.5, 0.3, 0.7
#: Bytes of text in a block, and for each shard; bytes whose grams are worked on at a time.
BLOCK, SHARD, CHUNK = 16 << 20, 16 << 20, 2 << 20
DELIMITER = b" "
#: A hot context has more than SPLIT shards' part of all grams, and more than 1 / HOT of them. Bytes of text in the sample that tells.
SPLIT, HOT, SAMPLE = 4, 1 << 12, 2 << 20

_SCHEMA = "kind string, block long, shard int, payload binary, counts binary, sizes binary"
_COLUMNS = (("kind", pa.string()), ("block", pa.int64()), ("shard", pa.int32()), ("payload", pa.binary()), ("counts", pa.binary()), ("sizes", pa.binary()))


def _packed(x: np.ndarray) -> bytes:
    """A number array, its bytes transposed and compressed."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    item = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(item, -1).T).reshape(-1).view(kind)


def _rising(x: np.ndarray) -> bytes:
    """A sorted array of unsigned numbers, as its steps."""
    return _packed(np.diff(x, prepend=np.uint64(0)))


def _risen(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, "<u8"), dtype=np.uint64)


def segments_of(text: bytes, size: int) -> Iterator[tuple[bytes, int, bool]]:
    """(bytes with ORDER bytes of context before them, words, whether the text ends here) of a text, about `size` bytes each."""
    words = text.lower().split()  # bytes.lower() changes A-Z alone
    before, at = DELIMITER * ORDER, 0
    while True:
        begin, length = at, 0
        while at < len(words) and length < size:
            length += len(words[at]) + 1
            at += 1
        own = b"".join([w + DELIMITER for w in words[begin:at]])
        last = at == len(words)
        if last:
            own += DELIMITER
        yield before + own, at - begin, last
        if last:
            return
        before = (before + own)[-ORDER:]


def grams_of(segments: list[bytes]) -> np.ndarray:
    """The gram of every byte of the segments but for the context before each."""
    x = np.frombuffer(b"".join(segments), np.uint8).astype(np.uint64)
    if len(x) <= ORDER:
        return np.zeros(0, np.uint64)
    codes = x[ORDER:].copy()
    for k in range(1, ORDER + 1):
        codes |= x[ORDER - k : len(x) - k] << np.uint64(8 * (ORDER + 1 - k))
    inside = np.ones(len(x), bool)
    starts = np.cumsum([0, *map(len, segments[:-1])])
    for k in range(ORDER):
        inside[starts + k] = False
    return codes[inside[ORDER:]]


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers and how often each occurs."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))
    return x[first], np.diff(np.append(first, len(x))).astype(np.int64)


def _chunks(segments: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Runs of segments of about CHUNK bytes."""
    own, size = [], 0
    for s in segments:
        own.append(s)
        size += len(s)
        if size >= CHUNK:
            yield own
            own, size = [], 0
    if own:
        yield own


def _distinct_grams(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The segments' distinct grams, sorted, and how often each occurs."""
    parts = [_distinct(grams_of(c)) for c in _chunks(segments)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams, times = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(grams)
    grams = grams[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.add.reduceat(times[order], first)


#: Sorted hot contexts of each order between LOW and ORDER. Those of a longer order end in those of a shorter one.
Hot = dict[int, np.ndarray]
#: Of each of these orders the codes of hot contexts, sorted, and their counts.
Spread = dict[int, tuple[np.ndarray, np.ndarray]]


def _context(grams: np.ndarray, order: int) -> np.ndarray:
    """The last `order` bytes before a gram's coded byte."""
    return grams >> np.uint64(8 * (ORDER + 1 - order))


def hot_contexts(docs: DataFrame, size: int, shards: int) -> Hot:
    """The contexts that are dealt by longer ones, judged on rows with about SAMPLE of the `size` bytes of text."""
    if shards <= SPLIT:
        return {}
    text = F.col("text").cast("string")
    picked = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), text), F.lit(max(1, size // SAMPLE))) == 0).select(text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = (s for batch in arrow_rows(batches, 256) for t in utf8(batch.column("text")) for s, _, _ in segments_of(t, CHUNK))
        for own in _chunks(cut):
            grams, _ = _distinct(grams_of(own))
            for k in range(LOW + 1, ORDER):
                context, n = _distinct(_context(grams, k))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k, np.int32)), pa.array(context.astype(np.int64)), pa.array(n)], names=["k", "context", "n"])

    held = written(picked.mapInArrow(run, "k int, context long, n long").groupBy("k", "context").agg(F.sum("n").alias("n")), "ppm-contexts")
    total = held.where(F.col("k") == LOW + 1).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = held.where(F.col("n") > total * max(SPLIT / shards, 1 / HOT)).toArrow()  # fewer than HOT of an order
    k, context = rows["k"].to_numpy(), rows["context"].to_numpy()
    return {o: np.sort(context[k == o]).astype(np.uint64) for o in range(LOW + 1, ORDER)} if len(k) else {}


def shard_of_grams(grams: np.ndarray, shards: int, hot: Hot) -> np.ndarray:
    """By the last three context bytes, or by the fewest that are no hot context, spread by a multiplicative hash."""
    key = _context(grams, LOW + 1)
    spread = np.arange(len(grams)) if hot else np.zeros(0, np.int64)
    for k in range(LOW + 1, ORDER):
        spread = spread[_find(hot[k], key[spread])[1]] if len(spread) else spread
        key[spread] = _context(grams[spread], k + 1)
    return ((key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int64)


def _by_shard(grams: np.ndarray, shards: int, hot: Hot) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the grams by shard (sorted inside), the shards met, and where each begins (with the end)."""
    shard = shard_of_grams(grams, shards, hot)
    order = np.argsort(shard, kind="stable")
    met, first = np.unique(shard[order], return_index=True)
    return order, met, np.append(first, len(grams))


def _word_counts(segments: list[bytes], train: list[bool]) -> dict[bytes, int]:
    """Occurrences of the segments' distinct words in training segments, in an order that the segments fix; with the end (the empty word) as 0."""
    counted: Counter = Counter()
    for s, t in zip(segments, train, strict=True):
        if t:
            counted.update(s[ORDER:].split())
    out = dict(counted)
    for s, t in zip(segments, train, strict=True):
        if not t:
            for w in s[ORDER:].split():
                if w not in out:
                    out[w] = 0
    out[b""] = 0
    return out


def _by_word_shard(words: dict[bytes, int], shards: int) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for w in words:
        out.setdefault(zlib.crc32(w) % shards, []).append(w)
    return out


def blocks(docs: DataFrame, shards: int, hot: Hot, modulus: int = 7, size: int = BLOCK) -> DataFrame:
    """The rows that blocks of docs send: their texts, grams and words by shard, and counts of order LOW."""

    def rows_of(block: int, segments: list[bytes], about: list[tuple]) -> pa.RecordBatch:
        out: list[tuple] = []
        train = [s for s, a in zip(segments, about, strict=True) if not a[2]]
        lengths = np.array([len(s) for s in segments], "<i8")
        known = np.array([a[1] is not None for a in about], "<i8")
        sizes = np.concatenate([[a[0] for a in about], [a[1] or 0 for a in about], known, [a[2] for a in about], lengths, [a[3] for a in about], [a[4] for a in about]]).astype("<i8")
        text = b"".join(segments)
        out.append(("text", block, None, pa.Codec("zstd", compression_level=6).compress(text, asbytes=True), None, sizes.tobytes()))
        seen, times = _distinct_grams(train)
        other, _ = _distinct_grams([s for s, a in zip(segments, about, strict=True) if a[2]])
        grams, _ = _distinct(np.concatenate([seen, other]))
        counts = np.zeros(len(grams), np.uint64)
        counts[np.searchsorted(grams, seen)] = times
        order, met, begin = _by_shard(grams, shards, hot)
        for shard, a, b in zip(met.tolist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            own = order[a:b]
            out.append(("gram", block, shard, _rising(grams[own]), _packed(counts[own]), None))
        if len(seen):
            low, back = np.unique(_shorter(seen, LOW), return_inverse=True)
            out.append(("low", block, None, _rising(low), _packed(np.bincount(back, times).astype(np.uint64)), None))
        counted = _word_counts(segments, [not a[2] for a in about])
        counted[b""] = sum(a[4] for a in about if not a[2])
        for shard, words in _by_word_shard(counted, shards).items():
            out.append(("word", block, shard, pa.compress(b"\n".join(words), codec="zstd", asbytes=True), _packed(np.array([counted[w] for w in words], np.uint64)), np.array([sum(map(len, words)) + len(words) - 1, len(words)], "<i8").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, (_, k) in enumerate(_COLUMNS)], names=[c for c, _ in _COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        block = row = first
        segments: list[bytes] = []
        about: list[tuple] = []
        held_bytes = 0
        for batch in arrow_rows(batches, 256):
            for doc_id, held, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), utf8(batch.column("text")), strict=True):
                for segment, n_words, last in segments_of(text, size):
                    segments.append(segment)
                    about.append((row, doc_id, int(held), n_words, int(last)))
                    held_bytes += len(segment)
                    if held_bytes >= size:
                        yield rows_of(block, segments, about)
                        block, segments, about, held_bytes = block + 1, [], [], 0
                row += 1
        if segments:
            yield rows_of(block, segments, about)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), modulus).alias("held_out"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, _SCHEMA)


def _shorter(grams: np.ndarray, order: int) -> np.ndarray:
    """Context and coded byte of a gram with the context cut to its last `order` bytes."""
    return ((grams >> np.uint64(8 * (ORDER + 1 - order))) << np.uint64(8)) | (grams & np.uint64(255)) if order else grams & np.uint64(255)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _met_once(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the context one byte shorter, sorted, and how many of the distinct `codes` end in each."""
    return _distinct(((codes >> np.uint64(16)) << np.uint64(8)) | (codes & np.uint64(255)))


@dataclass
class Level:
    """All contexts of one order: codes (context, byte) with counts; contexts with their sums, symbols and symbols counted once."""

    codes: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    of: np.ndarray
    n: np.ndarray
    symbols: np.ndarray
    once: np.ndarray
    #: What stays of the context one byte shorter when this context's symbols are excluded there: counts, and those counted once.
    left: np.ndarray | None = None
    left_once: np.ndarray | None = None


def level_of(codes: np.ndarray, counts: np.ndarray) -> Level:
    context = codes >> np.uint64(8)
    new = np.concatenate([np.ones(min(1, len(codes)), bool), context[1:] != context[:-1]])
    first, of = np.flatnonzero(new), np.cumsum(new) - 1
    width = len(first)
    summed = lambda x: np.bincount(of, x, width).astype(np.int64)
    return Level(codes, counts, context[first], of, summed(counts), summed(np.ones(len(codes))), summed(counts == 1))


def levels_of(grams: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray], spread: Spread) -> list[Level]:
    """Levels 0 to ORDER, from a shard's training grams (sorted), the shared counts of order LOW and those of hot contexts."""
    levels: list[Level | None] = [None] * (ORDER + 1)
    levels[ORDER] = level_of(grams, counts)
    for k in range(ORDER - 1, LOW, -1):
        codes, times = _met_once(levels[k + 1].codes)
        if k in spread:
            shared, n = spread[k]
            own = ~_find(shared, codes)[1]  # of a hot context any code met here is among the exchanged ones
            codes, times = np.concatenate([codes[own], shared]), np.concatenate([times[own], n])
            order = np.argsort(codes)
            codes, times = codes[order], times[order]
        levels[k] = level_of(codes, times)
    codes, counts = low
    levels[LOW] = level_of(codes, counts)
    for k in range(LOW - 1, -1, -1):
        codes, back = np.unique(((codes >> np.uint64(16)) << np.uint64(8)) | (codes & np.uint64(255)), return_inverse=True)
        counts = np.bincount(back, counts, len(codes)).astype(np.int64)
        levels[k] = level_of(codes, counts)
    for k in range(1, ORDER + 1):
        here, below = levels[k], levels[k - 1]
        at, _ = _find(below.codes, ((here.codes >> np.uint64(16)) << np.uint64(8)) | (here.codes & np.uint64(255)))
        shared = below.counts[at] if len(below.counts) else np.zeros(len(at), np.int64)
        parent, _ = _find(below.contexts, here.contexts >> np.uint64(8))
        width = len(here.contexts)
        if width:
            here.left = below.n[parent] - np.bincount(here.of, shared, width).astype(np.int64)
            here.left_once = below.once[parent] - np.bincount(here.of, shared == 1, width).astype(np.int64)
        else:
            here.left = here.left_once = np.zeros(0, np.int64)
    return levels


def escape(n: np.ndarray, once: np.ndarray) -> np.ndarray:
    """Rate at which contexts with n counts left, `once` of them of symbols counted once, pass on to a shorter one."""
    return np.where(n == 1, ESCAPE_ONCE, np.minimum(ESCAPE_MOST, (ESCAPE_PRIOR + ESCAPE_SINGLE * once) / (n + ESCAPE_SHIFT)))


def log10_of(levels: list[Level], grams: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's last byte after its context."""
    out, coded = np.zeros(len(grams)), np.zeros(len(grams), bool)
    above, above_seen = np.zeros(len(grams), np.int64), np.zeros(len(grams), bool)
    for k in range(ORDER, -1, -1):
        level = levels[k]
        codes = _shorter(grams, k)
        at, seen = _find(level.contexts, codes >> np.uint64(8))
        if not len(level.contexts):
            continue
        place, hit = _find(level.codes, codes)
        n, once = level.n[at], level.once[at]
        if k < ORDER:
            longer = levels[k + 1]
            if len(longer.contexts):
                n = np.where(above_seen, longer.left[above], n)
                once = np.where(above_seen, longer.left_once[above], once)
        active = ~coded & seen & (n > 0)
        n = np.maximum(n, 1)
        leaves = np.where(level.symbols[at] >= 256, 0.0, escape(n, once))
        won, lost = active & hit, active & ~hit
        out[won] += np.log10((1 - leaves[won]) * level.counts[place[won]] / n[won])
        out[lost] += np.log10(leaves[lost])
        coded |= won
        above, above_seen = at, seen
    known = int(levels[0].symbols[0]) if len(levels[0].contexts) else 0
    out[~coded] -= math.log10(max(1, 256 - known))
    return out


def _low_counts(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of order LOW over all training rows; 2^24 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, counts in zip(batch.column("payload").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(_risen(codes).astype(np.int32)), pa.array(_unpacked(counts, "<u8").astype(np.int64))], names=["code", "n"])

    rows = table.where("kind = 'low'").select("payload", "counts").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, n = rows["code"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(code)
    return code[order].astype(np.uint64), n[order].astype(np.int64)


def _spread_counts(table: DataFrame, hot: Hot) -> Spread:
    """The counts of hot contexts over all training rows: a context of one byte more adds one for each symbol, wherever it lies."""
    if not hot:
        return {}

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, 64):
            own = []
            for payload, counts in zip(batch.column("payload").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                grams = _risen(payload)[_unpacked(counts, "<u8") > 0]
                own.append(grams[_find(hot[LOW + 1], _context(grams, LOW + 1))[1]])
            kept = [i for i, g in enumerate(own) if len(g)]
            yield pa.RecordBatch.from_arrays([batch.column("shard").take(pa.array(kept, pa.int64())), pa.array([_rising(own[i]) for i in kept], pa.binary())], names=["shard", "payload"])

    def run(shard: pa.Table) -> pa.Table:
        codes, _ = _distinct(np.concatenate([_risen(p) for p in shard["payload"].to_pylist()]))
        out = []
        for k in range(ORDER - 1, LOW, -1):
            # Codes of hot contexts lie in several shards and are counted once, below.
            if k + 1 in hot:
                whole = codes[~_find(hot[k + 1], codes >> np.uint64(8))[1]]
            else:
                whole = codes
            shorter, n = _met_once(whole)
            ours = _find(hot[k], shorter >> np.uint64(8))[1]
            out.append((np.full(int(ours.sum()), k, np.int32), shorter[ours].astype(np.int64), n[ours]))
            codes, _ = _met_once(codes)
        return pa.table(dict(zip(("k", "code", "n"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    rows = table.where("kind = 'gram'").select("shard", "payload", "counts").mapInArrow(narrowed, "shard int, payload binary")
    found = rows.groupBy("shard").applyInArrow(run, "k int, code long, n long").groupBy("k", "code").agg(F.sum("n").alias("n")).toArrow()  # 256 of a hot context at most
    order, code, n = found["k"].to_numpy(), found["code"].to_numpy().astype(np.uint64), found["n"].to_numpy()
    out: Spread = {}
    for k in range(ORDER - 1, LOW, -1):
        codes, times = code[order == k], n[order == k]
        if k + 1 in out:
            more, once = _met_once(out[k + 1][0])
            codes, times = np.concatenate([codes, more]), np.concatenate([times, once])
        codes, back = np.unique(codes, return_inverse=True)
        out[k] = codes, np.bincount(back, times, len(codes)).astype(np.int64)
    return out


def _gram_answers(table: DataFrame, low: tuple[np.ndarray, np.ndarray], spread: Spread) -> DataFrame:
    """For each block and shard the log10 probabilities of the block's grams, in its order."""
    shared = table.sparkSession.sparkContext.broadcast((low, spread))  # 2^24 codes and counts at most, and 256 * HOT of three orders

    def run(shard: pa.Table) -> pa.Table:
        own, counts = [], []
        for payload, count in zip(shard["payload"].to_pylist(), shard["counts"].to_pylist(), strict=True):
            own.append(_risen(payload))
            counts.append(_unpacked(count, "<u8").astype(np.int64))
        grams, times = np.concatenate(own), np.concatenate(counts)
        order = np.argsort(grams)
        grams, times = grams[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        grams, times = grams[first], np.add.reduceat(times, first)
        trained = times > 0
        scores = log10_of(levels_of(grams[trained], times[trained], *shared.value), grams).astype("<f4")
        answers = [_packed(scores[np.searchsorted(grams, g)]) for g in own]
        return pa.table([pa.array(["gram"] * len(own), pa.string()), shard["block"], shard["shard"], pa.array(answers, pa.binary()), pa.nulls(len(own), pa.binary()), pa.nulls(len(own), pa.binary())], names=[c for c, _ in _COLUMNS])

    return table.where("kind = 'gram'").select("block", "shard", "payload", "counts").groupBy("shard").applyInArrow(run, _SCHEMA)


def _word_answers(table: DataFrame) -> DataFrame:
    """For each block and shard the training counts of the block's words; a row of kind `size` with tokens and distinct words a shard."""

    def run(shard: pa.Table) -> pa.Table:
        rows = []
        total: Counter = Counter()
        for payload, count, sizes in zip(shard["payload"].to_pylist(), shard["counts"].to_pylist(), shard["sizes"].to_pylist(), strict=True):
            words = pa.decompress(payload, int(np.frombuffer(sizes, "<i8")[0]), codec="zstd", asbytes=True).split(b"\n")
            rows.append(words)
            for w, c in zip(words, _unpacked(count, "<u8").tolist(), strict=True):
                total[w] += c
        answers = [_packed(np.array([total[w] for w in words], np.uint64)) for words in rows]
        counted = np.array([sum(total.values()), sum(c > 0 for c in total.values())], "<i8").tobytes()
        kinds, blocks_, payloads = ["word"] * len(rows) + ["size"], [*shard["block"].to_pylist(), None], [*answers, None]
        sizes = [None] * len(rows) + [counted]
        return pa.table([pa.array(kinds, pa.string()), pa.array(blocks_, pa.int64()), pa.array([shard["shard"][0].as_py()] * len(kinds), pa.int32()), pa.array(payloads, pa.binary()), pa.nulls(len(kinds), pa.binary()), pa.array(sizes, pa.binary())], names=[c for c, _ in _COLUMNS])

    return table.where("kind = 'word'").select("block", "shard", "payload", "counts", "sizes").groupBy("shard").applyInArrow(run, _SCHEMA)


def _sums(shards: int, hot: Hot):
    """Function of a block's rows (its texts and all answers): sums of each segment."""
    names = ("row", "doc_id", "n_tokens", "n_known", "base", "lp")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def run(block: pa.Table) -> pa.Table:
        rows = block.to_pylist()
        answers = {(r["kind"], r["shard"]): r["payload"] for r in rows if r["kind"] != "text"}
        [text] = [r for r in rows if r["kind"] == "text"]
        row, doc_id, known, held, lengths, n_words, ends = np.frombuffer(text["sizes"], "<i8").reshape(7, -1)
        whole = pa.decompress(text["payload"], int(lengths.sum()), codec="zstd", asbytes=True)
        stops = np.cumsum(lengths).tolist()
        segments = [whole[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
        train = [not h for h in held.tolist()]
        parts = []
        for own in _chunks(segments):
            codes = grams_of(own)
            order = np.argsort(codes)
            codes = codes[order]
            new = np.concatenate([[True], codes[1:] != codes[:-1]])
            parts.append((codes[new], new, order.astype(np.uint32), np.cumsum([0, *[len(s) - ORDER for s in own[:-1]]])))
        grams, _ = _distinct(np.concatenate([p[0] for p in parts]))
        scores = np.empty(len(grams))
        by_shard, met, begin = _by_shard(grams, shards, hot)
        for shard, a, b in zip(met.tolist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            scores[by_shard[a:b]] = _unpacked(answers["gram", shard], "<f4")
        lp = []
        for codes, new, order, begins in parts:
            along = np.empty(len(order))
            along[order] = scores[np.searchsorted(grams, codes)][np.cumsum(new) - 1]
            lp.append(np.add.reduceat(along, begins))
        logs: dict[bytes, float] = {}
        for shard, words in _by_word_shard(_word_counts(segments, train), shards).items():
            logs.update(zip(words, np.log10(_unpacked(answers["word", shard], "<u8") + 1.0).tolist(), strict=True))
        found, base = [], []
        for segment, end in zip(segments, ends.tolist(), strict=True):
            own = [logs[w] for w in segment[ORDER:].split()]
            if end:
                own.append(logs[b""])
            found.append(len(own) - own.count(0.0))
            base.append(math.fsum(own))
        ids = pa.array([i if k else None for i, k in zip(doc_id.tolist(), known.tolist(), strict=True)], pa.int64())
        columns = [row, ids, n_words + ends, found, base, np.concatenate(lp)]
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

    return run


def score(docs: DataFrame, modulus: int = 7, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    shards = int(size // shard) + 1
    hot = hot_contexts(docs, size, shards)
    sent = written(blocks(docs, shards, hot, modulus, block), "ppm-blocks", by="kind")
    words = written(_word_answers(sent), "ppm-words")
    counted = [np.frombuffer(r[0], "<i8") for r in words.where("kind = 'size'").select("sizes").toLocalIterator()]  # a row a shard
    n_train, distinct = (int(sum(c[i] for c in counted)) for i in (0, 1))
    base_total = math.log10(n_train + distinct + 1)
    answers = _gram_answers(sent, _low_counts(sent), _spread_counts(sent, hot)).unionByName(words.where("kind = 'word'"))
    texts = sent.where("kind = 'text'")
    per_segment = texts.unionByName(answers).groupBy("block").applyInArrow(_sums(shards, hot), "row long, doc_id long, n_tokens long, n_known long, base double, lp double")
    out = per_segment.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "lp")])
    base = F.col("base") - F.col("n_tokens") * base_total
    return out.select("doc_id", held_out(F.col("doc_id"), modulus).alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), F.col("lp").alias("score"))
