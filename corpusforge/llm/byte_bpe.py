"""Byte-level BPE by a sentencepiece model that is serialised directly from a rank file.

Method. A rank file maps byte strings to ranks, and BPE joins the neighbouring pair whose joined bytes have the lowest
rank. sentencepiece's BPE joins the pair whose joined piece has the highest score. So the model file is written here
field by field: every byte string becomes a piece of 'byte characters' (one printable character a byte), its score is
the negative rank, and the normaliser is the identity without dummy prefix or white-space escapes. Text is cut by the
pattern of the vocabulary; each distinct pre-token is encoded once a worker (a bounded memo) in batches. A text is then a
row of pre-token numbers, and its ids are gathered from the memo's array; decoding takes the bytes of each id from a table. Neither
makes a Python object for an id. Texts are encoded whole. A null text counts as the empty text: no ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows

#: Distinct pre-tokens that a worker remembers, and ids of theirs; beyond either the memo starts anew. It changes speed only.
MEMO, MEMO_IDS = 300_000, 4_000_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next code point from U+0100."""
    out, spare = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The rank file: a base64 byte string and a rank in each line. Its size is that of the vocabulary."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of the protocol-buffer wire format."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model of the ranks. Piece i is the i-th lowest rank; the last piece is the unknown one."""
    chars = byte_characters()
    pieces = [_field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank)) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    bpe, unknown, none = 2, len(pieces) - 1, (1 << 64) - 1
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, unknown) + b"".join(_field(n, none) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


def ascii_pattern(pattern: str) -> str | None:
    """What the pattern matches in ASCII text, for `re`, which is faster than `regex`; None if it says more than is known here."""
    sets = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": " \t-\r"}
    if re.search(r"\(\?[^!:=]|\[\^?\]", pattern):
        return None
    out, inside = [], False
    for part in re.findall(r"\\[pP]\{\^?\w+\}|\\.|.", pattern, re.DOTALL):
        if part in sets:
            out.append(sets[part] if inside else f"[{sets[part]}]")
        elif part == r"\S" and not inside:
            out.append("[^ \t-\r]")
        elif part[0] == "\\" and part[1].isalnum():
            return None
        else:
            inside = part != "]" and (inside or part == "[")
            out.append(part)
    return "".join(out)


class _Slots(dict):
    """The number of each pre-token, in order of first sight; `fresh` lists those whose ids aren't known yet."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, pre_token: str) -> int:
        slot = self[pre_token] = len(self)
        self.fresh.append(pre_token)
        return slot


def _spelled(pieces: pa.LargeBinaryArray, ids: pa.Array, stops: np.ndarray) -> pa.LargeBinaryArray:
    """The pieces of `ids` end to end: a row for the ids up to each stop."""
    taken = pieces.take(ids)
    if taken.null_count:
        raise KeyError("an id that the vocabulary doesn't have")
    _, offsets, data = taken.buffers()
    ends = np.frombuffer(offsets, np.int64)[taken.offset :][np.append(0, stops)] if len(taken) else np.zeros(len(stops) + 1, np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(ends), data or pa.py_buffer(b"")])


class Codec:
    """Encodes and decodes with one vocabulary; made once a worker."""

    def __init__(self, ranks: dict[bytes, int], model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        plain = ascii_pattern(pattern)
        self.split_ascii = re.compile(plain).findall if plain else self.split
        ordered = sorted(ranks.items(), key=lambda x: x[1])
        self.ids_by_piece = np.array([rank for _, rank in ordered], np.int32)
        self.whole = {token: [i] for i, (token, _) in enumerate(ordered)}
        by_id = {rank: token for token, rank in ranks.items()}
        self.bytes_by_id = pa.array([by_id.get(i) for i in range(max(by_id, default=-1) + 1)], pa.large_binary())
        self.map = dict(enumerate(byte_characters()))
        self._start_anew()

    def _start_anew(self) -> None:
        # The ids of slot k are known[starts[k] : starts[k + 1]].
        self.slots, self.known, self.starts = _Slots(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _encode_new(self, pre_tokens: list[str]) -> tuple[np.ndarray, list[int]]:
        """The ids of all pre_tokens end to end, and how many each has."""
        raw = [t.encode() for t in pre_tokens]
        found = self.processor.encode([r.decode("latin-1").translate(self.map) for r in raw], num_threads=1)
        for i, r in enumerate(raw):
            if len(found[i]) > 1 and r in self.whole:
                found[i] = self.whole[r]
        return self.ids_by_piece[np.fromiter(chain.from_iterable(found), np.int64)], [len(x) for x in found]

    def _slots_of(self, texts: list[str | None]) -> list[np.ndarray]:
        """The slots of each text's pre-tokens, all of them known."""
        if self.slots.fresh or len(self.slots) > MEMO or len(self.known) > MEMO_IDS:  # fresh ones are left if a call broke off
            self._start_anew()
        slot, out = self.slots.__getitem__, []
        for text in texts:
            pre_tokens = (self.split_ascii if text.isascii() else self.split)(text) if text else []
            out.append(np.fromiter(map(slot, pre_tokens), np.int64, len(pre_tokens)))
        if self.slots.fresh:
            ids, sizes = self._encode_new(self.slots.fresh)
            self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(sizes))
            self.known = np.append(self.known, ids)
            self.slots.fresh.clear()
        return out

    def _gathered(self, slots: np.ndarray) -> np.ndarray:
        starts = self.starts[slots]
        sizes = self.starts[slots + 1] - starts
        stops = np.cumsum(sizes)
        return self.known[np.repeat(starts - stops + sizes, sizes) + np.arange(stops[-1] if len(stops) else 0)]

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text, list<int32>."""
        found = [self._gathered(slots) for slots in self._slots_of(texts)]
        offsets = np.append(0, np.cumsum([len(ids) for ids in found], dtype=np.int64))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))

    def counts(self, texts: list[str | None]) -> pa.Array:
        """How many ids each text has."""
        return pa.array([int((self.starts[slots + 1] - self.starts[slots]).sum()) for slots in self._slots_of(texts)], pa.int64())

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each row of ids; none for a null."""
        stops = np.cumsum(sizes_of(ids).to_numpy())
        return _spelled(self.bytes_by_id, ids.flatten(), stops).cast(pa.binary())


def sizes_of(ids: pa.ListArray) -> pa.Array:
    """The number of ids in each row, 0 for a null."""
    return pc.fill_null(pc.list_value_length(ids), 0).cast(pa.int64())


@lru_cache(maxsize=2)
def _codec(key: str, pattern: str) -> Codec:
    ranks, model = _codec.sources[key]
    return Codec(ranks, model, pattern)


_codec.sources = {}


def worker_codec(shared) -> Codec:
    """The codec of a broadcast (key, ranks, model, pattern), made once a worker process."""
    key, ranks, model, pattern = shared.value
    _codec.sources[key] = (ranks, model)
    return _codec(key, pattern)


def share(spark: SparkSession, path: str, pattern: str):
    """Broadcast the vocabulary: a file of fixed size, so its bound is that of the vocabulary."""
    ranks = read_ranks(spark, path)
    model = sentencepiece_model(ranks)
    return spark.sparkContext.broadcast((hashlib.sha256(model).hexdigest(), ranks, model, pattern))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of ids (array<int>) of the whole text; null texts have no ids. A column named as `ids` is replaced."""
    shared = share(docs.sparkSession, path, pattern)
    kept = [c for c in docs.columns if c != ids]
    df = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = df.withColumn(ids, F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(shared)
        for batch in arrow_rows(batches, 256):
            yield pa.RecordBatch.from_arrays([*batch.columns, codec.encode(batch.column(text).to_pylist())], names=[*kept, ids])

    return df.mapInArrow(run, schema)


def encode_checked(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", whole: str = "round_trip") -> DataFrame:
    """docs without its texts, with their ids (array<int>) and whether the ids decode to the text's bytes.

    The ids are decoded where they were encoded, so texts go to Python once and don't come back.
    """
    shared = share(docs.sparkSession, path, pattern)
    kept = [c for c in docs.columns if c not in (text, ids, whole)]
    df = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(text))
    schema = df.drop(text).withColumns({ids: F.lit(None).cast("array<int>"), whole: F.lit(None).cast("boolean")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(shared)
        for batch in arrow_rows(batches, 256):
            texts = batch.column(len(kept))
            found = codec.encode(texts.to_pylist())
            same = pc.equal(codec.decode(found), pc.fill_null(texts.cast(pa.binary()), b""))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found, same], names=[*kept, ids, whole])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes of its ids in column `out` (binary); null ids give empty bytes."""
    shared = share(df.sparkSession, path, pattern)
    kept = [c for c in df.columns if c != out]
    df = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = df.withColumn(out, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(shared)
        for batch in arrow_rows(batches, 256):
            yield pa.RecordBatch.from_arrays([*batch.columns, codec.decode(batch.column(ids))], names=[*kept, out])

    return df.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, a row for each input row.

    The ids are decoded where they were encoded, so neither ids nor bytes move between tasks. Repeated rows give
    repeated rows; a null doc_id stays null.
    """
    shared = share(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(shared)
        digits = pa.array([f"{i},".encode() for i in range(len(codec.bytes_by_id))], pa.large_binary())
        for batch in arrow_rows(batches, 256):
            ids = codec.encode(batch.column("text").to_pylist())
            counts = sizes_of(ids)
            listed = _spelled(digits, ids.flatten(), np.cumsum(counts.to_numpy())).to_pylist()
            ids_sha = [hashlib.sha256(x[:-1]).hexdigest() for x in listed]
            decoded_sha = [hashlib.sha256(x).hexdigest() for x in codec.decode(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
