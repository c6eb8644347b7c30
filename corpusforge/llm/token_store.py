"""Token ids in a content-addressed store.

Method. Each document's ids, with its end id, are cut into chunks where a rolling hash of the last ids has its low bits
zero, so equal passages give equal chunks wherever they stand. A chunk is named by the hash of its bytes and stored
once. A document is a recipe: the names of its chunks in order. Recipes are kept in ascending doc_id order with the
position of the document in the whole id stream, and a manifest holds Merkle roots: of each part over its recipes with
their positions, and one of the whole store over the parts.

Files, all Parquet, in one folder (no file is rewritten):
  objects/kind=chunk    hash (16 bytes), data (ids, little-endian, 2 bytes each if the vocabulary fits, else 4)
  objects/kind=recipe   recipes as encoded, not yet in order
  recipes               part, doc_id, start, n_tokens, hashes; each part is a range of ascending doc_id
  manifest              part, n_docs, n_tokens, root (Merkle root of the part's recipes), item (bytes of a stored id);
                        the row of part -1 has the totals and the root over the parts' rows in turn

Reading back checks every chunk's bytes against its name, and all recipes against the manifest: a changed, missing or added
recipe, position or part stops it. A document's checksum is combined from its chunks' checksums
(crc32 is linear), so id data move once, to be made unique, and never again; `reconstruct` returns the ids themselves.
A null text is empty: its stream is the end id alone. Repeated rows are documents of their own. Null ids come first.
Columns besides doc_id and text are left out, whatever their names; an empty table gives a store without documents.

Texts are encoded word by word if the tokenizer's definition is the one that this is proven for (`SPLITS`), else whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import byte_characters
from .common import arrow_rows, shared_folder

#: The normaliser and pre-tokeniser under which a text's ids are its words' ids in turn.
SPLITS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Part number of the whole store in the manifest.
WHOLE = -1
#: Chunking: ids in the rolling window, mean, least and greatest length of a chunk in ids.
ROLLING, MEAN, LEAST, GREATEST = 8, 256, 32, 2048
#: Distinct words that a worker remembers, and the longest of them; they change speed only.
MEMO, MEMO_LENGTH = 600_000, 48
#: Chunk names that a worker remembers in order not to send a chunk twice; the store makes chunks unique anyway.
SENT = 200_000


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space, each distinct word encoded once.

    The vocabulary's pre-tokenizer never joins across ASCII white space, so a text's ids are its words' ids in turn; nor
    does it join letters with marks. Words of plain Latin letters and ASCII marks therefore go to the BPE model run by run
    (letters in lower case); all others, such as words with digits, apostrophes or special tokens, through the whole tokenizer.
    """

    def __init__(self, definition: str, width: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.chars = byte_characters()
        item = np.dtype(width).itemsize
        self.packed_id = [i.to_bytes(item, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.plain = re.compile(r"[a-zß-öø-ÿ]+").fullmatch
        self.simple = re.compile(r"[a-zß-öø-ÿ!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+").fullmatch
        self.capital = re.compile(r"[A-ZÀ-ÖØ-Þ]").search
        self.runs = re.compile(r"[a-zß-öø-ÿ]+|[^a-zß-öø-ÿ]+").findall
        self.marks: dict[str, bytes] = {}
        self.memo = _Memo(self.word)

    def _packed(self, ids: list[int]) -> bytes:
        table = self.packed_id
        return b"".join([table[i] for i in ids])

    def word(self, w: str) -> bytes:
        """The packed ids of one word."""
        small = w.lower() if self.capital(w) else w
        if self.plain(small):
            return self.memo[small] if small != w else self._letters(small)
        if self.simple(small) and "<|" not in small:
            return b"".join([self.memo[r] if self.plain(r) else self._mark(r) for r in self.runs(small)])
        return self._packed(self.tokenizer.encode(w, add_special_tokens=False).ids)

    def _letters(self, word: str) -> bytes:
        table = self.packed_id
        mapped = word if word.isascii() else "".join([self.chars[b] for b in word.encode()])
        return b"".join([table[t.id] for t in self.model.tokenize(mapped)])

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            ids = self._packed(self.tokenizer.encode(mark, add_special_tokens=False).ids)
            if len(self.marks) > 10_000 or len(mark) > MEMO_LENGTH:
                return ids
            self.marks[mark] = ids
        return self.marks[mark]

    def encode(self, text: str) -> bytes:
        """The ids of a text as packed bytes."""
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.memo.__getitem__, words))


class WholeEncoder:
    """Ids of whole texts by any tokenizer of the library."""

    def __init__(self, definition: str, width: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.width = Tokenizer.from_str(definition), width

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.width).tobytes()


def splits_at_words(definition: str) -> bool:
    """Whether `WordEncoder` gives this tokenizer's ids: the known splits, byte-level BPE with word ends, tokens added only in `<|...|>`."""
    d = json.loads(definition)
    model = d["model"]
    known = all(d[k] == v for k, v in SPLITS.items()) and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
    return known and all(t["content"].startswith("<|") and t["content"].endswith("|>") and not any(t[k] for k in ("single_word", "lstrip", "rstrip")) for t in d["added_tokens"])


class _Memo(dict):
    """Packed ids by word; a word that isn't there is encoded, and remembered if it is short."""

    def __init__(self, encode_word):
        super().__init__({"": b""})
        self.encode_word = encode_word

    def __missing__(self, word: str) -> bytes:
        ids = self.encode_word(word)
        if len(self) > MEMO:
            self.clear()
            self[""] = b""
        if len(word) <= MEMO_LENGTH:
            self[word] = ids
        return ids


_encoders: dict[str, WordEncoder | WholeEncoder] = {}


def _encoder(shared) -> WordEncoder | WholeEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    name, definition, width = shared.value
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = (WordEncoder if splits_at_words(definition) else WholeEncoder)(definition, width)
    return _encoders[name]


def _gear(ids: np.ndarray) -> np.ndarray:
    """A fixed pseudo-random 64-bit number for each id."""
    x = ids.astype(np.uint64) + np.uint64(1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def cuts_of(ids: np.ndarray, sizes: list[int]) -> list[list[int]]:
    """Ends of the chunks of id streams that stand one behind another: content-defined, LEAST to GREATEST ids each (the last may be shorter)."""
    rolled = _gear(ids)
    gear = rolled.copy()
    # Ids of the stream before reach into a stream's first ROLLING ids alone, where nothing is cut (LEAST is more).
    for k in range(1, min(ROLLING, len(ids))):
        rolled[k:] += gear[:-k] << np.uint64(k)
    marks = np.flatnonzero((rolled >> np.uint64(ROLLING)) % np.uint64(MEAN) == 0) + 1
    stops = np.cumsum(sizes)
    own = np.searchsorted(marks, np.concatenate([[0], stops]), side="left").tolist()
    marks, out = marks.tolist(), []
    for at, stop, a, b in zip((stops - sizes).tolist(), stops.tolist(), own[:-1], own[1:], strict=True):
        n, begin, ends = stop - at, 0, []
        for mark in [*[m - at for m in marks[a:b]], n]:
            while mark - begin > GREATEST:
                begin += GREATEST
                ends.append(begin)
            if mark - begin >= LEAST and mark < n or mark == n and mark > begin:
                ends.append(mark)
                begin = mark
        out.append(ends)
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream."""
    return cuts_of(ids, [len(ids)])[0]


def name_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def build(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> str:
    """Encode the documents and write the store; returns its folder. docs: doc_id, text (other columns are left out)."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/corpusforge/tokens-{uuid.uuid4().hex}"
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    from tokenizers import Tokenizer

    largest = max(Tokenizer.from_str(definition).get_vocab_size(), end_id + 1)
    width = "<u2" if largest <= 1 << 16 else "<u4"
    # A vocabulary file of fixed size, sent to the executors once.
    shared = spark.sparkContext.broadcast((f"{hashlib.sha256(definition.encode()).hexdigest()}{width}", definition, width))
    end = np.array([end_id], width).tobytes()
    item = np.dtype(width).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sent = _encoder(shared), set()
        for batch in arrow_rows(batches, 128):
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            streams = [encoder.encode(text or "") + end for text in batch.column("text").to_pylist()]
            ends = cuts_of(np.frombuffer(b"".join(streams), width), [len(s) // item for s in streams])
            for doc_id, data, stops in zip(batch.column("doc_id").to_pylist(), streams, ends, strict=True):
                begin, names = 0, []
                for stop in stops:
                    chunk = data[begin * item : stop * item]
                    begin = stop
                    names.append(name := name_of(chunk))
                    if name not in sent:
                        sent.add(name)
                        for column, value in zip(rows, ("chunk", name, chunk, None, None, None), strict=True):
                            column.append(value)
                if len(sent) > SENT:
                    sent.clear()
                for column, value in zip(rows, ("recipe", name_of(b"".join(names) + str(doc_id).encode()), None, doc_id, len(data) // item, b"".join(names)), strict=True):
                    column.append(value)
            kinds = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["kind", "hash", "data", "doc_id", "n_tokens", "hashes"])

    objects = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "kind string, hash binary, data binary, doc_id long, n_tokens long, hashes binary")
    # By hash: a chunk that a third of all documents share comes from each task once or a few times, not once a document.
    first = F.row_number().over(Window.partitionBy("kind", "hash").orderBy("kind"))
    unique = objects.repartition("hash").withColumn("copy", first).where("kind = 'recipe' or copy = 1").drop("copy")
    unique.write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/objects")

    recipes = spark.read.schema(objects.schema).parquet(f"{folder}/objects").where("kind = 'recipe'").select("doc_id", "n_tokens", "hashes")
    ordered = recipes.repartitionByRange("doc_id", "hashes").sortWithinPartitions("doc_id", "hashes").withColumn("part", F.spark_partition_id())
    ordered.write.option("compression", "zstd").parquet(f"{folder}/unplaced")
    placed = _placed(spark.read.schema(ordered.schema).parquet(f"{folder}/unplaced"))
    placed.write.option("compression", "zstd").parquet(f"{folder}/recipes")
    _with_whole(_manifest(read_recipes(spark, folder)), item).write.parquet(f"{folder}/manifest")
    return folder


def _placed(ordered: DataFrame) -> DataFrame:
    """Recipes with `start`, the ids of all documents before: a sum inside each part, shifted by the parts before (a row a part)."""
    sums = ordered.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("doc_id", "hashes").rowsBetween(Window.unboundedPreceding, -1)
    return ordered.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offsets, "part").select("part", "doc_id", (F.col("inner") + F.col("offset")).alias("start"), "n_tokens", "hashes")


def _manifest(recipes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by part and start; a part lies in one partition whole."""
        part, count, tokens, rows = None, 0, 0, []

        def leaf_rows():
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in ("part", "doc_id", "start", "n_tokens", "hashes")], strict=True)

        stack = _Stack()
        for p, doc_id, start, n, hashes in leaf_rows():
            if p != part:
                if part is not None:
                    rows.append((part, count, tokens, stack.root()))
                part, count, tokens, stack = p, 0, 0, _Stack()
            stack.add(name_of(f"{doc_id}:{start}:{n}:".encode() + hashes))
            count, tokens = count + 1, tokens + n
        if part is not None:
            rows.append((part, count, tokens, stack.root()))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["part", "n_docs", "n_tokens", "root"])

    return recipes.repartition("part").sortWithinPartitions("part", "start", "doc_id", "hashes").mapInArrow(run, "part int, n_docs long, n_tokens long, root binary")


def _with_whole(manifest: DataFrame, item: int) -> DataFrame:
    """The manifest with the bytes of an id, and the row of the whole store."""
    parts = manifest.orderBy("part").collect()  # a row a part, that is a task's share of all documents
    stack = _Stack()
    for p in parts:
        stack.add(name_of(f"{p['part']}:{p['n_docs']}:{p['n_tokens']}:{item}:".encode() + bytes(p["root"])))
    rows = [(WHOLE, sum(p["n_docs"] for p in parts), sum(p["n_tokens"] for p in parts), stack.root())] + [tuple(p) for p in parts]
    return manifest.sparkSession.createDataFrame([(*r, item) for r in rows], "part int, n_docs long, n_tokens long, root binary, item int")


class _Stack:
    """A Merkle tree that grows leaf by leaf; as deep as the tree."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, bytes]] = []

    def add(self, node: bytes) -> None:
        level = 0
        while self.nodes and self.nodes[-1][0] == level:
            level, node = level + 1, name_of(self.nodes.pop()[1] + node)
        self.nodes.append((level, node))

    def root(self) -> bytes:
        nodes, node = list(self.nodes), bytes(16)
        if nodes:
            node = nodes.pop()[1]
        while nodes:
            node = name_of(nodes.pop()[1] + node)
        return node


def read_recipes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("part int, doc_id long, start long, n_tokens long, hashes binary").parquet(f"{folder}/recipes")


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("hash binary, data binary, kind string").parquet(f"{folder}/objects").where("kind = 'chunk'").select("hash", "data")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("part int, n_docs long, n_tokens long, root binary, item int").parquet(f"{folder}/manifest")


def item_of(spark: SparkSession, folder: str) -> int:
    """Bytes of a stored id."""
    found = read_manifest(spark, folder).where(F.col("part") == WHOLE).select("item").first()
    if found is None:
        raise ValueError("the manifest doesn't list the whole store")
    return found[0]


def damaged(spark: SparkSession, folder: str) -> DataFrame:
    """Parts whose recipes aren't what the manifest lists, whether changed, missing or added, and -1 if the whole isn't; none if the store is sound."""
    kept, now = read_manifest(spark, folder), _with_whole(_manifest(read_recipes(spark, folder)), item_of(spark, folder))
    columns = ["n_docs", "n_tokens", "root", "item"]
    both = kept.select("part", F.struct(*columns).alias("kept")).join(now.select("part", F.struct(*columns).alias("now")), "part", "full")
    return both.where(~F.col("kept").eqNullSafe(F.col("now"))).select("part")


def _ids_as_u32(data: bytes, item: int) -> bytes:
    return np.frombuffer(data, "<u2").astype("<u4").tobytes() if item == 2 else data


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """Row n: what appending n ids (4 n zero bytes) does to each bit of a crc32."""
    def apply(matrix: np.ndarray, vector: int) -> int:
        out = 0
        for i in range(32):
            if vector >> i & 1:
                out ^= int(matrix[i])
        return out

    byte = np.array([(1 << i >> 8) ^ (zlib.crc32(bytes([1 << i])) ^ zlib.crc32(b"\0") if i < 8 else 0) for i in range(32)], np.uint64)
    word = byte
    for _ in range(3):
        word = np.array([apply(byte, int(x)) for x in word], np.uint64)
    out = np.zeros((GREATEST + 1, 32), np.uint64)
    out[0] = 1 << np.arange(32, dtype=np.uint64)
    for n in range(1, GREATEST + 1):
        bits = (out[n - 1][:, None] >> np.arange(32, dtype=np.uint64)) & np.uint64(1)
        out[n] = np.bitwise_xor.reduce(np.where(bits == 1, word, 0).astype(np.uint64), axis=1)
    return out


def crc_append(crc: np.ndarray, n_ids: np.ndarray, chunk_crc: np.ndarray) -> np.ndarray:
    """crc32 of each stretch of bytes followed by a chunk of n_ids 4-byte ids with its own crc32."""
    rows = _shifts()[n_ids]
    bits = (crc.astype(np.uint64)[:, None] >> np.arange(32, dtype=np.uint64)) & np.uint64(1)
    return np.bitwise_xor.reduce(rows * bits, axis=1) ^ chunk_crc.astype(np.uint64)


def crc_of_chunks(sizes: np.ndarray, n_ids: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """crc32 of each document, given its number of chunks and all chunks' lengths and checksums in order."""
    begin = np.cumsum(sizes) - sizes
    out = np.zeros(len(sizes), np.uint64)
    for position in range(int(sizes.max(initial=0))):
        open_ = np.flatnonzero(sizes > position)
        at = begin[open_] + position
        out[open_] = crc_append(out[open_], n_ids[at], crcs[at])
    return out


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the files.

    The recipes are held against the manifest first. Every stored chunk is read, held against its name and given its
    checksum; recipes meet these by name.
    """
    item = item_of(spark, folder)
    wrong = sorted(r["part"] for r in damaged(spark, folder).collect())  # a row a part at most
    if wrong:
        raise ValueError(f"recipes don't match the manifest in parts {wrong}")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, 4096):
            names, data = batch.column("hash").to_pylist(), batch.column("data").to_pylist()
            for name, d in zip(names, data, strict=True):
                if name_of(d) != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
            ends = np.cumsum([len(d) for d in data]) // item * 4
            wide = memoryview(_ids_as_u32(b"".join(data), item))
            crcs = [zlib.crc32(wide[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array([len(d) // item for d in data], pa.int32()), pa.array(crcs, pa.int64())], names=["hash", "n", "crc"])

    chunks = read_chunks(spark, folder).mapInArrow(checked, "hash binary, n int, crc long")
    recipes = read_recipes(spark, folder)
    size = F.octet_length("hashes")
    used = recipes.select("doc_id", "start", "n_tokens", "hashes", F.explode(F.sequence(F.lit(0), (size / 16 - 1).cast("int"))).alias("pos"))
    used = used.select("doc_id", "start", "n_tokens", "pos", F.substring(F.col("hashes"), F.col("pos") * 16 + 1, F.lit(16)).alias("hash"))
    # `start` is unique: every document has its end id. A missing chunk leaves a null and fails below.
    found = used.join(chunks, "hash", "left").groupBy("start", "doc_id", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "crc"))).alias("chunks"))

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, 1024):
            chunks = batch.column("chunks")
            sizes = chunks.value_lengths().to_numpy()
            n, crc = (chunks.flatten().field(c) for c in ("n", "crc"))
            if crc.null_count:
                raise ValueError("a chunk is missing")
            n = n.to_numpy()
            totals = np.bincount(np.repeat(np.arange(len(sizes)), sizes), n, len(sizes)).astype(np.int64)
            if (totals != batch.column("n_tokens").to_numpy()).any():
                raise ValueError("a recipe's chunks don't add up to its length")
            out = crc_of_chunks(sizes, n, crc.to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(out, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return found.mapInArrow(combined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (array<int>, end id included) of each document."""
    item = item_of(spark, folder)
    size = F.octet_length("hashes")
    used = read_recipes(spark, folder).select("doc_id", "start", "n_tokens", "hashes", F.explode(F.sequence(F.lit(0), (size / 16 - 1).cast("int"))).alias("pos"))
    used = used.select("doc_id", "start", "n_tokens", "pos", F.substring(F.col("hashes"), F.col("pos") * 16 + 1, F.lit(16)).alias("hash"))
    found = used.join(read_chunks(spark, folder), "hash").groupBy("start", "doc_id", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("pos", "data"))).alias("chunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, 64):
            ids = [np.frombuffer(b"".join(c["data"] for c in chunks), f"<u{item}").astype(np.int32) for chunks in batch.column("chunks").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "n_tokens", "ids"])

    return found.mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>")
