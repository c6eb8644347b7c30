"""What the training-data operators share: word class, hold-outs, written intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: Word separators of every operator here: space, tab, LF, VT, FF, CR. `bytes.split()` splits at the same six.
SEPARATORS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder (a subfolder for each value of `by`) and read it back: lineage ends there and an executor's loss costs nothing."""
    path = os.path.join(shared_folder(df.sparkSession), "corpusforge", f"{name}-{uuid.uuid4().hex}")
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(taken: list[str], base: str) -> str:
    """A column name like `base` that none of `taken` has, upper and lower case alike."""
    have, name, n = {t.lower() for t in taken}, base, 0
    while name.lower() in have:
        n += 1
        name = f"{base}_{n}"
    return name


def held_out(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`, is 2. A null id counts as the empty text (remainder 0)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == 2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def give_back() -> None:
    """Return what a Python worker holds free to the system: workers are reused, and the next stage may need the memory elsewhere."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def arrow_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to `size` rows, so that long texts never meet in one Python list of thousands."""
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
    give_back()


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
