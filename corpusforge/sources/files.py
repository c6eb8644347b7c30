"""Document sources: recursive scan, format dispatch, and loaders for Markdown, DOCX, HWPX and (if a library is there) PDF."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import version_of

#: Suffixes that have a loader.
FORMATS = ("md", "txt", "docx", "hwpx", "pdf")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative), content, suffix, version, superseded, source of every regular file below the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/").split("://")[-1] + "/"
    path = F.substring_index(F.regexp_replace("path", "^[a-z]+:/+", "/"), root, -1)
    return described(files.select(path.alias("path"), "content"), "path")


def described(files: DataFrame, path: str) -> DataFrame:
    v = version_of(F.col(path))
    return files.withColumns({"suffix": suffix(F.col(path)), "version": v["version"], "superseded": v["superseded"], "source": v["source"]})


def rejected(files: DataFrame) -> DataFrame:
    """Files without a loader."""
    return files.where(~F.col("suffix").isin(*FORMATS))


def normalize(text: str) -> str:
    """No blanks at line ends, two newlines at most in a row, nothing around."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+$", "", text, flags=re.M)).strip()


def docx_text(content: bytes) -> str:
    """Paragraphs, then table rows with cells joined by ' | '."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t"))
    lines = [text(p) for p in body.findall(f"{w}p")]
    for row in (r for t in body.findall(f"{w}tbl") for r in t.findall(f"{w}tr")):
        lines.append(" | ".join(text(c).strip() for c in row.findall(f"{w}tc")))
    return normalize("\n".join(lines))


def hwpx_text(content: bytes) -> str:
    """Text of the sections of an HWPX archive, a line for each paragraph."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    lines = []
    for name in sorted(n for n in archive.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)):
        for p in ElementTree.fromstring(archive.read(name)).iter():
            if p.tag.endswith("}p"):
                lines.append("".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")))
    return normalize("\n".join(lines))


def pdf_text(content: bytes) -> tuple[str, int]:
    """Pages joined by an empty line, and their number; needs pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("PDF files need the library pypdf") from e
    pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
    return normalize("\n\n".join(pages)), len(pages)


def load_one(kind: str, content: bytes) -> tuple[str | None, int | None, str | None]:
    """(text, pages, error) of a file; a damaged file is reported, not raised."""
    try:
        if kind in ("md", "txt"):
            return content.decode("utf-8"), None, None
        if kind == "docx":
            return docx_text(content), None, None
        if kind == "hwpx":
            return hwpx_text(content), None, None
        if kind == "pdf":
            return (*pdf_text(content), None)
    except Exception as e:  # noqa: BLE001  reported in the row
        return None, None, f"{type(e).__name__}: {e}"
    return None, None, "no loader"


def load(files: DataFrame) -> DataFrame:
    """The files of `scan` with text, pages and error instead of content."""
    kept = [c for c in files.columns if c != "content"]

    def run(batches):
        for pdf in batches:
            found = [load_one(s, bytes(c)) for s, c in zip(pdf["suffix"], pdf["content"], strict=True)]
            out = pdf[kept].copy()
            out["text"], out["error"] = [f[0] for f in found], [f[2] for f in found]
            out["pages"] = pd.array([f[1] for f in found], "Int32")
            yield out[[*kept, "text", "pages", "error"]]

    schema = files.drop("content").withColumns({"text": F.lit(None).cast("string"), "pages": F.lit(None).cast("int"), "error": F.lit(None).cast("string")}).schema
    return files.mapInPandas(run, schema)
