"""Files as sources: directories of PDF and DOCX, read as binary and taken apart by workers."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import strip

# fixed value: the namespace of WordprocessingML
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def scan(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, content of every file below a folder, whatever its type; order by path where order matters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select("path", "content")


def kind(path: Column) -> Column:
    """pdf or docx by extension, ignoring case; null for any other, .doc included."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return F.when(extension.isin("pdf", "docx"), extension)


def _paragraphs(archive: zipfile.ZipFile, name: str) -> list[str]:
    root = ET.fromstring(archive.read(name))
    out = []
    for p in root.iter(f"{_W}p"):
        parts = []
        for node in p.iter():
            if node.tag == f"{_W}t":
                parts.append(node.text or "")
            elif node.tag == f"{_W}tab":
                parts.append("\t")
            elif node.tag in (f"{_W}br", f"{_W}cr"):
                parts.append("\n")
        out.append("".join(parts).strip())
    return [p for p in out if p]


def docx_parts(content: bytes | None) -> tuple[list[str], list[str]] | None:
    """Body paragraphs, and those of all headers and footers; None for what is no DOCX file."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
            names = archive.namelist()
            marginal = [n for n in names if n.startswith(("word/header", "word/footer")) and n.endswith(".xml")]
            return _paragraphs(archive, "word/document.xml"), [p for n in marginal for p in _paragraphs(archive, n)]
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return None


def docx_text(content: Column, strip_margins: bool = True) -> Column:
    """Paragraphs joined by blank lines, without those that a header or footer also has; null for a broken file."""

    @F.pandas_udf("string")
    def run(contents: pd.Series) -> pd.Series:
        def one(raw: bytes | None) -> str | None:
            parts = docx_parts(raw)
            if parts is None:
                return None
            drop = set(parts[1]) if strip_margins else set()
            return "\n\n".join(p for p in parts[0] if p not in drop)

        return contents.map(one)

    return run(content)


def load(files: DataFrame, pdf: Callable[[Column], Column] | None = None) -> DataFrame:
    """path, text, meta(source, type) of the DOCX and PDF files of a scan; others and blank ones go.

    pdf: from content to text (see operators.cleaning for what follows a parser's lines); without one PDF files have
    no rows.
    """
    routed = files.withColumn("type", kind(F.col("path")))
    text = F.when(F.col("type") == "docx", docx_text(F.col("content")))
    if pdf is not None:
        text = text.when(F.col("type") == "pdf", pdf(F.col("content")))
    rows = routed.where("type is not null").withColumn("text", text).where(strip(F.col("text")) != "")
    return rows.select("path", "text", F.struct(F.col("path").alias("source"), "type").alias("meta"))


def pdf_text(pages: DataFrame) -> DataFrame:
    """url, text from a parser's page texts (url, attempt, page, text): of the first attempt that has any text."""
    some = pages.where(strip(F.coalesce("text", F.lit(""))) != "")
    tried = some.groupBy("url", "attempt").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("text")
    )
    return tried.groupBy("url").agg(F.min_by("text", "attempt").alias("text"))
