"""Text to chunks: fixed-size, sentence-aware and header-based, as columns of arrays."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.config import arrow_batches
from quern.functions.text import sentences, strip

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """Non-empty parts of a text, each but the first beginning with the separator."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in (head, *(separator + r for r in rest)) if p]


def _windows(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Greedy windows over consecutive pieces; a new one starts with the last pieces that fit the overlap."""
    out, first, total = [], 0, 0
    for last, piece in enumerate(pieces):
        if total + len(piece) > size and first < last:
            out.append("".join(pieces[first:last]).strip())
            while first < last and (total > overlap or (total + len(piece) > size and total > 0)):
                total -= len(pieces[first])
                first += 1
        total += len(piece)
    out.append("".join(pieces[first:]).strip())
    return [c for c in out if c]


def split_fixed(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` code points where separators allow, coarser separators first."""
    k = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    finer, out, small = separators[k + 1 :], [], []
    for piece in _pieces(text, separators[k]):
        if len(piece) < size:
            small.append(piece)
            continue
        if small:
            out += _windows(small, size, overlap)
            small = []
        out += split_fixed(piece, size, overlap, finer) if finer else [piece]
    return out + (_windows(small, size, overlap) if small else [])


def pack_sentences(parts: list[str], size: int = 1000, overlap: int = 200) -> list[str]:
    """Chunks of whole sentences, a line each, under a size of at least 100; the overlap is one sentence per 100, at least one."""
    size, back, out, first = max(size, 100), max(1, max(overlap, 0) // 100), [], 0
    while first < len(parts):
        last, used = first, 0
        while last < len(parts) and (not used or used + len(parts[last]) + 1 <= size):
            used += len(parts[last]) + (1 if used else 0)
            last += 1
        out.append("\n".join(parts[first:last]))
        if last >= len(parts):
            break
        first = max(first + 1, last - back)
    return out


def fixed(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_fixed(t, size, overlap) if t else [])

    return run(text)


def semantic(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Sentences are split natively; only packing, which looks back, is Python."""

    @F.pandas_udf("array<string>")
    def run(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: pack_sentences(list(p), size, overlap) if p is not None else [])

    return run(sentences(text))


_HTML_HEADER = r"(?i)<h([1-6])[^>\n]*>[^\n]*?</h\1>"
_MARKDOWN_HEADER = r"(?m)^#{1,6}\s+.+$"


def header_sections(text: Column) -> Column:
    """array<struct<header, body>>: HTML headings, else Markdown ones, else one section without a header.

    What comes before the first header is dropped.
    """
    bare = strip(F.coalesce(text, F.lit("")))

    def cut(pattern: str) -> Column:
        headers = F.regexp_extract_all(bare, F.lit(pattern), F.lit(0))
        bodies = F.split(F.regexp_replace(bare, pattern, "\u0001"), "\u0001", -1)
        return F.transform(headers, lambda h, i: F.struct(h.alias("header"), strip(F.get(bodies, i + 1)).alias("body")))

    whole = F.array(F.struct(F.lit("").alias("header"), bare.alias("body")))
    none = F.filter(whole, lambda s: F.lit(False))
    return (
        F.when(bare == "", none).when(bare.rlike(_HTML_HEADER), cut(_HTML_HEADER)).when(bare.rlike(_MARKDOWN_HEADER), cut(_MARKDOWN_HEADER)).otherwise(whole)
    )


def header_based(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """A section is one chunk if it fits, else it is split by size."""
    full = F.transform(
        header_sections(text), lambda s: F.when(s["header"] != "", F.concat(s["header"], F.lit("\n"), s["body"])).otherwise(s["body"])
    )

    @F.pandas_udf("array<string>")
    def run(sections: pd.Series) -> pd.Series:
        split = lambda s: [s] if len(s) <= size else split_fixed(s, size, overlap)
        return sections.map(lambda all_: [c for s in all_ for c in split(s)] if all_ is not None else [])

    return run(full)


Splitter = Callable[[Column], Column]


def splitter(strategy: str = "fixed_size", size: int = 1000, overlap: int = 200) -> Splitter:
    """`semantic`, `header_based`, or fixed size under any other name."""
    kind = {"semantic": semantic, "header_based": header_based}.get(strategy.lower().strip(), fixed)
    return lambda text: kind(text, size, overlap)


def chunks(df: DataFrame, text: str, split: Splitter) -> DataFrame:
    """df without its text, a row per chunk: chunk_idx and chunk; the other columns are repeated.

    Workers get at most 256 texts or 1 MB of them at a time: as Python strings, pieces and overlapping chunks take a
    multiple of that.
    """
    arrow_batches(df.sparkSession, 256, 1 << 20)
    others = [F.col(f"`{c}`") for c in df.columns if c != text]
    return df.select(*others, F.posexplode(split(F.col(text))).alias("chunk_idx", "chunk"))
