"""Embedding, scoring and generating models behind small protocols; the built-in ones need no weights."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.config import CollectionConfig
from quern.functions.text import parse_generated, prefixed, prompt


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Signed hashes of words, summed: deterministic, and similar for texts that share words."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                row[h % self.dimensions] += 1.0 if h >> 63 else -1.0
        return out


def embedded(df: DataFrame, text: str, load: Callable[[], Embedder] = HashEmbedder, config: CollectionConfig = CollectionConfig(), query: bool = False) -> DataFrame:
    """df with embedding: the prefixed text encoded in batches, normalised if so configured; a model loads once per worker."""
    normalise = config.normalize_embeddings

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            vectors = np.asarray(model.encode(texts.fillna("").tolist()), dtype=np.float32)
            if normalise:
                vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            yield pd.Series(list(vectors))

    return df.withColumn("embedding", encode(prefixed(F.col(text), config.query_prefix if query else config.passage_prefix)))


Generator = Callable[[str], str]


def generated(df: DataFrame, generate: Generator, url: str = "url", title: str = "title", text: str = "text") -> DataFrame:
    """df with context and questions from a generator's answer to the prompt; whatever fails leaves both null."""

    @F.pandas_udf("string")
    def answer(prompts: pd.Series) -> pd.Series:
        def one(p: str | None) -> str | None:
            try:
                return None if p is None else generate(p)
            except Exception:  # noqa: BLE001  enrichment never stops ingestion
                return None

        return prompts.map(one)

    raw = answer(prompt(F.col(url), F.col(title), F.col(text)))
    parsed = df.withColumn("raw_", raw).withColumn("parsed_", parse_generated(F.col("raw_")))
    return parsed.withColumns({"context": F.col("parsed_.context"), "questions": F.col("parsed_.questions")}).drop("raw_", "parsed_")


def fallback(*sources: Column) -> Column:
    """The first that gives something."""
    return F.coalesce(*[F.nullif(s, F.lit("")) for s in sources])
