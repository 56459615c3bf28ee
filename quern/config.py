"""Settings, and helpers that every operator may need."""

from __future__ import annotations

import json
import tempfile
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class CollectionConfig:
    """What writers and readers of one collection must agree on."""

    collection_name: str = "corpus"
    embedding_model: str = "hash-embedder"
    embedding_device: str = "cpu"
    normalize_embeddings: bool = True
    query_prefix: str = "query: "
    passage_prefix: str = "passage: "
    hnsw_space: str = "cosine"

    @classmethod
    def load(cls, path: str | Path) -> CollectionConfig:
        """Defaults overlaid by a JSON file; an absent or unreadable file leaves the defaults."""
        try:
            found = json.loads(Path(path).read_text(encoding="utf-8"))
            known = {f.name for f in fields(cls)}
            return replace(cls(), **{k: v for k, v in found.items() if k in known})
        except (OSError, ValueError, AttributeError):
            return cls()

    def save_if_absent(self, path: str | Path) -> bool:
        """Write the settings unless the file is there; whether it was written."""
        target = Path(path)
        if target.exists():
            return False
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(json.dumps(asdict(self), indent=2), encoding="utf-8")
        return True


@dataclass(frozen=True)
class SearchConfig:
    candidates: int = 20
    rrf_k: int = 60
    dense_weight: float = 0.5
    sparse_weight: float = 0.5
    similarity_threshold: float = 0.0
    hybrid: bool = True
    rerank: bool = True


@dataclass(frozen=True)
class CrawlConfig:
    max_depth: int = 1
    filter_mode: str = "include"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def patterns(self) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """(include, exclude): only the list that the mode names is in force; any other mode filters nothing."""
        mode = self.filter_mode.lower()
        return (self.include if mode == "include" else ()), (self.exclude if mode == "exclude" else ())


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder the cluster shares (spark.checkpoint.dir); one of our own only where it is unset."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="quern-"))
    return df.checkpoint(eager=True)


def arrow_batches(spark: SparkSession, rows: int = 10_000, size: int = 8 << 20) -> None:
    """Bound the session's Arrow batches by rows and bytes, so that texts, not counts, decide what a Python worker holds.

    Smaller limits of its own stay.  Plans read these settings when they run, so they stay set; they change no result.
    """
    name = "spark.sql.execution.arrow.max{}PerBatch"
    in_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if not 0 < in_bytes(spark.conf.get(name.format("Bytes"))) <= size:
        spark.conf.set(name.format("Bytes"), str(size))
    if not 0 < int(spark.conf.get(name.format("Records"))) <= rows:
        spark.conf.set(name.format("Records"), str(rows))
