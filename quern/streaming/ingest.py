"""Ingestion: crawled pages to chunks, ids and vectors in the store, with history; as a batch or as a stream."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.config import CollectionConfig, cut
from quern.operators import chunking, models
from quern.operators.html import resources
from quern.sources import history as h
from quern.sources.store import VectorStore, last_of_each, with_ids


@dataclass
class Ingestion:
    """A store with its history table, and how texts become vectors."""

    store: VectorStore
    history: VectorStore  # same versioned layout, keyed by id = url
    split: chunking.Splitter = field(default_factory=chunking.splitter)
    config: CollectionConfig = CollectionConfig()
    embedder: object = models.HashEmbedder
    generate: models.Generator | None = None
    extractors: dict = field(default_factory=dict)

    def past(self) -> DataFrame:
        return self.history.read().select("id", "type", "chunks", "ingested_at", "context", "questions").withColumnRenamed("id", "url")

    def _write_history(self, rows: DataFrame) -> None:
        self.history.upsert(rows.withColumnRenamed("url", "id"))

    def _chunks(self, found: DataFrame) -> DataFrame:
        rows = chunking.chunks(found.select("url", "meta", "seq", "text"), "text", self.split)
        return rows.withColumnRenamed("chunk", "document").where("document <> ''")

    def _upsert(self, chunked: DataFrame) -> None:
        keyed = last_of_each(with_ids(chunked, "url", ["chunk_idx", "seq"]), ["seq", "chunk_idx"])
        rows = models.embedded(keyed, "document", self.embedder, self.config)
        self.store.upsert(rows.select("id", "document", F.col("meta").alias("metadata"), "embedding"))

    def batch(self, fetched: DataFrame, now: float, remember: bool = True) -> dict[str, int]:
        """Ingest fetched pages (url, type, body, seq) that the history lacks; counts of new, skipped and chunks.

        Each url is a batch of its own for repeated ids; of an id in several urls the later by seq wins.  Pages that
        can't be extracted stay out of the history and are tried again.  With remember=False, as for explicit lists,
        the history is neither read nor written and nothing is enriched.
        """
        past = self.past()
        new = h.new_urls(fetched, past) if remember else fetched
        found = resources(new, self.extractors, ("seq", "type")).withColumnRenamed("type", "kind")
        chunked = cut(self._chunks(found))
        per_url = chunked.groupBy("url").agg(F.count("*").cast("int").alias("chunks"))
        total = per_url.agg(F.count("*").alias("n"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks")).first()
        skipped = h.known_urls(fetched, past).count() if remember else 0
        if total["n"]:
            self._upsert(chunked)
        if remember and total["n"]:
            done = found.join(per_url, "url").withColumn("title", F.col("meta.filename"))
            if self.generate is not None:
                done = models.generated(done, self.generate)
            else:
                done = done.withColumns({"context": F.lit(None).cast("string"), "questions": F.lit(None).cast("array<string>")})
            entries = done.select("url", F.col("kind").alias("type"), "chunks", F.lit(now).alias("ingested_at"), "context", "questions")
            self._write_history(h.marked(h.empty(past.sparkSession), cut(entries)))
        return {"new": total["n"], "skipped": skipped, "chunks": total["chunks"]}

    def backfill(self, fetched: DataFrame) -> int:
        """Enrich known pages that lack a context or questions; how many got something.  Of pages of one url the last by seq counts."""
        if self.generate is None:
            return 0
        past = self.past()
        pages = resources(h.unenriched(fetched, past), self.extractors, ("seq",))
        pages = pages.groupBy("url").agg(F.max_by(F.struct("text", "meta"), "seq").alias("p")).select("url", "p.*")
        found = models.generated(pages.withColumn("title", F.col("meta.filename")), self.generate)
        found = cut(found.where("context is not null or size(questions) > 0").select("url", "context", "questions"))
        n = found.count()
        if n:
            self._write_history(h.enriched(past.join(found.select("url"), "url", "left_semi"), found))
        return n

    def stream(self, fetched: DataFrame, checkpoint: str) -> StreamingQuery:
        """The same over a stream of fetched pages.  A micro-batch that is run again changes nothing: ids come from contents."""

        def one(batch: DataFrame, _: int) -> None:
            import time

            self.batch(batch.dropDuplicates(["url"]), time.time())

        return fetched.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


HISTORY_SCHEMA = "id STRING, type STRING, chunks INT, ingested_at DOUBLE, context STRING, questions ARRAY<STRING>"
