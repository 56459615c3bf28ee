"""A vector collection in parquet, with versions.

A write never changes what a reader has open: each is a new folder, and a row in the manifest makes it current.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = (
    "id STRING, document STRING, metadata STRUCT<source: STRING, filename: STRING, type: STRING, page: INT, url: STRING>,"
    " embedding ARRAY<FLOAT>"
)


def with_ids(chunks: DataFrame, batch: str, order: list[str], text: str = "document") -> DataFrame:
    """chunks with id: the content's hash, and -1, -2, ... for its repeats within a batch, in order."""
    md5 = F.md5(F.col(text))
    turn = F.row_number().over(Window.partitionBy(batch, md5).orderBy(*order)) - 1
    return chunks.withColumn("id", F.when(turn > 0, F.concat_ws("-", md5, turn.cast("string"))).otherwise(md5))


def last_of_each(rows: DataFrame, order: list[str]) -> DataFrame:
    """Of the rows of an id the last in order."""
    last = Window.partitionBy("id").orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("r_", F.row_number().over(last)).where("r_ = 1").drop("r_")


def upserted(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The collection after an upsert; new has one row per id."""
    return existing.join(new.select("id"), "id", "left_anti").unionByName(new)


class VectorStore:
    """A collection below a path that all machines share."""

    def __init__(self, spark: SparkSession, path: str, schema: str = SCHEMA) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def version(self) -> int:
        """The current version; 0 if nothing was ever written."""
        try:
            found = self.spark.read.parquet(f"{self.path}/manifest").agg(F.max("version").alias("v")).first()["v"]
        except AnalysisException:
            return 0
        return found or 0

    def read(self, version: int | None = None) -> DataFrame:
        at = self.version() if version is None else version
        if not at:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.parquet(f"{self.path}/data/v{at}")

    def lookup(self, ids: DataFrame) -> DataFrame:
        """Rows of the given ids (id); missing ones are absent."""
        return self.read().join(ids.select("id").distinct(), "id", "left_semi")

    def count(self) -> int:
        return self.read().count()

    def is_populated(self) -> bool:
        return not self.read().isEmpty()

    def upsert(self, new: DataFrame) -> int:
        """Write a new version with the rows put in, of a repeated id the last; returns the version."""
        at = self.version()
        upserted(self.read(at), new).write.mode("overwrite").parquet(f"{self.path}/data/v{at + 1}")
        stamp = self.spark.range(1).select(F.lit(at + 1).cast("long").alias("version"), F.current_timestamp().alias("written_at"))
        stamp.write.mode("append").parquet(f"{self.path}/manifest")
        return at + 1
