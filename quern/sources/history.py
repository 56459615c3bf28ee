"""Crawl history: which urls were ingested, with what result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "STRUCT<type: STRING, chunks: INT, ingested_at: DOUBLE, context: STRING, questions: ARRAY<STRING>>"
FILE = f"version INT, base_url STRING, urls MAP<STRING, {ENTRY}>"
SCHEMA = "url STRING, type STRING, chunks INT, ingested_at DOUBLE, context STRING, questions ARRAY<STRING>"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """History rows of a JSON file whose urls are keys; a missing or broken file is an empty history."""
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return empty(spark)
    parsed = raw.select(F.from_json("value", FILE).alias("h"))
    return parsed.select(F.explode("h.urls").alias("url", "e")).select("url", "e.*")


def to_json(history: DataFrame, base_url: str = "", version: int = 1) -> DataFrame:
    """The whole history as one JSON text, for export."""
    entry = F.struct("type", "chunks", "ingested_at", "context", "questions")
    urls = F.map_from_entries(F.collect_list(F.struct("url", entry)))
    return history.agg(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(base_url).alias("base_url"), urls.alias("urls"))).alias("json"))


def when_ingested(history: DataFrame) -> DataFrame:
    return history.withColumn("ingested_ts", F.timestamp_seconds("ingested_at"))


def new_urls(crawled: DataFrame, history: DataFrame) -> DataFrame:
    return crawled.join(history.select("url"), "url", "left_anti")


def known_urls(crawled: DataFrame, history: DataFrame) -> DataFrame:
    return crawled.join(history.select("url"), "url", "left_semi")


def _lacking() -> object:
    return (F.coalesce("context", F.lit("")) == "") | (F.coalesce(F.size("questions"), F.lit(0)) <= 0)


def unenriched(crawled: DataFrame, history: DataFrame) -> DataFrame:
    """Known urls without a context or without questions; null, empty and no questions are the same."""
    return crawled.join(history.where(_lacking()).select("url"), "url", "left_semi")


def marked(history: DataFrame, entries: DataFrame) -> DataFrame:
    """History with entries put in, each replacing its url's; empty contexts and questions are left out.

    Of several entries of a url the last by ingested_at counts.
    """
    clean = entries.select(
        "url", "type", F.col("chunks").cast("int").alias("chunks"), "ingested_at", F.nullif("context", F.lit("")).alias("context"),
        F.when(F.size("questions") > 0, F.col("questions")).alias("questions"),
    )
    last = Window.partitionBy("url").orderBy(F.desc("ingested_at"), "type", "chunks")
    clean = clean.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r")
    return history.join(clean.select("url"), "url", "left_anti").unionByName(clean)


def enriched(history: DataFrame, found: DataFrame) -> DataFrame:
    """History with new contexts and questions (url, context, questions) where its urls have them; empty ones change nothing."""
    new = found.select("url", F.nullif("context", F.lit("")).alias("c"), F.when(F.size("questions") > 0, F.col("questions")).alias("q"))
    joined = history.join(new, "url", "left")
    return joined.select(
        "url", "type", "chunks", "ingested_at", F.coalesce("c", "context").alias("context"), F.coalesce("q", "questions").alias("questions")
    )


def cleared(history: DataFrame) -> DataFrame:
    return history.limit(0)
