"""Queries that write: the store's versions, ingestion with its history, the crawl history's file, files of a folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import urls
from quern.operators import chunking
from quern.plans.chunk_queries import SEMANTIC_PAGES
from quern.plans.registry import query, table
from quern.plans.url_queries import CLASS, NETLOC
from quern.sources import web
from quern.sources.store import VectorStore
from quern.streaming.ingest import HISTORY_SCHEMA, Ingestion


def _folder(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares; one of our own only where that is unset."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="quern-store-")
    return f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}"


def _rows(spark: SparkSession, sf_dir: str, mark: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit(mark), F.col("text")).alias("document"))


def _twice(spark: SparkSession, sf_dir: str) -> VectorStore:
    """A store of all documents, of which those with a label were put in a second time."""
    store = VectorStore(spark, _folder(spark), "id STRING, document STRING")
    store.upsert(_rows(spark, sf_dir, "a "))
    again = _rows(spark, sf_dir, "b ").join(table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id")).distinct(), "id", "left_semi")
    store.upsert(again.unionByName(again.select(F.concat(F.lit("x"), "id").alias("id"), "document")))
    return store


_TWICE = """store AS (SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'b ' ELSE 'a ' END || text AS document FROM documents
  UNION ALL SELECT 'x' || doc_id, 'b ' || text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"""


@query(f"WITH {_TWICE} SELECT id, md5(document) AS digest FROM store")
def store_upsert(spark, sf_dir):
    return _twice(spark, sf_dir).read().select("id", F.md5("document").alias("digest"))


@query(f"WITH {_TWICE} SELECT id, md5(document) AS digest FROM store WHERE id IN (SELECT item_id::VARCHAR FROM benchmark) OR id IN (SELECT 'x' || doc_id FROM labels)")
def store_lookup(spark, sf_dir):
    """Rows by id, from the store itself: ids that come twice or that it lacks change nothing."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"))
    other = table(spark, sf_dir, "labels").select(F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("id"))
    found = _twice(spark, sf_dir).lookup(asked.unionByName(asked).unionByName(other).unionByName(spark.sql("SELECT 'none' AS id")))
    return found.select("id", F.md5("document").alias("digest"))


@query(f"WITH {_TWICE} SELECT count(*)::BIGINT AS n, true AS populated, false AS populated_before, 2::BIGINT AS version FROM store")
def store_state(spark, sf_dir):
    before = VectorStore(spark, _folder(spark), "id STRING, document STRING").is_populated()
    store = _twice(spark, sf_dir)
    return spark.sql(f"SELECT {store.count()}L AS n, {str(store.is_populated()).lower()} AS populated, {str(before).lower()} AS populated_before, {store.version()}L AS version")


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("url", urls.classify(F.col("url")).alias("type"), F.col("html").alias("body"), F.col("page_id").alias("seq"))


def _ingested(spark: SparkSession, sf_dir: str) -> Ingestion:
    """Every third page first, then all of them: the first ones are known by then."""
    folder = _folder(spark)
    made = Ingestion(VectorStore(spark, f"{folder}/store"), VectorStore(spark, f"{folder}/history", HISTORY_SCHEMA), chunking.splitter("semantic"))
    fetched = _fetched(spark, sf_dir)
    made.batch(fetched.where("seq % 3 = 0"), 1.0)
    made.batch(fetched, 2.0)
    return made


@query(
    f"""WITH RECURSIVE {SEMANTIC_PAGES}, turned AS (SELECT *, row_number() OVER (PARTITION BY url, md5(chunk) ORDER BY idx) - 1 AS turn FROM chunked),
    named AS (SELECT *, md5(chunk) || CASE WHEN turn > 0 THEN '-' || turn ELSE '' END AS id FROM turned)
    SELECT id, arg_max(url, (page_id % 3 <> 0, page_id)) AS url, any_value(length(chunk))::INTEGER AS n FROM named GROUP BY id"""
)
def ingest_store(spark, sf_dir):
    """What two batches leave in the store; of an id in several pages the last one written."""
    return _ingested(spark, sf_dir).store.read().select("id", "metadata.url", F.length("document").alias("n"))


@query(f"""WITH RECURSIVE {SEMANTIC_PAGES} SELECT url, any_value({CLASS}) AS type, count(*)::INTEGER AS chunks, CASE WHEN any_value(page_id) % 3 = 0 THEN 1.0 ELSE 2.0 END::DOUBLE AS ingested_at
FROM chunked GROUP BY url""")
def ingest_history(spark, sf_dir):
    return _ingested(spark, sf_dir).past().select("url", "type", "chunks", "ingested_at")


_RULES = "CASE WHEN host LIKE 'b%' THEN NULL WHEN length(host) % 3 = 0 THEN 'User-agent: *' || chr(10) || 'Disallow: /' WHEN length(host) % 3 = 1 THEN 'User-agent: *' || chr(10) || 'Disallow: /en' ELSE 'User-agent: other' || chr(10) || 'Disallow: /' END"


@query(f"""WITH robots AS (SELECT DISTINCT {NETLOC} AS host FROM pages WHERE {NETLOC} NOT LIKE 'c%'), ruled AS (SELECT host, {_RULES} AS rules FROM robots)
SELECT page_id, coalesce(CASE WHEN contains(rules, 'other') THEN true WHEN contains(rules, '/en') THEN NOT starts_with(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^#]*)', 1), '/en')
  WHEN rules IS NOT NULL THEN false END, true) AS allowed FROM pages LEFT JOIN ruled ON host = {NETLOC}""")
def robots_table(spark, sf_dir):
    """Rules from a table of fetched robots texts; a host whose text is missing or could not be fetched allows everything."""
    pages = table(spark, sf_dir, "pages")
    hosts = pages.select(urls.netloc(F.col("url")).alias("host")).distinct().where("host NOT LIKE 'c%'")
    robots = hosts.select("host", F.expr(_RULES.replace("chr(10)", "'\\n'")).alias("robots"))
    return web.with_allowed(pages.select("page_id", "url"), robots).select("page_id", "allowed")
