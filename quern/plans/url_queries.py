"""Queries over pages: URL functions, links, titles, texts, crawling, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.config import CrawlConfig
from quern.functions import urls
from quern.operators import crawl as crawling
from quern.operators import html as pages_html
from quern.plans.registry import query, table
from quern.sources import history as h
from quern.sources import web

_PATH = r"regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//[^/?#]*([^?#]*)', 1)"
NETLOC = "lower(regexp_extract(url, '^(?:[^:/?#]+:)?//([^/?#]*)', 1))"
_SKIP = "|".join(urls.SKIPPED_EXTENSIONS)
CLASS = (
    f"CASE WHEN regexp_matches(lower({_PATH}), '\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower({_PATH}), '\\.docx?$') THEN 'docx'"
    f" WHEN regexp_matches(lower({_PATH}), '\\.({_SKIP})$') THEN 'skip' ELSE 'html' END"
)
_HREFS = r"""regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


@query(f"SELECT page_id, {CLASS} AS type FROM pages")
def url_classify(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.classify(F.col("url")).alias("type"))


@query(
    f"""SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\\-]*):', 1)) AS scheme, {NETLOC} AS netloc,
    {_PATH} AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages"""
)
def url_parts(spark, sf_dir):
    u = F.col("url")
    return _pages(spark, sf_dir).select(
        "page_id", urls.scheme(u).alias("scheme"), urls.netloc(u).alias("netloc"), urls.path(u).alias("path"), urls.query(u).alias("query"),
        urls.fragment(u).alias("fragment"),
    )


@query(f"SELECT page_id, coalesce(nullif(regexp_extract({_PATH}, '([^/]*)$', 1), ''), url) AS filename FROM pages")
def url_filename(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.filename(F.col("url")).alias("filename"))


@query(f"SELECT page_id, url FROM pages WHERE NOT regexp_matches({_PATH}, '(?i)/fr/') AND (regexp_matches({_PATH}, '(?i)^/en') OR regexp_matches({_PATH}, '(?i)[0-9]$'))")
def url_path_filter(spark, sf_dir):
    return _pages(spark, sf_dir).where(urls.relevant_path(F.col("url"), ("^/en", "[0-9]$"), ("/fr/",))).select("page_id", "url")


@query(f"SELECT 'exclude' AS mode, count(*)::BIGINT AS kept FROM pages WHERE NOT regexp_matches({_PATH}, '(?i)/fr') UNION ALL SELECT 'include', count(*) FROM pages WHERE regexp_matches({_PATH}, '(?i)^/en')")
def url_filter_mode(spark, sf_dir):
    def kept(mode: str) -> DataFrame:
        include, exclude = CrawlConfig(filter_mode=mode, include=("^/en",), exclude=("/fr",)).patterns()
        return _pages(spark, sf_dir).where(urls.relevant_path(F.col("url"), include, exclude)).agg(F.lit(mode).alias("mode"), F.count("*").alias("kept"))

    return kept("include").unionByName(kept("exclude"))


@query(f"SELECT page_id, {NETLOC} = lower('Blog.ththan.example.net') AS same FROM pages")
def same_domain(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.same_domain(F.col("url"), "Blog.ththan.example.net").alias("same"))


@query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def page_title(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", pages_html.raw_title(F.col("html")).alias("title"))


@query(f"SELECT page_id, (i - 1)::INTEGER AS pos, hrefs[i] AS href FROM (SELECT page_id, {_HREFS} AS hrefs FROM pages), LATERAL (SELECT unnest(range(1, len(hrefs) + 1)) AS i)")
def page_links(spark, sf_dir):
    return pages_html.native_links(_pages(spark, sf_dir), keep=("page_id",)).select("page_id", "pos", "href")


@query(
    f"""SELECT page_id, (i - 1)::INTEGER AS pos, CASE WHEN h LIKE '//%' THEN regexp_extract(url, '^([^:/?#]+:)', 1) || h
      WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.\\-]*:') THEN h
      WHEN h LIKE '/%' THEN regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || h END AS target
    FROM (SELECT page_id, url, i, regexp_replace(hrefs[i], '#.*$', '') AS h
      FROM (SELECT page_id, url, {_HREFS} AS hrefs FROM pages), LATERAL (SELECT unnest(range(1, len(hrefs) + 1)) AS i))"""
)
def link_resolve(spark, sf_dir):
    found = _pages(spark, sf_dir).select("page_id", "url", F.posexplode(pages_html.links_of("html", "url")).alias("pos", "target"))
    return found.select("page_id", "pos", "target")


STRIPPED = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _tag in pages_html.REMOVED:
    STRIPPED = f"regexp_replace({STRIPPED}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', chr(10), 'g')"


TEXT = f"""array_to_string(list_filter(list_transform(string_split(regexp_replace(
  regexp_extract({STRIPPED}, '(?is)<article\\b[^>]*>(.*?)</article>', 1), '<[^>]*>', chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> ''), chr(10))"""


def decoded(sql: str) -> str:
    """SQL of a text with the references that the pages hold decoded; the ampersand's comes last."""
    for name, code in (("nbsp", 160), ("lt", 60), ("gt", 62), ("quot", 34), ("#39", 39), ("mdash", 8212), ("ndash", 8211), ("hellip", 8230), ("eacute", 233), ("copy", 169), ("rsquo", 8217), ("amp", 38)):
        sql = f"replace({sql}, '&{name};', chr({code}))"
    return sql


@query(f"SELECT page_id, {TEXT} AS text FROM pages")
def html_text_native(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", pages_html.native_text(F.col("html")).alias("text"))


_TITLE = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"


@query(f"SELECT page_id, coalesce(nullif({decoded(_TITLE)}, ''), url) AS title, {decoded(TEXT)} AS text FROM pages")
def html_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", pages_html.title(F.col("html"), F.col("url")).alias("title"), pages_html.text_of("html").alias("text"))


@query(f"SELECT count(*)::BIGINT AS resources, count(DISTINCT {NETLOC})::BIGINT AS hosts FROM pages WHERE {CLASS} = 'html'")
def resource_summary(spark, sf_dir):
    fetched = _pages(spark, sf_dir).select("url", urls.classify(F.col("url")).alias("type"), F.col("html").alias("body"))
    return pages_html.resources(fetched).agg(F.count("*").alias("resources"), F.countDistinct(urls.netloc(F.col("meta.url"))).alias("hosts"))


_RANKED = f"SELECT {NETLOC} AS site, regexp_replace(url, '/+$', '') AS url, row_number() OVER (PARTITION BY {NETLOC} ORDER BY page_id) - 1 AS r FROM pages"


def _site_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A made link graph (the pages' own links lead nowhere): page r of a site links to 2r + 1, 2r + 2 and to page 0."""
    site = urls.netloc(F.col("url"))
    ranked = _pages(spark, sf_dir).select(site.alias("site"), F.regexp_replace("url", "/+$", "").alias("url"), (F.row_number().over(Window.partitionBy(site).orderBy("page_id")) - 1).alias("r"))
    links = ranked.select("site", F.col("url").alias("src"), F.posexplode(F.array(2 * F.col("r") + 1, 2 * F.col("r") + 2, F.lit(0))).alias("pos", "r"))
    edges = links.join(ranked.withColumnRenamed("url", "dst"), ["site", "r"]).select("src", "dst", "pos")
    return ranked.where("r = 0").select("site", "url"), edges


_CRAWL = f"""WITH RECURSIVE ranked AS ({_RANKED}), walk(site, r, depth) AS (
  SELECT site, r, 0 FROM ranked WHERE r = 0
  UNION SELECT w.site, k.r, w.depth + 1 FROM walk w JOIN ranked k ON k.site = w.site AND k.r IN (2 * w.r + 1, 2 * w.r + 2, 0) WHERE w.depth < 3
), least AS (SELECT site, r, min(depth) AS depth FROM walk GROUP BY ALL), crawled AS (
  SELECT site, url, {CLASS} AS type, depth::INTEGER AS depth, row_number() OVER (PARTITION BY site ORDER BY depth, r) AS seq FROM least JOIN ranked USING (site, r))
"""


@query(f"{_CRAWL} SELECT * FROM crawled")
def crawl_bfs(spark, sf_dir):
    seeds, edges = _site_links(spark, sf_dir)
    return crawling.crawl(seeds, edges, 3)


@query(f"{_CRAWL} SELECT count(*)::BIGINT AS total, count_if(type <> 'skip')::BIGINT AS extractable, count_if(type = 'skip')::BIGINT AS skipped FROM crawled")
def crawl_summary(spark, sf_dir):
    seeds, edges = _site_links(spark, sf_dir)
    return crawling.summary(crawling.crawl(seeds, edges, 3))


@query(f"{_CRAWL} SELECT url FROM crawled WHERE type = 'html'")
def crawl_by_type(spark, sf_dir):
    seeds, edges = _site_links(spark, sf_dir)
    return crawling.of_type(crawling.crawl(seeds, edges, 3), "html")


@query(f"SELECT p.page_id, q.html IS NOT NULL AS fetched FROM pages p LEFT JOIN (SELECT url, html FROM pages WHERE page_id % 3 <> 0) q USING (url)")
def fetch_snapshot(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return web.fetch_snapshot(pages.select("page_id", "url"), pages.where("page_id % 3 <> 0")).select("page_id", F.col("html").isNotNull().alias("fetched"))


@query(f"SELECT page_id, url FROM pages WHERE {NETLOC} <> 'thther.example.org' AND NOT ({NETLOC} = 'blog.ththan.example.net' AND starts_with({_PATH}, '/fr'))")
def robots_filter(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    rules = {"blog.ththan.example.net": "User-agent: *\nDisallow: /fr\nAllow: /", "thther.example.org": "User-agent: *\nDisallow: /"}
    return pages.where(web.robots_allowed(F.col("url"), rules)).select("page_id", "url")


# documents stand for crawled urls, labels for their history: it covers some of them
_HISTORY = "SELECT doc_id AS url, CASE WHEN quality = 1 THEN 'ctx' END AS context, CASE WHEN toxic = 0 THEN 1 ELSE 0 END AS nq FROM labels"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("url"), F.lit("html").alias("type"), F.lit(1).alias("chunks"), F.lit(0.0).alias("ingested_at"),
        F.when(F.col("quality") == 1, "ctx").alias("context"),
        F.when(F.col("toxic") == 0, F.array(F.lit("q?"))).otherwise(F.array().cast("array<string>")).alias("questions"),
    )


def _crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"))


@query("SELECT doc_id::VARCHAR AS url FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def history_new(spark, sf_dir):
    return h.new_urls(_crawled(spark, sf_dir), _history(spark, sf_dir))


@query("SELECT doc_id::VARCHAR AS url FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def history_done(spark, sf_dir):
    return h.known_urls(_crawled(spark, sf_dir), _history(spark, sf_dir))


@query("SELECT doc_id::VARCHAR AS url FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE NOT coalesce(quality = 1, false) OR NOT coalesce(toxic = 0, false))")
def history_backfill(spark, sf_dir):
    return h.unenriched(_crawled(spark, sf_dir), _history(spark, sf_dir))


@query(
    """SELECT coalesce(d.doc_id, l.doc_id)::VARCHAR AS url, CASE WHEN d.doc_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS ingested_at,
    CASE WHEN d.doc_id IS NULL THEN CASE WHEN l.quality = 1 THEN 'ctx' END WHEN d.doc_id % 2 = 0 THEN d.lang END AS context
    FROM (SELECT * FROM documents WHERE doc_id % 3 = 0) d FULL JOIN labels l ON d.doc_id = l.doc_id"""
)
def history_upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id % 3 = 0")
    entries = docs.select(
        F.col("doc_id").cast("string").alias("url"), F.lit("html").alias("type"), F.lit(2).alias("chunks"), F.lit(1.0).alias("ingested_at"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("context"), F.array().cast("array<string>").alias("questions"),
    )
    return h.marked(_history(spark, sf_dir), entries).select("url", "ingested_at", "context")


@query(
    """SELECT l.doc_id::VARCHAR AS url, coalesce(nullif(CASE WHEN d.doc_id % 2 = 0 THEN d.lang ELSE '' END, ''), CASE WHEN l.quality = 1 THEN 'ctx' END) AS context
    FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id"""
)
def history_enrich(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("url"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("context"),
        F.lit(None).cast("array<string>").alias("questions"),
    )
    return h.enriched(_history(spark, sf_dir), found).select("url", "context")


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'new' WHEN l.quality = 1 AND l.toxic = 0 THEN 'done' ELSE 'backfill' END AS status, count(*)::BIGINT AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def ingest_status(spark, sf_dir):
    crawled, past = _crawled(spark, sf_dir), _history(spark, sf_dir)
    behind = h.unenriched(crawled, past).select("url", F.lit("backfill").alias("status"))
    known = h.known_urls(crawled, past).join(behind.select("url"), "url", "left_anti").select("url", F.lit("done").alias("status"))
    new = h.new_urls(crawled, past).select("url", F.lit("new").alias("status"))
    return behind.unionByName(known).unionByName(new).groupBy("status").agg(F.count("*").alias("n"))
