"""Breadth-first crawling over a table of links, for any number of sites at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import cut
from quern.functions import urls

Predicate = Callable[[Column], Column]


def link_table(pages: DataFrame) -> DataFrame:
    """src, dst, pos from fetched pages (url, html); a page that wasn't fetched has no row and so no links."""
    from quern.operators.html import links_of

    return pages.select(F.col("url").alias("src"), F.posexplode(links_of("html", "url")).alias("pos", "dst")).select("src", "dst", "pos")


def crawl(
    seeds: DataFrame, edges: DataFrame, max_depth: int, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (),
    allowed: Predicate | None = None,
) -> DataFrame:
    """site, url, type, depth, seq: every url once, at its least depth, in order of discovery.

    seeds: site, url (a trailing slash is dropped); a site's domain is its seed's.  edges: src, dst, pos.  Each level is
    one join of the frontier with the links; a url counts where the first page of the frontier names it first.  Only
    html below max_depth is expanded.  A url that the path filter or `allowed` (robots) rejects is neither returned nor
    expanded.  The lineage is cut at each level.
    """
    ok = urls.relevant_path(F.col("url"), include, exclude)
    if allowed is not None:
        ok = ok & allowed(F.col("url"))
    start = seeds.select("site", F.regexp_replace("url", "/+$", "").alias("url")).dropDuplicates(["site"])
    domains = start.select("site", urls.netloc(F.col("url")).alias("domain"))
    level = start.where(ok).select("site", "url", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("seq"))
    found = level = cut(level)
    for depth in range(1, max_depth + 1):
        expanded = level.where(urls.classify(F.col("url")) == "html")
        named = expanded.join(edges, expanded["url"] == edges["src"]).select("site", F.col("dst").alias("url"), F.col("seq").alias("parent"), "pos")
        named = named.join(domains, "site").where(urls.netloc(F.col("url")) == F.col("domain")).where(ok)
        first = named.groupBy("site", "url").agg(F.min(F.struct("parent", "pos")).alias("at"))
        fresh = first.join(found.select("site", "url"), ["site", "url"], "left_anti")
        before = found.groupBy("site").agg(F.max("seq").alias("last"))
        order = Window.partitionBy("site").orderBy("at.parent", "at.pos")
        level = cut(
            fresh.join(before, "site").select("site", "url", F.lit(depth).alias("depth"), (F.col("last") + F.row_number().over(order)).alias("seq"))
        )
        if level.isEmpty():
            break
        found = cut(found.unionByName(level))
    return found.select("site", "url", urls.classify(F.col("url")).alias("type"), "depth", "seq")


def summary(crawled: DataFrame) -> DataFrame:
    return crawled.agg(
        F.count("*").alias("total"), F.count_if(F.col("type") != "skip").alias("extractable"), F.count_if(F.col("type") == "skip").alias("skipped")
    )


def of_type(crawled: DataFrame, kind: str) -> DataFrame:
    return crawled.where(F.col("type") == kind).select("url")


def extractable(crawled: DataFrame) -> DataFrame:
    return crawled.where(F.col("type").isin(*urls.EXTRACTABLE))
