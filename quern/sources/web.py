"""The web as a source: a snapshot table, robots rules, and an optional fetcher."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import urls

AGENT = "Mozilla/5.0 (compatible; quern/1.0)"


def fetch_snapshot(wanted: DataFrame, snapshot: DataFrame) -> DataFrame:
    """wanted (url, ...) with the snapshot's html; null where a page is missing, as after a failed request."""
    return wanted.join(snapshot.select("url", "html"), "url", "left")


def fetch_live(wanted: DataFrame, get: Callable[[str], bytes], delay: float = 1.0) -> DataFrame:
    """url, body: each task requests its urls one after the other with a pause between; failures give null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        first = True
        for batch in batches:
            bodies = []
            for url in batch["url"]:
                if not first:
                    time.sleep(delay)
                first = False
                try:
                    bodies.append(get(url))
                except Exception:  # noqa: BLE001  whatever a client raises, the page counts as not fetched
                    bodies.append(None)
            yield pd.DataFrame({"url": batch["url"], "body": bodies})

    return wanted.select("url").mapInPandas(run, "url string, body binary")


def robots_allowed(url: Column, robots: dict[str, str], agent: str = AGENT) -> Column:
    """Whether a host's robots text lets the agent fetch a url; a host without one allows everything.

    The standard library decides: of the agent only the part before the first slash counts, and the first rule that
    matches wins.  robots: by network location; one entry per crawled site.
    """
    parsers: dict[str, RobotFileParser] = {}

    @F.pandas_udf("boolean")
    def run(found: pd.Series) -> pd.Series:
        from urllib.parse import urlparse

        def one(u: str | None) -> bool:
            host = urlparse(u or "").netloc.lower()
            if host not in robots:
                return True
            if host not in parsers:
                parsers[host] = RobotFileParser()
                parsers[host].parse(robots[host].splitlines())
            return parsers[host].can_fetch(agent, u)

        return found.map(one)

    return run(url)


def with_allowed(wanted: DataFrame, robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """wanted (url, ...) with allowed, by a table of fetched robots texts (host, robots), a row per host.

    A host that the table lacks, or whose text is null because fetching failed, allows everything.  A worker parses a
    text once for each batch in which it comes.
    """

    @F.pandas_udf("boolean")
    def run(urls_: pd.Series, texts: pd.Series) -> pd.Series:
        parsers: dict[str, RobotFileParser] = {}

        def one(url: str | None, text: str | None) -> bool:
            if text is None or url is None:
                return True
            if text not in parsers:
                parsers[text] = RobotFileParser()
                parsers[text].parse(text.splitlines())
            return parsers[text].can_fetch(agent, url)

        return pd.Series([one(u, t) for u, t in zip(urls_, texts)], dtype=bool)

    others = [F.col(f"`{c}`") for c in wanted.columns if c != "allowed"]
    joined = wanted.select(*others, urls.netloc(F.col("url")).alias("host_")).join(robots.select(F.col("host").alias("host_"), F.col("robots").alias("robots_")), "host_", "left")
    return joined.select(*others, run(F.col("url"), F.col("robots_")).alias("allowed"))
