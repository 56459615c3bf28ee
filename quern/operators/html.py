"""HTML to text: a parser-backed extractor, and a native one for pages that are well formed."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quern.functions import urls

# fixed values: subtrees that aren't text, and elements without an end
REMOVED = ("script", "style", "nav", "header", "footer", "aside", "form", "noscript", "iframe")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Tree(HTMLParser):
    """Open elements and text nodes, as a lenient parser sees them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.removed = 0
        #: (root number or 0, text) of each text node; roots are numbered as they begin.
        self.texts: dict[str, list[str]] = {"main": [], "article": [], "body": []}
        self.inside = {"main": 0, "article": 0, "body": 0}
        self.done = {"main": False, "article": False, "body": False}
        self.links: list[str] = []
        self.title: list[str] | None = None
        self.title_done = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v is not None][:1]
        if tag in _VOID:
            return
        self.open.append(tag)
        if tag in REMOVED:
            self.removed += 1
        if tag == "title" and not self.title_done:
            self.title = []
        if tag in self.inside and not self.removed and not self.done[tag]:
            self.inside[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while self.open:
            top = self.open.pop()
            if top in REMOVED:
                self.removed -= 1
            if top == "title" and self.title is not None:
                self.title_done = True
            if top in self.inside and not self.removed and self.inside[top]:
                self.inside[top] -= 1
                self.done[top] = self.done[top] or not self.inside[top]
            if top == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.title is not None and not self.title_done and self.open and self.open[-1] == "title":
            self.title.append(data)
        if not self.removed:
            for root, depth in self.inside.items():
                if depth:
                    self.texts[root].append(data)

    def started(self, root: str) -> bool:
        return self.done[root] or self.inside[root] > 0


def page_text(html: str | None) -> str:
    """Text of the first main, else the first article, else the body; each text node is a line, blank ones go."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    for root in ("main", "article", "body"):
        if tree.started(root):
            lines = [line.strip() for node in tree.texts[root] for line in node.split("\n")]
            return "\n".join(line for line in lines if line)
    return ""


def page_links(html: str | None, base: str) -> list[str]:
    """Absolute targets of all anchors in page order, repeats kept, fragments dropped."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    out = []
    for href in tree.links:
        try:
            out.append(urldefrag(urljoin(base, href.strip())).url)
        except ValueError:
            continue
    return out


@F.pandas_udf(StringType())
def text_of(html: pd.Series) -> pd.Series:
    return html.map(page_text)


@F.pandas_udf(ArrayType(StringType()))
def links_of(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([page_links(h, b) if b is not None else [] for h, b in zip(html, base)])


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    import html as escapes

    return text.map(lambda t: None if t is None else escapes.unescape(t))


def native_text(html: Column) -> Column:
    """The same for well-formed pages with one article or body, without a parser; references stay as they are."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "")
    for tag in REMOVED:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "\n")
    inner = F.coalesce(
        *[F.nullif(F.regexp_extract(out, rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1), F.lit("")) for t in ("main", "article")],
        F.nullif(F.regexp_extract(out, r"(?is)<body\b[^>]*>(.*)", 1), F.lit("")), F.lit(""),
    )
    lines = F.split(F.regexp_replace(inner, "<[^>]*>", "\n"), "\n")
    stripped = F.transform(lines, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(stripped, lambda s: s != ""), "\n")


def raw_title(html: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"(?U)^\s+|\s+$", "")


def title(html: Column, url: Column) -> Column:
    """The page's title with references decoded, or its url."""
    return F.coalesce(F.nullif(_unescaped(raw_title(html)), F.lit("")), url)


def native_links(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """url, pos, href, target of double-quoted anchors, in page order, with columns that tell apart pages of one url."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r"(?i)<a\s[^>]*?href=\"([^\"]*)\""), F.lit(1))
    rows = pages.select(url, *keep, F.posexplode(hrefs).alias("pos", "href"))
    return rows.withColumn("target", urls.resolve(F.col("href"), F.col(url)))


Extractor = Callable[[Column], Column]


def web_text(html: Column, first: Extractor | None = None, fallback: Extractor = text_of) -> Column:
    """A preferred extractor's text, or the fallback's where that gives nothing."""
    if first is None:
        return fallback(html)
    return F.coalesce(F.nullif(first(html), F.lit("")), fallback(html))


def resources(fetched: DataFrame, extractors: dict[str, Extractor] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """text and meta(source, filename, type, page, url) of fetched rows (url, type, body); failures and blanks go.

    keep: columns of fetched that go along, as a url may have several rows.

    extractors: by type, from body to text; html is built in.  A type without one has no rows, as has a body that its
    extractor turns to null.
    """
    by_type = {"html": text_of} | (extractors or {})
    text = F.lit(None).cast("string")
    for kind, extract in by_type.items():
        text = F.when(F.col("type") == kind, extract(F.col("body"))).otherwise(text)
    name = F.when(F.col("type") == "html", title(F.col("body"), F.col("url"))).otherwise(urls.filename(F.col("url")))
    meta = F.struct(
        F.col("url").alias("source"), name.alias("filename"),
        F.when(F.col("type") == "html", "web").otherwise(F.col("type")).alias("type"), F.lit(0).alias("page"), "url",
    )
    out = fetched.withColumn("text", text)
    return out.where(F.col("text").isNotNull() & (F.regexp_replace("text", r"(?U)\s+", "") != "")).select("url", *keep, "text", meta.alias("meta"))
