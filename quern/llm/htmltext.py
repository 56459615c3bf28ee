"""Main text of web pages by site template removal.

Every element subtree of a page is hashed; a count per host finds the subtrees that recur across many pages of that
host, and these are deleted.  Copies of a page, which have one text, are put together within each task and after the
shuffle and count as one page, so that recurring means recurring in different articles.  What is left of the element around
all parts of the article (main, article, or containers named as content) without navigation, forms, adverts and comments is its text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow_batches, cut

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>",
    re.DOTALL,
)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PART = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# fixed values: HTML's element classes
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea iframe noscript xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the first closes an open element of the second, within the bounds of the third.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_SCOPE = frozenset("html body table td th caption button article section main div aside nav footer header form ul ol dl blockquote".split())

#: What an article is without.
_DROP_TAGS = frozenset(
    "head script style title nav footer aside form noscript iframe template svg math button select textarea input "
    "dialog menu object embed canvas video audio map noembed noframes datalist".split()
)
_DROP_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist "
    "note status tooltip".split()
)
_DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner "
    "comment comments commentlist disqus respond reply replies discussion sidebar sidebars rail menu menus nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations widget widgets pagination pager skiplink searchbox searchform hidden".split()
)
_NEGATED = frozenset("with has no without non not show hide is".split())
#: A host with a larger part of all pages than one in so many is joined apart.
HOT_SHARE = 200

_MAIN_WORDS = frozenset("content article post entry story main maincontent articlebody".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(source: str) -> Node:
    """A tree of the page: implied end tags, raw elements and stray end tags as browsers take them, roughly."""
    root = Node("#root", "")
    stack, at, n = [root], 0, len(source)
    while at < n:
        token = _TOKEN.search(source, at)
        if token is None:
            stack[-1].children.append(source[at:])
            break
        if token.start() > at:
            stack[-1].children.append(source[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None:
            if source.startswith("<![CDATA[", token.start()):
                stack[-1].children.append(html.escape(token[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if token["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in _BLOCK and stack[i].tag in _SCOPE:
                    break
            continue
        if tag in _BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in _SCOPE:
                    break
        if tag in _IMPLIED:
            closes, bounds = _IMPLIED[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in bounds:
                    break
                if stack[i].tag in closes:
                    del stack[i:]
                    if tag in ("tr", "tbody", "thead", "tfoot"):
                        while len(stack) > 1 and stack[-1].tag in closes:
                            stack.pop()
                    break
        node = Node(tag, token["attrs"])
        stack[-1].children.append(node)
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(source, at)
            node.children.append(source[at : close.start() if close else n])
            at = close.end() if close else n
        elif tag not in _VOID and not token["attrs"].endswith("/"):
            stack.append(node)
    return root


def _attributes(node: Node) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(node.attrs)} if node.attrs else {}


def _names(attributes: dict[str, str]) -> list[list[str]]:
    """The parts of each class and of the id."""
    found = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return [_PART.findall(_CAMEL.sub("-", name).lower()) for name in found.split()]


def _unwanted(node: Node, inside: bool) -> bool:
    """Whether a subtree is no part of an article. inside: it lies in the main element."""
    tag = node.tag
    if tag in _DROP_TAGS:
        return True
    if tag == "header":
        return not inside
    if not node.attrs or tag in ("html", "body", "main", "#root"):
        return False
    attributes = _attributes(node)
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.IGNORECASE):
        return True
    if attributes.get("role", "").lower() in _DROP_ROLES:
        return True
    for parts in _names(attributes):
        if not _NEGATED.intersection(parts) and _DROP_WORDS.intersection(parts):
            return True
    return False


def _kind(node: Node) -> str:
    """Tag, class and role of an element: what pages of one template share; ids, addresses and styles vary from page to page."""
    if not node.attrs:
        return node.tag
    attributes = _attributes(node)
    return f"{node.tag} {' '.join(sorted(attributes.get('class', '').split()))} {attributes.get('role', '')}"


def subtree_hashes(node: Node, out: dict[int, int]) -> int:
    """Hash of a subtree by kind and contents; out gets it by id(node) for every element that holds text or elements."""
    todo: list[tuple[Node, bool]] = [(node, False)]
    hashes: dict[int, int] = {}
    while todo:  # no recursion: pages nest as deep as they like
        at, ready = todo.pop()
        if not ready:
            todo.append((at, True))
            todo.extend((c, False) for c in at.children if not isinstance(c, str))
            continue
        parts = [_kind(at)]
        for c in at.children:
            part = " ".join(c.split()) if isinstance(c, str) else f"<{hashes.pop(id(c)):x}>"
            if part:
                parts.append(part)
        hashes[id(at)] = h = xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) >> 1
        if at.children:
            out[id(at)] = h
    return hashes[id(node)]


def _text_size(node: Node, cache: dict[int, int]) -> int:
    """Code points of wanted text below a node."""
    todo, order = [node], []
    while todo:
        at = todo.pop()
        order.append(at)
        todo.extend(c for c in at.children if not isinstance(c, str) and not _unwanted(c, True))
    for at in reversed(order):
        cache[id(at)] = sum(len(c.strip()) if isinstance(c, str) else cache.get(id(c), 0) for c in at.children)
    return cache[id(node)]


def main_element(root: Node) -> tuple[Node, dict[int, bool]]:
    """The element that holds all parts of the article, and these by id(), with whether the page itself says so.

    Parts are all articles and main elements, or else all elements named as content if their common ancestor holds half
    of the text; a first heading beside marked parts belongs to them.
    """
    wanted, todo, parents = [], [root], {}
    while todo:
        at = todo.pop()
        if at.tag != "#root" and _unwanted(at, False):
            continue
        wanted.append(at)
        for c in at.children:
            if not isinstance(c, str):
                parents[id(c)] = at
                todo.append(c)
    sizes: dict[int, int] = {}
    _text_size(root, sizes)
    size = lambda x: sizes.get(id(x), 0)

    def common(nodes: list[Node]) -> Node:
        path: list[Node] = []
        for k, x in enumerate(nodes):
            up = [x]
            while id(up[-1]) in parents:
                up.append(parents[id(up[-1])])
            up.reverse()
            path = up if not k else [p for p, q in zip(path, up) if p is q]
        return path[-1]

    marks = [
        x for x in wanted if size(x) and (
            x.tag in ("article", "main") or x.attrs and (
                "articleBody" in (found := _attributes(x)).get("itemprop", "") or found.get("role", "") in ("main", "article")
            )
        )
    ]
    if marks:
        return common(marks + [x for x in wanted if x.tag == "h1" and size(x)]), {id(x): True for x in marks}
    named = [x for x in wanted if x.attrs and size(x) and any(_MAIN_WORDS.intersection(p) for p in _names(_attributes(x)))]
    body = next((x for x in wanted if x.tag == "body"), root)
    if named:
        least = common(named)
        if 2 * size(least) >= size(root):
            return least, {id(x): False for x in named}
    return body, {id(body): False}


def blocks(root: Node, templates: frozenset[int], sure: frozenset[int]) -> list[str]:
    """The text blocks of the main element, without unwanted and recurring subtrees.

    Inside an element that the page marks as its article, only subtrees that recur on most pages of a host go: there
    a passage may recur because articles share it.
    """
    main, parts = main_element(root)
    hashes: dict[int, int] = {}
    if templates or sure:
        subtree_hashes(main, hashes)
        hashes.pop(id(main), None)
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append(text)
        held.clear()

    inside, marked = id(main) in parts, parts.get(id(main), False)
    todo: list[tuple[Node | str | None, bool, bool]] = [(main, inside, marked)]  # in a part, in a marked one
    while todo:
        at, inside, marked = todo.pop()
        if at is None:
            flush()
        elif isinstance(at, str):
            held.append(html.unescape(at) if "&" in at else at)
        elif at.tag == "br":
            held.append(" ")
        else:
            if id(at) in parts:
                inside, marked = True, marked or parts[id(at)]
            if at is not main and (_unwanted(at, inside) or hashes.get(id(at)) in (sure if marked else templates)):
                continue
            if at.tag in _BLOCK:
                flush()
                todo.append((None, inside, marked))
            if at.tag in ("img", "wbr") or at.tag in _RAW:
                continue
            todo.extend((c, inside, marked) for c in reversed(at.children))
    flush()
    return out


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def host_templates(pages: DataFrame, least: int = 4, share: float = 0.5, sure_least: int = 10, sure_share: float = 0.6) -> DataFrame:
    """host, pages, rows, templates, sure: hashes of subtrees that recur on at least max(least, share * pages) pages of the host.

    Pages whose main element has the same text are copies and count as one page; rows counts them all.  At most 1 / share times the subtrees of a page recur so, which bounds the arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            names, contents = zip(*held) if held else ((), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(contents, pa.int64()), pa.array([r[0] for r in held.values()], pa.int64()),
                 pa.array([list(r[1]) for r in held.values()], pa.list_(pa.int64()))],
                names=["host", "content", "n", "hashes"],
            )

        for batch in batches:
            for name, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = parse(source.as_py() or "")
                text = "\n".join(blocks(page, frozenset(), frozenset()))
                found: dict[int, int] = {}
                subtree_hashes(page, found)
                row = held.setdefault((name, xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1), [0, set()])
                size -= len(row[1])
                row[0] += 1
                row[1].update(found.values())
                size += len(row[1])
            if size > 100_000:
                yield rows()
                held.clear()
                size = 0
        yield rows()

    counted = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, content long, n long, hashes array<long>")
    # pages of one text are copies, and what they have counts once; a task sends one row for each text that it has seen
    counted = counted.groupBy("host", "content").agg(F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("hashes"))).alias("hashes"))
    counted = counted.select("host", "n", F.explode(F.concat(F.array(F.lit(-1).cast("long")), "hashes")).alias("hash"))
    counted = counted.groupBy("host", "hash").agg(F.count("*").alias("n"), F.sum("n").alias("rows"))
    # a hash of -1 counts the host's texts; both shares are of that count, so one pass over the sums is enough
    frequent = cut(counted.where(f"n >= {least} or hash = -1"))
    total = frequent.where("hash = -1").select("host", F.col("n").alias("pages"), "rows")
    found = frequent.where("hash <> -1").select("host", "hash", "n").join(total, "host").where(F.col("n") >= F.lit(share) * F.col("pages"))
    certain = (F.col("n") >= sure_least) & (F.col("n") >= F.lit(sure_share) * F.col("pages"))
    found = found.groupBy("host").agg(F.collect_list("hash").alias("templates"), F.collect_list(F.when(certain, F.col("hash"))).alias("sure"))
    return total.join(found, "host", "left")


def extract(pages: DataFrame, **parameters) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html; others are ignored, whatever their names).

    A null or empty html gives an empty text; a null or odd url belongs to the host ""; an empty table gives no rows.
    Rows of one host that repeat a page's text count as one page, each is extracted by itself, null ids too.  Character
    references are decoded, white space inside a block becomes one space, blocks are joined by \\n.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, templates, sure in zip(batch.column(2), batch.column(3), batch.column(4)):
                page = parse(source.as_py() or "")
                texts.append("\n".join(blocks(page, frozenset(templates.as_py() or ()), frozenset(sure.as_py() or ()))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    arrow_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    templates = cut(host_templates(rows, **parameters))
    rows = rows.withColumn("host", host(F.col("url")))
    # hosts with at least one in HOT_SHARE of all pages, so no more than HOT_SHARE hosts, are joined without a shuffle
    every = templates.agg(F.sum("rows").alias("n")).first()["n"] or 0
    hot = templates.where(F.col("rows") * HOT_SHARE >= every)
    names = [r["host"] for r in hot.select("host").collect()]
    columns = ["host", "templates", "sure"]
    is_hot = F.col("host").isin(names) if names else F.lit(False)
    joined = rows.where(~is_hot).join(templates.where(~is_hot).where("templates is not null").select(*columns), "host", "left").unionByName(
        rows.where(is_hot).join(F.broadcast(hot.select(*columns)), "host", "left")
    )
    return joined.select("page_id", "url", "html", "templates", "sure").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
