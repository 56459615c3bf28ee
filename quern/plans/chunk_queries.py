"""Queries over chunkers.  Their SQL walks windows by recursion over prefix sums of piece lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import chunking
from quern.plans.corpus_queries import HEADER, SENTENCES
from quern.plans.registry import query, table
from quern.plans.url_queries import TEXT, decoded

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160)"
#: Of a text and the first separator that it may use: which one it uses (the fifth cuts anywhere).
_SEP = (
    "CASE WHEN k <= 1 AND contains(t, chr(10) || chr(10)) THEN 1 WHEN k <= 2 AND contains(t, chr(10)) THEN 2"
    " WHEN k <= 3 AND contains(t, '. ') THEN 3 WHEN k <= 4 AND contains(t, ' ') THEN 4 ELSE 5 END"
)
#: Pieces of the rows of work, each but the first with its separator in front.
_PIECES = f"""SELECT id, ord, sep, j, p[j] AS piece FROM (SELECT id, ord, sep, p, unnest(range(1, len(p) + 1)) AS j FROM (
    SELECT id, ord, sep, list_filter(list_concat([a[1]], list_transform(a[2:], lambda x: d || x)), lambda x: x <> '') AS p FROM (
      SELECT id, ord, sep, d, string_split(t, d) AS a FROM (
        SELECT id, ord, t, sep, [chr(10) || chr(10), chr(10), '. ', ' ', ''][sep] AS d FROM (SELECT *, {_SEP} AS sep FROM work)))))"""
#: How far a window from piece `a` (counted from 0) reaches in sums c, and where the next one begins.
_REACH = "greatest({a} + 1, len(list_filter(c, lambda x: x - c[{a} + 1] <= 1000)) - 1)"
_NEXT = "least(b, greatest(a, len(list_filter(c, lambda x: x < greatest(c[b + 1] - 200, c[b + 2] - 1000)))))"


def _fixed(source: str) -> str:
    """CTEs up to fixed(id, key, a, chunk): texts of source (id, ord list, t) cut by size."""
    return f"""work(id, ord, t, k) AS (SELECT id, ord, t, 1 FROM ({source})
  UNION ALL SELECT id, list_append(ord, j), piece, sep + 1 FROM ({_PIECES}) WHERE length(piece) >= 1000 AND sep < 5),
pieces AS ({_PIECES}),
marked AS (SELECT *, length(piece) >= 1000 AND sep < 5 AS big, sum((length(piece) >= 1000 AND sep < 5)::INT) OVER (PARTITION BY id, ord ORDER BY j) AS run FROM pieces),
summed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY id, ord, run ORDER BY j) AS c FROM marked WHERE NOT big),
runs AS (SELECT id, list_append(ord, min(j)) AS key, list(piece ORDER BY j) AS p, list_concat([0], list(c::BIGINT ORDER BY j)) AS c FROM summed GROUP BY id, ord, run),
walk(id, key, p, c, a, b) AS (SELECT id, key, p, c, 0, {_REACH.format(a='0')} FROM runs
  UNION ALL SELECT id, key, p, c, a, {_REACH.format(a='a')} FROM (SELECT id, key, p, c, {_NEXT} AS a FROM walk WHERE b < len(p))),
fixed AS (SELECT id, key, a, trim(array_to_string(p[a + 1:b], ''), {_BLANK}) AS chunk FROM walk)"""


_FIXED = _fixed("SELECT doc_id AS id, []::BIGINT[] AS ord, text AS t FROM documents WHERE text <> ''")
_SECTIONS = f"""sections AS (SELECT page_id AS id, [i]::BIGINT[] AS ord, h[i] || chr(10) || trim(b[i + 1], {_BLANK}) AS t FROM (SELECT page_id, regexp_extract_all(html, '{HEADER}') AS h,
  string_split(regexp_replace(html, '{HEADER}', chr(1), 'g'), chr(1)) AS b FROM pages), LATERAL (SELECT unnest(range(1, len(h) + 1)) AS i))"""
_SEMANTIC = f"""cut AS (SELECT doc_id, source, s, list_transform(range(0, len(s) + 1), lambda i: coalesce(list_sum(list_transform(s[1:i], lambda x: length(x) + 1)), 0)::BIGINT) AS c
  FROM (SELECT doc_id, source, {SENTENCES} AS s FROM documents) WHERE len(s) > 0),
walk(doc_id, source, s, c, idx, a, b) AS (SELECT doc_id, source, s, c, 0, 0, greatest(1, len(list_filter(c, lambda x: x - 1 <= 1000)) - 1) FROM cut
  UNION ALL SELECT doc_id, source, s, c, idx + 1, a, greatest(a + 1, len(list_filter(c, lambda x: x - c[a + 1] - 1 <= 1000)) - 1)
  FROM (SELECT doc_id, source, s, c, idx, greatest(a + 1, b - 2) AS a FROM walk WHERE b < len(s)))"""

#: The semantic chunks of pages: chunked(page_id, url, idx, chunk).
SEMANTIC_PAGES = (
    _SEMANTIC.replace("doc_id", "page_id").replace("source", "url").replace("FROM documents", f"FROM (SELECT page_id, url, {decoded(TEXT)} AS text FROM pages)")
    + ",\nchunked AS (SELECT page_id, url, idx, array_to_string(s[a + 1:b], chr(10)) AS chunk FROM walk)"
)


def _chunked(spark, sf_dir, strategy: str) -> DataFrame:
    return chunking.chunks(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text", chunking.splitter(strategy))


@query(f"WITH RECURSIVE {_FIXED} SELECT id AS doc_id, (row_number() OVER (PARTITION BY id ORDER BY key, a) - 1)::INTEGER AS chunk_idx, chunk FROM fixed WHERE chunk <> ''")
def chunk_fixed(spark, sf_dir):
    return _chunked(spark, sf_dir, "fixed_size").select("doc_id", "chunk_idx", "chunk")


@query(f"WITH RECURSIVE {_SEMANTIC} SELECT doc_id, idx::INTEGER AS chunk_idx, array_to_string(s[a + 1:b], chr(10)) AS chunk FROM walk")
def chunk_semantic(spark, sf_dir):
    return _chunked(spark, sf_dir, "semantic").select("doc_id", "chunk_idx", "chunk")


@query(
    f"""WITH RECURSIVE {_SECTIONS}, {_fixed('SELECT * FROM sections WHERE length(t) > 1000')},
    every AS (SELECT id, key, a, chunk FROM fixed WHERE chunk <> '' UNION ALL SELECT id, ord, 0, t FROM sections WHERE length(t) <= 1000)
    SELECT id AS page_id, (row_number() OVER (PARTITION BY id ORDER BY key, a) - 1)::INTEGER AS chunk_idx, chunk FROM every"""
)
def chunk_header(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return chunking.chunks(pages, "html", chunking.splitter("header_based")).select("page_id", "chunk_idx", "chunk")


@query(f"WITH RECURSIVE {_SEMANTIC} SELECT source, count(*)::BIGINT AS chunks, sum(length(array_to_string(s[a + 1:b], chr(10))))::BIGINT AS chars FROM walk GROUP BY 1")
def chunks_per_url(spark, sf_dir):
    return _chunked(spark, sf_dir, "semantic").groupBy("source").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"))


@query(
    f"""WITH RECURSIVE {_FIXED} SELECT doc_id, 'doc ' || doc_id AS url, 'web' AS type, count(*)::BIGINT AS chunks, md5(string_agg(chunk, chr(1) ORDER BY key, a)) AS digest
    FROM fixed JOIN documents d ON d.doc_id = id WHERE chunk <> '' GROUP BY doc_id"""
)
def chunk_metadata(spark, sf_dir):
    """Every chunk of a resource carries the resource's metadata; any name but the two others chooses the fixed splitter."""
    meta = F.struct(F.concat(F.lit("doc "), F.col("doc_id")).alias("url"), F.lit("web").alias("type"))
    docs = table(spark, sf_dir, "documents").select("doc_id", meta.alias("meta"), "text")
    rows = chunking.chunks(docs, "text", chunking.splitter("whatever"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk"))), lambda x: x["chunk"]), "\u0001")
    return rows.groupBy("doc_id", "meta").agg(F.count("*").alias("chunks"), F.md5(listed).alias("digest")).select("doc_id", "meta.url", "meta.type", "chunks", "digest")
