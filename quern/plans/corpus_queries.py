"""Queries over documents and conversations: cleaning, chunking, ids, the store, text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import present, text, urls
from quern.operators import chunking, cleaning, models
from quern.plans.registry import query, table
from quern.sources import files
from quern.sources.store import last_of_each, upserted, with_ids


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source stands for a paged document, its documents for the pages."""
    return _docs(spark, sf_dir).select(
        F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")
    )


_LINES = """lines AS (SELECT source AS doc, doc_id AS page, i AS line_no, trim(parts[i]) AS line
  FROM (SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)),
total AS (SELECT source AS doc, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1),
repeated AS (SELECT doc, line, count(DISTINCT page) AS pages FROM lines WHERE line <> '' GROUP BY ALL
  HAVING count(DISTINCT page) >= 2)"""
_NUMBER = "regexp_matches(line, '^(?:[-–—]?\\s*\\d+\\s*[-–—]?|[Pp]age\\s+\\d+(?:\\s+of\\s+\\d+)?)$')"
_FLAGGED = "flagged AS (SELECT r.doc, r.line, r.pages FROM repeated r JOIN total t USING (doc) WHERE r.pages >= greatest(2, floor(t.n * 0.4::DOUBLE)))"
_BODY = f"body AS (SELECT l.* FROM lines l WHERE line <> '' AND NOT {_NUMBER} AND NOT EXISTS (SELECT 1 FROM flagged f WHERE f.doc = l.doc AND f.line = l.line))"


#: A host stands for a paged document, its pages for the pages: their lines of markup repeat.
_PAGED = _LINES.replace("source", "host").replace("doc_id", "page_id").replace("text", "html").replace(
    "FROM documents", "FROM (SELECT lower(regexp_extract(url, '^(?:[^:/?#]+:)?//([^/?#]*)', 1)) AS host, page_id, replace(html, '<', chr(10) || '<') AS html FROM pages)"
)


@query(f"WITH {_PAGED}, {_FLAGGED} SELECT doc, line, pages::BIGINT AS pages FROM flagged")
def repeated_lines(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(urls.netloc(F.col("url")).alias("doc"), F.col("page_id").alias("page"), F.posexplode(F.split(F.replace("html", F.lit("<"), F.lit("\n<")), "\n", -1)).alias("line_no", "line"))
    return cleaning.repeated_lines(pages)


@query(f"WITH {_LINES}, {_FLAGGED}, {_BODY} SELECT doc, page, (line_no - 1)::INTEGER AS line_no, line FROM body")
def strip_repeated_lines(spark, sf_dir):
    return cleaning.body_lines(_lines(spark, sf_dir)).select("doc", "page", "line_no", "line")


@query(f"WITH {_LINES} SELECT doc, count_if({_NUMBER})::BIGINT AS numbers, count(*)::BIGINT AS n FROM (SELECT doc, line FROM lines UNION ALL SELECT doc, regexp_extract(line, '([0-9]+)', 1) FROM lines) GROUP BY 1")
def page_number_lines(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    both = lines.select("doc", "line").unionByName(lines.select("doc", F.regexp_extract("line", "([0-9]+)", 1).alias("line")))
    return both.groupBy("doc").agg(F.count_if(cleaning.is_page_number(F.col("line"))).alias("numbers"), F.count("*").alias("n"))


@query(
    f"""WITH {_LINES}, {_FLAGGED}, {_BODY}, pages AS (SELECT doc, page, string_agg(line, chr(10) ORDER BY line_no) AS text FROM body GROUP BY ALL)
    SELECT doc, md5(string_agg(text, chr(10) || chr(10) ORDER BY page)) AS digest FROM pages GROUP BY doc"""
)
def page_join(spark, sf_dir):
    return cleaning.joined_pages(cleaning.body_lines(_lines(spark, sf_dir))).select("doc", F.md5("text").alias("digest"))


@query(
    f"""WITH {_LINES} SELECT doc, page, (line_no - 1)::INTEGER AS line_no FROM lines JOIN
    (SELECT doc AS d, page AS p, count(*) AS n FROM lines GROUP BY ALL) ON d = doc AND p = page WHERE (line_no - 1) >= 0.08::DOUBLE * n AND line_no <= 0.92::DOUBLE * n"""
)
def page_crop(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    height = lines.groupBy("doc", "page").agg(F.count("*").alias("height"))
    placed = lines.join(height, ["doc", "page"]).withColumns({"top": F.col("line_no"), "bottom": F.col("line_no") + 1})
    return cleaning.cropped(placed).select("doc", "page", "line_no")


@query(
    """WITH body AS (SELECT doc_id, i AS no, trim(parts[i]) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)),
    marginal AS (SELECT doc_id, trim(string_split(text, chr(10))[1]) AS text FROM documents)
    SELECT doc_id AS doc, string_agg(text, chr(10) || chr(10) ORDER BY no) AS text FROM body b WHERE text <> '' AND NOT EXISTS
    (SELECT 1 FROM marginal m WHERE m.doc_id = b.doc_id AND m.text = b.text) GROUP BY 1"""
)
def header_footer_subtraction(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    body = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("no", "text"))
    first = docs.select(F.col("doc_id").alias("doc"), F.get(F.split("text", "\n", -1), F.lit(0)).alias("text"))
    return cleaning.without_header_footer(body, first)


_PIECES = r"string_split(regexp_replace(text, '([.!?\x{2026}\x{203C}\x{2047}-\x{2049}])\s+(\p{Lu})', '\1' || chr(1) || '\2', 'g'), chr(1))"
SENTENCES = f"list_filter(list_transform({_PIECES}, lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"


@query(f"SELECT doc_id, (i - 1)::INTEGER AS pos, s[i] AS sentence FROM (SELECT doc_id, {SENTENCES} AS s FROM documents), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)")
def sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence"))


@query(f"SELECT doc_id, len({SENTENCES})::INTEGER AS n FROM documents")
def sentence_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(text.sentences(F.col("text"))).alias("n"))


HEADER = "(?i)(?:" + "|".join(f"<h{k}[^>\\n]*>[^\\n]*?</h{k}>" for k in range(1, 7)) + ")"


@query(
    f"""SELECT page_id, (i - 1)::INTEGER AS pos, h[i] AS header, trim(b[i + 1]) AS body FROM (SELECT page_id, regexp_extract_all(html, '{HEADER}') AS h,
    string_split(regexp_replace(html, '{HEADER}', chr(1), 'g'), chr(1)) AS b FROM pages), LATERAL (SELECT unnest(range(1, len(h) + 1)) AS i)"""
)
def header_sections(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(chunking.header_sections(F.col("html"))).alias("pos", "s"))
    return rows.select("page_id", "pos", "s.header", "s.body")


@query(f"SELECT count(*)::BIGINT AS chunks, count(DISTINCT doc_id)::BIGINT AS docs FROM (SELECT doc_id, {SENTENCES} AS s FROM documents), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)")
def chunk_totals(spark, sf_dir):
    rows = chunking.chunks(_docs(spark, sf_dir).select("doc_id", "text"), "text", text.sentences)
    return rows.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"))


@query("SELECT doc_id, md5(text) AS id FROM documents")
def content_id(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.content_id(F.col("text")).alias("id"))


_IDS = "SELECT doc_id, text, source, md5(text) || CASE WHEN t > 1 THEN '-' || (t - 1) ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) AS t FROM documents)"


@query(f"SELECT doc_id, id FROM ({_IDS})")
def chunk_ids(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", "source", F.col("text").alias("document"))
    return with_ids(rows, "source", ["doc_id"]).select("doc_id", "id")


@query(
    f"""WITH ids AS ({_IDS}), old AS (SELECT id, max(doc_id) AS doc_id FROM ids WHERE doc_id % 2 = 0 GROUP BY 1), new AS (SELECT id, max(doc_id) AS doc_id FROM ids WHERE doc_id % 2 = 1 GROUP BY 1)
    SELECT id, doc_id FROM new UNION ALL SELECT id, doc_id FROM old WHERE id NOT IN (SELECT id FROM new)"""
)
def upsert_last_wins(spark, sf_dir):
    rows = with_ids(_docs(spark, sf_dir).select("doc_id", "source", F.col("text").alias("document")), "source", ["doc_id"])
    old = last_of_each(rows.where("doc_id % 2 = 0"), ["doc_id"]).select("id", "doc_id")
    new = last_of_each(rows.where("doc_id % 2 = 1"), ["doc_id"]).select("id", "doc_id")
    return upserted(old, new)


@query("SELECT md5(text) AS id, count(*)::BIGINT AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    grouped = _docs(spark, sf_dir).groupBy(text.content_id(F.col("text")).alias("id"))
    return grouped.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("SELECT conv_id, turn, 'passage: ' || text AS passage, 'query: ' || text AS query FROM conversations")
def prefix_passage(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", text.prefixed(F.col("text"), "passage: ").alias("passage"), text.prefixed(F.col("text"), "query: ").alias("query"))


_SNIPPET = r"substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 6000)"


@query(f"SELECT doc_id, {_SNIPPET} AS snippet FROM documents")
def ws_snippet(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.collapse(F.col("text")).alias("snippet"))


@query(f"SELECT doc_id, 'URL ' || source || ' TITLE ' || source || ' TEXT ' || {_SNIPPET} || ' {{}}' AS prompt FROM documents")
def prompt_render(spark, sf_dir):
    made = text.prompt(F.col("source"), F.lit(""), F.col("text"), "URL {url} TITLE {title} TEXT {text} {{}}")
    return _docs(spark, sf_dir).select("doc_id", made.alias("prompt"))


@query(
    """SELECT conv_id, turn, CASE WHEN trim(text, ' ' || chr(10)) <> '' THEN text END AS context, list_filter([role, upper(role)], lambda q: q <> '') AS questions FROM conversations
    WHERE turn % 3 <> 2 UNION ALL SELECT conv_id, turn, NULL, NULL FROM conversations WHERE turn % 3 = 2"""
)
def llm_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    body = F.to_json(F.struct(F.col("text").alias("context"), F.array(F.concat(F.lit(" "), F.col("role")), F.lit(" "), F.upper("role"), F.lit("third")).alias("questions")))
    raw = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" done.")))
        .otherwise("[1, 2]")
    )
    return rows.select("conv_id", "turn", text.parse_generated(raw).alias("p")).select("conv_id", "turn", "p.context", "p.questions")


@query("SELECT event_id, strftime(ts, '%H:%M') AS clock, epoch_us(ts)::BIGINT AS micros FROM events")
def clock_label(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", present.clock(F.col("ts")).alias("clock"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))


@query(
    """SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '…' ELSE text END AS preview,
    CASE WHEN length(source) > 4 THEN substring(source, 1, 4) || '…' ELSE source END AS label, CASE WHEN doc_id > 0 THEN 'p. ' || doc_id ELSE '' END AS page,
    least(greatest(coalesce(try_cast(substring(source, 4) AS INTEGER), 5), 1), 50)::INTEGER AS k FROM documents"""
)
def result_labels(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", present.preview(F.col("text")).alias("preview"), present.preview(present.source_label(F.col("source"), F.lit(None)), 4).alias("label"),
        present.page_label(F.col("doc_id")).alias("page"), present.clamp_k(F.substring("source", 4, 100)).alias("k"),
    )


@query("SELECT item_id, trim(text) AS query FROM benchmark WHERE trim(text) <> ''")
def query_guard(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", text.strip(F.col("text")).alias("query"))
    return rows.where("query <> ''")


@query(r"SELECT page_id, CASE WHEN regexp_matches(lower(url), '\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(url), '\.docx$') THEN 'docx' END AS kind FROM pages")
def file_dispatch(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.kind(F.col("url")).alias("kind"))


@query("SELECT source AS url, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text FROM documents WHERE doc_id % 2 = 1 OR source NOT IN (SELECT source FROM documents WHERE doc_id % 2 = 1) GROUP BY 1")
def pdf_pages(spark, sf_dir):
    pages = _docs(spark, sf_dir).select(
        F.col("source").alias("url"), F.when(F.col("doc_id") % 2 == 1, 1).otherwise(2).alias("attempt"), F.col("doc_id").alias("page"), "text"
    )
    return files.pdf_text(pages)


@query("SELECT count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS ids FROM documents")
def embed_documents(spark, sf_dir):
    rows = models.embedded(_docs(spark, sf_dir).select("doc_id", "text"), "text")
    return rows.where(F.size("embedding") == 64).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))
