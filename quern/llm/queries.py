"""One query per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chat, fingerprints, htmltext, langid, langmodel, licenses, media, mixing, packing
from quern.llm.common import crc_mod, documents
from quern.llm.minhash import near_duplicates


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(documents(spark, sf_dir, "pages"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.score(documents(spark, sf_dir), langmodel.trainable(F.col("doc_id")))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.training_sample(langid.trainable(docs))
    return langid.identify(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score"
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("places")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]')"
        " AS t(conv_id, turn, role, text)"
    )
    talk = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = chat.read_back(chat.windows(talk))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.inspected(media.encoded(documents(spark, sf_dir)))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS s
  FROM words, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2))) AS i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN sizes p ON p.doc_id = a.doc_id
  JOIN sizes q ON q.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id, min(other) = doc_id AS kept
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""


def _op6() -> str:
    postings, facts = [], []
    for t, template in enumerate(licenses.BASE + licenses.KNOWN):
        postings += [f"({t}, '{w}', {p}, {int(key)})" for w, p, key in template.postings()]
        facts.append(f"({t}, '{template.label}', {len(template.postings())}, {template.key[1] - template.key[0] + 1}, {str(template.base).lower()})")
    return f"""WITH postings(t, w, pos, key) AS (VALUES {', '.join(postings)}), facts(t, label, whole, keys, base) AS (VALUES {', '.join(facts)}),
words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
hits AS (SELECT doc_id, i - 1 AS i, ws[i] AS w FROM words, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)),
stands AS (SELECT doc_id, t, i - pos AS start, count(*) AS n, sum(key) AS k FROM hits JOIN postings USING (w) GROUP BY ALL),
places AS (SELECT * FROM stands JOIN facts USING (t) WHERE k = keys AND n >= 0.6::DOUBLE * whole AND (NOT base OR n = whole)),
found AS (SELECT doc_id, count_if(base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
  max(n::DOUBLE / whole) AS score FROM places GROUP BY 1)
SELECT doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM words LEFT JOIN found USING (doc_id)"""


def _tree(text: str) -> str:
    """SQL of a text's section entries: [{d: digest, p: its paragraphs as [{d, l: leaves}]}]."""
    paragraphs = (
        f"list_transform(list_transform(regexp_extract_all({text}, '{fingerprints.PARAGRAPH}'), lambda p: list_transform(regexp_extract_all(p, '{fingerprints.CLAUSE}'),"
        " lambda c: sha256(c))), lambda l: {'d': sha256(array_to_string(l, '')), 'l': l})"
    )
    return paragraphs


_ENDS = " OR ".join(f"starts_with(p[i].d, '{c}')" for c in fingerprints.SECTION_ENDS)
#: A section's number is the number of section ends before its paragraphs.
_OP10 = f"""WITH pairs AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nt
  FROM documents WINDOW w AS (ORDER BY doc_id DESC)),
texts AS (SELECT doc_id, t, left(t, (length(t) - length(t) // 2)::BIGINT) || left(nt, (length(t) // 2)::BIGINT) AS e, nt FROM pairs),
trees AS (SELECT doc_id, k, {_tree('x')} AS p FROM (SELECT doc_id, 't' AS k, t AS x FROM texts UNION ALL SELECT doc_id, 'e', e FROM texts)),
rows_ AS (SELECT doc_id, k, i, p[i].d AS d, p[i].l AS l, {_ENDS} AS ends FROM trees, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)),
placed AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM rows_),
sections AS (SELECT doc_id, k, s, sha256(string_agg(d || CASE WHEN ends THEN '' ELSE ',' END, '' ORDER BY i)) AS sd FROM placed GROUP BY ALL),
roots AS (SELECT t.doc_id, t.k, sha256(coalesce(string_agg(sd, '' ORDER BY s), '')) AS root, coalesce(string_agg(left(sd, 16), '' ORDER BY s), '') AS short FROM trees t LEFT JOIN sections USING (doc_id, k) GROUP BY ALL),
nodes AS (SELECT p.doc_id, p.k, sd, d, any_value(l) AS l FROM placed p JOIN sections USING (doc_id, k, s) GROUP BY ALL),
leaves AS (SELECT doc_id, k, count(DISTINCT leaf) AS n FROM (SELECT doc_id, k, unnest(l) AS leaf FROM nodes) GROUP BY ALL),
compared AS (SELECT doc_id AS a, 't' AS ak, doc_id AS b, 'e' AS bk, 'near_edited' AS name FROM texts UNION ALL
  SELECT doc_id, 't', coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), max(doc_id) OVER ()), 't', 'near_next' FROM texts),
turned AS (SELECT a, ak, b, bk, name, 1 AS side FROM compared UNION ALL SELECT b, bk, a, ak, name, 2 FROM compared),
keyed AS (SELECT CASE side WHEN 1 THEN a ELSE b END AS doc_id, a, ak, b, bk, name, side FROM turned),
odd AS (SELECT q.*, n.d, n.l FROM keyed q JOIN nodes n ON n.doc_id = q.a AND n.k = q.ak WHERE NOT EXISTS (SELECT 1 FROM sections m WHERE m.doc_id = q.b AND m.k = q.bk AND m.sd = n.sd)),
opened AS (SELECT o.* FROM odd o WHERE NOT EXISTS (SELECT 1 FROM odd m WHERE m.doc_id = o.doc_id AND m.name = o.name AND m.side <> o.side AND m.d = o.d)),
low AS (SELECT DISTINCT doc_id, name, side, unnest(l) AS leaf FROM opened),
lacking AS (SELECT doc_id, name, count(*) AS n FROM low l WHERE NOT EXISTS (SELECT 1 FROM low m WHERE m.doc_id = l.doc_id AND m.name = l.name AND m.side <> l.side AND m.leaf = l.leaf) GROUP BY ALL),
near AS (SELECT q.a AS doc_id, q.name, CASE WHEN x.root = y.root THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - coalesce(k.n, 0) / (coalesce(f.n, 0) + coalesce(g.n, 0))::DOUBLE END AS v FROM compared q
  JOIN roots x ON x.doc_id = q.a AND x.k = q.ak JOIN roots y ON y.doc_id = q.b AND y.k = q.bk LEFT JOIN leaves f ON f.doc_id = q.a AND f.k = q.ak LEFT JOIN leaves g ON g.doc_id = q.b AND g.k = q.bk
  LEFT JOIN lacking k ON k.doc_id = q.a AND k.name = q.name)
SELECT t.doc_id, length(t.t)::BIGINT AS n_chars, sha256(t.e) AS edited_sha256, r.root || '/' || r.short AS fingerprint, z.root || '/' || z.short AS edited_fingerprint, a.v AS near_edited, b.v AS near_next
FROM texts t JOIN roots r ON r.doc_id = t.doc_id AND r.k = 't' JOIN roots z ON z.doc_id = t.doc_id AND z.k = 'e' JOIN near a ON a.doc_id = t.doc_id AND a.name = 'near_edited' JOIN near b ON b.doc_id = t.doc_id AND b.name = 'near_next'"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {"op2_minhash_near_dedup": _OP2, "op6_license_scan": _op6(), "op10_document_fingerprints": _OP10}
