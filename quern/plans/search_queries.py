"""Queries over documents, embeddings and benchmark: BM25, dense search, fusion, hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import SearchConfig
from quern.functions import present, text
from quern.operators import retrieval
from quern.plans.registry import query, table

_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_BM25 = f"""tokens AS (SELECT doc_id AS id, unnest({_TOKENS}) AS term FROM docs), lens AS (SELECT doc_id AS id, len({_TOKENS}) AS dl FROM docs),
stats AS (SELECT count(*) AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM lens), tf AS (SELECT id, term, count(*) AS tf FROM tokens GROUP BY ALL),
freq AS (SELECT term, count(*) AS df, ln(n - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM tf, stats GROUP BY term, n),
vocab AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM freq) ELSE raw END AS idf FROM freq),
asked AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM qs) GROUP BY ALL),
scored AS (SELECT qid, id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * times) AS score FROM asked JOIN vocab USING (term) JOIN tf USING (term) JOIN lens USING (id), stats GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM scored WHERE score > 0) WHERE rank < 20)"""
_ALL = "docs AS (SELECT doc_id, text FROM documents)"
_BENCH = "qs AS (SELECT item_id AS qid, text AS query FROM benchmark)"
#: Searches take as queries every row whose id is divisible by 20.
_VECTORS = "qv AS (SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id % 20 = 0)"
_DENSE = """pairs AS (SELECT qid, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS exact FROM qv q, corpus v),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY exact DESC, id) - 1 AS rank FROM pairs) WHERE rank < 20)"""
_CORPUS = "corpus AS (SELECT * FROM embeddings)"


def _doc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


@query(f"SELECT doc_id, {_TOKENS} AS tokens FROM documents")
def tokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.tokenize(F.col("text")).alias("tokens"))


@query(
    f"""WITH counted AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY 1),
    freq AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM counted, (SELECT count(*) AS n FROM documents)),
    floor_ AS MATERIALIZED (SELECT 0.25 * avg(raw) AS low FROM freq)
    SELECT term, df::BIGINT AS df, round(CASE WHEN raw < 0 THEN low ELSE raw END, 6) AS idf FROM freq, floor_"""
)
def bm25_vocab(spark, sf_dir):
    index = retrieval.BM25Index.build(_doc_rows(spark, sf_dir))
    return index.vocabulary.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"SELECT count(*)::BIGINT AS n, round(sum(len({_TOKENS}))::DOUBLE / count(*), 6) AS avgdl FROM documents")
def bm25_stats(spark, sf_dir):
    return retrieval.BM25Index.build(_doc_rows(spark, sf_dir)).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {_ALL}, qs AS (SELECT 0 AS qid, 'the eron the tion thing' AS query), {_BM25} SELECT id, round(score, 6) AS score, rank::INTEGER AS rank FROM sparse")
def bm25_topk(spark, sf_dir):
    asked = spark.sql("SELECT 0L AS qid, 'the eron the tion thing' AS query")
    found = retrieval.BM25Index.build(_doc_rows(spark, sf_dir)).search(asked)
    return found.select("id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_ALL}, {_BENCH}, {_BM25} SELECT qid, id, round(score, 6) AS score, rank::INTEGER AS rank FROM sparse")
def bm25_multiquery(spark, sf_dir):
    found = retrieval.BM25Index.build(_doc_rows(spark, sf_dir)).search(_questions(spark, sf_dir))
    return found.select("qid", "id", F.round("score", 6).alias("score"), "rank")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


@query(f"WITH {_CORPUS}, qv AS (SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id = 0), {_DENSE} SELECT id, round(exact, 4) AS similarity, rank::INTEGER AS rank FROM near WHERE exact >= 0")
def dense_topk(spark, sf_dir):
    return retrieval.dense_topk(_corpus(spark, sf_dir), _vectors(spark, sf_dir).where("qid = 0")).select("id", "similarity", "rank")


@query(f"WITH {_CORPUS}, {_VECTORS}, {_DENSE} SELECT qid, id, round(exact, 4) AS similarity, rank::INTEGER AS rank FROM near WHERE exact >= 0")
def dense_multiquery(spark, sf_dir):
    return retrieval.dense_topk(_corpus(spark, sf_dir), _vectors(spark, sf_dir))


@query(f"WITH {_CORPUS}, {_VECTORS}, {_DENSE} SELECT qid, id, round(exact, 4) AS similarity, rank::INTEGER AS rank FROM near WHERE exact >= 0.35::DOUBLE")
def dense_threshold(spark, sf_dir):
    return retrieval.dense_topk(_corpus(spark, sf_dir), _vectors(spark, sf_dir), threshold=0.35)


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM embeddings")
def cosine_similarity(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    one = rows.where("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    return rows.crossJoin(F.broadcast(one)).select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 4) AS square, 1.0::DOUBLE AS norm FROM embeddings")
def vector_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.select(
        "vec_id", F.round(square(F.col("embedding")), 4).alias("square"), F.round(square(retrieval.normalized(F.col("embedding"))), 6).alias("norm")
    )


_FUSED = """dense AS (SELECT qid, id, exact, rank FROM near WHERE exact >= 0), fused AS (SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.id, s.id) AS id, d.rank AS dr, s.rank AS sr, round(d.exact, 4) AS similarity,
  coalesce(0.5::DOUBLE / (61 + d.rank), 0) + coalesce(0.5::DOUBLE / (61 + s.rank), 0) AS score FROM dense d FULL JOIN sparse s ON d.qid = s.qid AND d.id = s.id),
ordered AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, dr NULLS LAST, sr NULLS LAST) - 1 AS rank FROM fused)"""
#: All documents make up the store; those without an embedding of the same id are found by their words only.  Query i is
#: benchmark text i with vector i.
_STORE = """docs AS (SELECT doc_id, text FROM documents), corpus AS (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
qs AS (SELECT item_id AS qid, text AS query FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings)), qv AS (SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark))"""
_OVERLAP = r"len(list_intersect(list_distinct(regexp_extract_all(lower(q.query), '[\p{L}\p{N}_]+')), regexp_extract_all(lower(d.text), '[\p{L}\p{N}_]+')))::DOUBLE / len(list_distinct(regexp_extract_all(lower(q.query), '[\p{L}\p{N}_]+')))"
_HYBRID = f"WITH {_STORE}, {_BM25}, {_DENSE}, {_FUSED}"


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of documents, a table apart: the texts are never shuffled to meet them."""
    return _corpus(spark, sf_dir).join(_store(spark, sf_dir).select("id"), "id", "left_semi")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).join(_corpus(spark, sf_dir).withColumnRenamed("id", "qid"), "qid")


def _index(store: DataFrame) -> retrieval.BM25Index:
    return retrieval.BM25Index.build(store, "id", "document")


@query(f"{_HYBRID} SELECT qid, id, round(score, 9) AS score, rank::INTEGER AS rank FROM ordered")
def rrf_fuse(spark, sf_dir):
    store, asked = _store(spark, sf_dir), _asked(spark, sf_dir)
    fused = retrieval.fuse(retrieval.dense_topk(_placed(spark, sf_dir), asked), _index(store).search(asked))
    return fused.select("qid", "id", F.round("score", 9).alias("score"), "rank")


_SPARSE_ONLY = "SELECT qid, id FROM sparse s WHERE NOT EXISTS (SELECT 1 FROM dense d WHERE d.qid = s.qid AND d.id = s.id)"


@query(f"{_HYBRID} {_SPARSE_ONLY}")
def sparse_only_hits(spark, sf_dir):
    store, asked = _store(spark, sf_dir), _asked(spark, sf_dir)
    dense = retrieval.dense_topk(_placed(spark, sf_dir), asked)
    return _index(store).search(asked).join(dense, ["qid", "id"], "left_anti").select("qid", "id")


@query(f"{_HYBRID} SELECT qid, CASE WHEN qid IN (SELECT qid FROM sparse) THEN 'hybrid_dense_bm25' ELSE 'dense_only' END AS retrieval_method, rank::INTEGER AS final_rank, id, similarity, round(1 - similarity, 4) AS distance FROM ordered WHERE rank < 5")
def hybrid_search(spark, sf_dir):
    store = _store(spark, sf_dir)
    found = retrieval.search(store, _index(store), _asked(spark, sf_dir), 5, SearchConfig(rerank=False), vectors=_placed(spark, sf_dir))
    return found.select("qid", "retrieval_method", "final_rank", "id", "similarity", "distance")


@query(
    f"""{_HYBRID}, cand AS (SELECT o.*, round({_OVERLAP}, 4) AS ce, count(*) OVER (PARTITION BY o.qid) AS n FROM ordered o JOIN qs q USING (qid) JOIN docs d ON d.doc_id = o.id WHERE rank < 20),
    final AS (SELECT *, CASE WHEN n > 5 THEN ce END AS c, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN n > 5 THEN ce END DESC NULLS LAST, rank) - 1 AS fr FROM cand)
    SELECT qid, CASE WHEN qid IN (SELECT qid FROM sparse) THEN 'hybrid_dense_bm25' ELSE 'dense_only' END || CASE WHEN c IS NOT NULL THEN '+reranker' ELSE '' END AS retrieval_method,
    fr::INTEGER AS final_rank, id, similarity, round(1 - similarity, 4) AS distance, c AS cross_encoder_score FROM final WHERE fr < 5"""
)
def hybrid_reranked(spark, sf_dir):
    store = _store(spark, sf_dir)
    return retrieval.search(store, _index(store), _asked(spark, sf_dir), 5, vectors=_placed(spark, sf_dir)).drop("document")


@query(f"WITH {_STORE}, {_DENSE} SELECT qid, 'dense_only' AS retrieval_method, (row_number() OVER (PARTITION BY qid ORDER BY round(exact, 4) DESC, rank) - 1)::INTEGER AS final_rank, id, round(exact, 4) AS similarity FROM near WHERE exact >= 0 AND rank < 5")
def dense_only_search(spark, sf_dir):
    found = retrieval.search(_store(spark, sf_dir), None, _asked(spark, sf_dir), 5, SearchConfig(rerank=False, hybrid=False), vectors=_placed(spark, sf_dir))
    return found.select("qid", "retrieval_method", "final_rank", "id", "similarity")


@query(f"{_HYBRID} SELECT qid, least(count(*), 5)::BIGINT AS total_results FROM ordered GROUP BY 1")
def search_response(spark, sf_dir):
    store, asked = _store(spark, sf_dir), _asked(spark, sf_dir)
    answers = retrieval.responses(retrieval.search(store, _index(store), asked, 5, vectors=_placed(spark, sf_dir)), asked)
    return answers.select("qid", F.get_json_object("response", "$.total_results").cast("long").alias("total_results"))


@query(
    f"""WITH {_CORPUS}, {_VECTORS}, {_DENSE} SELECT qid, id, (rank + 1)::INTEGER AS shown_rank, printf('%.1f%%', round((round(exact, 4) * 100)::VARCHAR::DECIMAL(20, 15), 1)::DOUBLE) AS percent,
    CASE WHEN round(exact, 4) >= 0.8::DOUBLE THEN 'high' WHEN round(exact, 4) >= 0.65::DOUBLE THEN 'good' WHEN round(exact, 4) >= 0.5::DOUBLE THEN 'fair' ELSE 'low' END AS band FROM near WHERE exact >= 0"""
)
def result_card(spark, sf_dir):
    found = retrieval.dense_topk(_corpus(spark, sf_dir), _vectors(spark, sf_dir))
    return found.select(
        "qid", "id", (F.col("rank") + 1).alias("shown_rank"), present.percent(F.col("similarity")).alias("percent"), present.band(F.col("similarity")).alias("band")
    )


@query("SELECT 'healthy' AS status, count(*)::BIGINT AS document_count, true AS hybrid_enabled, true AS bm25_ready, true AS reranker_enabled, true AS reranker_ready FROM documents")
def store_health(spark, sf_dir):
    store = _store(spark, sf_dir)
    return retrieval.health(store, _index(store))
