"""From raw documents to packed training windows, in four stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  Every stage works on all rows its predecessor kept and reads nothing else.  All but the last return the
columns of docs.  Nulls, empty texts and empty tables pass as the operators define it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import langid, minhash, mixing, packing
from quern.llm.common import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a recognised language; a null text, or one without a letter, goes.

    Where no row has a label to learn from, every text with a letter stays.  Ids, repeated rows and columns of any
    names are passed on as they are; an empty table stays empty.
    """
    model = langid.training_sample(langid.trainable(docs))
    if not model:
        return docs.where(F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    wrapped = docs.select(F.struct(*columns).alias("row_"), "text")
    return langid.identify(wrapped, model).where(F.col("lang_pred") != langid.UNKNOWN).select("row_.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, that of the least id; of a group without ids that of least hash.

    A text without a word is a group of its own.  Where ids repeat or are null, a document is an id with its text: texts
    of one id that aren't alike all stay, and of rows equal in both the least, by their other columns, is kept.  An
    empty table stays empty.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        dropped = minhash.near_duplicates(docs).where("not kept").select("doc_id")
        return docs.join(dropped, "doc_id", "left_anti").select(*columns)
    # 64 bits of both: at a thousand million rows two documents are taken for one with a probability of 3 %
    node = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    nodes = cut(docs.select(node.alias("node"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).dropDuplicates(["node"]))
    groups = minhash.near_duplicates(nodes.select(F.col("node").alias("doc_id"), "text")).select(F.col("doc_id").alias("node"), "component_id")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    kept = cut(nodes.select("node", "doc_id").join(groups, "node").groupBy("component_id").agg(F.min(first)["node"].alias("node")).select("node"))
    row = F.struct(*columns)
    rest = docs.select(row.alias("row_"), node.alias("node")).join(kept, "node", "left_semi")
    return rest.groupBy("node").agg(F.min("row_").alias("row_")).select("row_.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources: a document comes out as often as it is taken, at most twice.

    Texts that are null or without a word aren't taken; a null source is a source, null ids are told apart by their
    texts, repeated rows are taken alike, other columns pass, and an empty table stays empty.
    """
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, placed in sequences; a repeated document is packed as often as it comes.

    A null or empty text is its end id alone, a null id stays null, other columns are dropped whatever their names, and
    an empty table gives no pieces.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("packed", packed),
]

#: Language identification and packing are beyond SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two of them a table in the folder that the cluster shares."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="quern-pipeline-")
    folder = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
