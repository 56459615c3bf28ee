import json

from pyspark.sql import functions as F

from quern.sources.store import VectorStore
from quern.streaming.ingest import HISTORY_SCHEMA, Ingestion

PAGES = [("https://h/1", "html", "<body><main>same text</main></body>", 1), ("https://h/2", "html", "<body><main>same text</main></body>", 2),
         ("https://h/3", "html", "<body></body>", 3), ("https://h/4.zip", "skip", None, 4)]


def make(spark, folder, generate=None):
    return Ingestion(VectorStore(spark, f"{folder}/store"), VectorStore(spark, f"{folder}/history", HISTORY_SCHEMA), generate=generate)


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "url string, type string, body string, seq int")


def test_batch_is_incremental(spark, tmp_path):
    job = make(spark, tmp_path)
    assert job.batch(pages(spark), 1.0) == {"new": 2, "skipped": 0, "chunks": 2}
    assert job.batch(pages(spark), 2.0) == {"new": 0, "skipped": 2, "chunks": 0}
    stored = job.store.read().collect()
    assert len(stored) == 1 and stored[0]["metadata"]["url"] == "https://h/2" and len(stored[0]["embedding"]) == 64
    assert {r["url"] for r in job.past().collect()} == {"https://h/1", "https://h/2"}


def test_list_leaves_history_alone(spark, tmp_path):
    job = make(spark, tmp_path)
    job.batch(pages(spark), 1.0, remember=False)
    assert job.past().count() == 0 and job.store.count() == 1


def test_backfill(spark, tmp_path):
    make(spark, tmp_path).batch(pages(spark), 1.0)
    job = make(spark, tmp_path, generate=lambda prompt: json.dumps({"context": "c", "questions": ["q?"]}))
    assert job.backfill(pages(spark)) == 2 and job.backfill(pages(spark)) == 0
    assert {r["context"] for r in job.past().collect()} == {"c"}

    def broken(prompt):
        raise OSError

    job.generate = broken
    assert job.batch(pages(spark, [("https://h/5", "html", "<body>new</body>", 5)]), 3.0)["new"] == 1


def test_stream_equals_batch(spark, tmp_path):
    pages(spark).write.parquet(f"{tmp_path}/in")
    job = make(spark, tmp_path)
    for _ in range(2):
        stream = spark.readStream.schema("url string, type string, body string, seq int").parquet(f"{tmp_path}/in")
        job.stream(stream, f"{tmp_path}/state").awaitTermination()
    assert job.store.count() == 1 and job.past().count() == 2
    assert job.store.read().select(F.md5("document") == F.col("id")).first()[0]


def test_pages_that_share_a_url(spark, tmp_path):
    rows = [("https://h/1", "html", "<body>one</body>", 1), ("https://h/1", "html", "<body>two</body>", 2)]
    job = make(spark, tmp_path)
    assert job.batch(pages(spark, rows), 1.0) == {"new": 1, "skipped": 0, "chunks": 2}
    assert sorted(r["document"] for r in job.store.read().collect()) == ["one", "two"]
    assert [(r["url"], r["chunks"]) for r in job.past().collect()] == [("https://h/1", 2)]
    job.generate = lambda prompt: json.dumps({"context": "two" if "two" in prompt else "one", "questions": []})
    assert job.backfill(pages(spark, rows)) == 1 and [r["context"] for r in job.past().collect()] == ["two"]
