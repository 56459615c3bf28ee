import random
from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from test_near_dup import brute
from test_packing_mixing import checked, water


def test_stages_in_turn(spark, sf, docs, tmp_path):
    kept = docs
    got = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        got.append(kept.collect())
    assert len(got[0]) == docs.count()  # all of these have a language
    groups = brute([(r["doc_id"], r["text"]) for r in got[0]])
    assert sorted(r["doc_id"] for r in got[1]) == sorted({c for c in groups.values()})
    sizes = defaultdict(int)
    for r in got[1]:
        sizes[r["source"]] += len(r["text"].split())
    taken = defaultdict(int)
    for r in got[2]:
        taken[r["source"]] += len(r["text"].split())
    for s, t in water(sizes).items():
        least = min([len(r["text"].split()) for r in got[1] if r["source"] == s and len(r["text"].split())], default=0)
        assert t - taken[s] <= max(0.0006 * t + 1, max(len(r["text"].split()) for r in got[1] if r["source"] == s)) and taken[s] <= t + 1 and least > 0
    assert checked(got[3], {}) == 0
    assert {r["doc_id"] for r in got[3]} == {r["doc_id"] for r in got[2]}


def test_run_equals_stages_and_odd_rows(spark, sf, odd, none):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns[:2] == ["doc_id", "start"] and rows.count() > 0
    for frame in (odd, none):
        docs = frame
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        docs.collect()
    first = corpus_pipeline.language(spark, odd, sf)
    assert first.where(F.col("text").isNull()).count() == 0
    second = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, odd, sf).collect()]
    assert len(second) == len(set(second)) and not {5, 8} & {i for i, _ in second}
    assert (7, "two words") in second and (7, "two words again and some more of them") in second


def test_null_and_repeated_ids_keep_one_row_of_a_group(spark, sf):
    """Copies without an id, an id with two texts, a copy with and one without an id."""
    words = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcd"]
    rows = [(None, words[0], 1), (None, words[0], 2), (None, words[0] + " x", 3), (4, words[1], 4), (4, words[2], 5), (4, words[2], 6),
            (None, words[1] + " y", 7), (9, words[3], 8), (8, words[3] + " z", 9), (None, None, 10), (None, None, 11), (3, "", 12)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = corpus_pipeline.near_dedup(spark, frame, sf).collect()
    groups = sorted((r["doc_id"] or 0, (r["text"] or "")[:2]) for r in got)
    assert groups == [(0, ""), (0, "a0"), (3, ""), (4, "b0"), (4, "c0"), (8, "d0")]
    assert {r["n"] for r in got} >= {4, 5, 9, 10, 12}
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, corpus_pipeline.near_dedup(spark, frame.repartition(5), sf).collect()))


def test_nothing_to_learn_from_drops_no_text(spark, sf, docs):
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, bare, sf).count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
