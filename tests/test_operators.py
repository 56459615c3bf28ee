import io
import zipfile

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.config import CollectionConfig, CrawlConfig, SearchConfig
from quern.operators import chunking, cleaning, crawl, html, models, retrieval
from quern.plans import registry
from quern.sources import files, history, store, web


@pytest.mark.parametrize("text,size,overlap,expected", [
    ("One. Two. Three. Four.", 12, 5, ["One. Two", ". Two. Three", ". Four."]),
    ("aaaa bbbb cccc dddd", 10, 5, ["aaaa bbbb", "bbbb cccc", "cccc dddd"]),
    ("abcdefghij", 4, 1, ["abcd", "defg", "ghij"]),
    ("p1 line\np1 more\n\np2 line", 16, 0, ["p1 line\np1 more", "p2 line"]),
])
def test_fixed_chunks(text, size, overlap, expected):
    assert chunking.split_fixed(text, size, overlap) == expected


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=200), st.integers(2, 30), st.integers(0, 10))
def test_fixed_chunks_fit(text, size, overlap):
    got = chunking.split_fixed(text, size, min(overlap, size - 1)) if text else []
    assert all(0 < len(c) <= size and c.strip() == c for c in got)
    assert set("".join(got)) <= set(text) and bool(got) == bool(text.strip())


def test_sentence_chunks():
    parts = ["a" * 60, "b" * 60, "c" * 30, "d" * 300]
    assert chunking.pack_sentences(parts, 100, 0) == ["a" * 60, "b" * 60 + "\n" + "c" * 30, "c" * 30, "d" * 300]
    assert chunking.pack_sentences([], 100, 0) == []


def test_header_sections(spark):
    rows = spark.createDataFrame([("intro\n# A\nx\n## B\ny",), ("<h2>T</h2> body <h3 id='q'>U</h3>",), ("plain",), ("  ",), (None,)], "t string")
    got = [[tuple(s) for s in r["s"]] for r in rows.select(chunking.header_sections(F.col("t")).alias("s")).collect()]
    assert got == [[("# A", "x"), ("## B", "y")], [("<h2>T</h2>", "body"), ("<h3 id='q'>U</h3>", "")], [("", "plain")], [], []]


def test_splitters_repeat_metadata(spark):
    df = spark.createDataFrame([(1, "# A\n" + "x " * 60)], "id long, t string")
    got = chunking.chunks(df, "t", chunking.splitter(" Header_Based ", 50, 0)).collect()
    assert len(got) > 1 and {r["id"] for r in got} == {1} and all(len(r["chunk"]) <= 50 for r in got)


EDGES = [("https://h/s", "https://h/a", 0), ("https://h/s", "https://h/b", 1), ("https://h/a", "https://h/c", 0), ("https://h/b", "https://h/c", 0),
         ("https://h/c", "https://h/s", 0), ("https://h/s", "https://h/x.pdf", 2), ("https://h/x.pdf", "https://h/never", 0), ("https://h/s", "https://o/z", 3)]


@pytest.mark.parametrize("depth,expected", [(2, ["s0", "a1", "b1", "x.pdf1", "c2"]), (1, ["s0", "a1", "b1", "x.pdf1"]), (0, ["s0"])])
def test_crawl(spark, depth, expected):
    seeds = spark.createDataFrame([("h", "https://h/s/")], "site string, url string")
    edges = spark.createDataFrame(EDGES, "src string, dst string, pos int")
    got = crawl.crawl(seeds, edges, depth).orderBy("seq").collect()
    assert [r["url"].rsplit("/", 1)[1] + str(r["depth"]) for r in got] == expected


def test_crawl_filter(spark):
    seeds = spark.createDataFrame([("h", "https://h/s")], "site string, url string")
    edges = spark.createDataFrame(EDGES, "src string, dst string, pos int")
    got = crawl.crawl(seeds, edges, 3, exclude=("/a$",)).orderBy("seq").collect()
    assert [r["url"][-1] for r in got] == ["s", "b", "f", "c"]
    assert CrawlConfig(filter_mode="include", include=("a",), exclude=("b",)).patterns() == (("a",), ())


@pytest.mark.parametrize("robots,url,expected", [
    ("User-agent: *\nDisallow: /p", "https://h/p", False), ("User-agent: Mozilla\nDisallow: /p", "https://h/p", False),
    ("User-agent: quern\nDisallow: /p", "https://h/p", True), ("User-agent: *\nDisallow: /p\nAllow: /p/x", "https://h/p/x", False),
    ("User-agent: *\nAllow: /p/x\nDisallow: /p", "https://h/p/x", True),
])
def test_robots(spark, robots, url, expected):
    row = spark.createDataFrame([(url,)], "u string")
    assert row.select(web.robots_allowed(F.col("u"), {"h": robots})).first()[0] is expected


@pytest.mark.parametrize("page,text", [
    ("<body><nav>n</nav><article>foo <b>bar</b> baz</article></body>", "foo\nbar\nbaz"),
    ('<body>a<script>var t="</p>";</script>b</body>', "a\nb"), ("<body><article>x</article><main>y &amp; z</main></body>", "y & z"),
    ("<body><form><p>all</p></form></body>", ""), ("no root", ""), (None, ""), ("<body><p>open <b>bold<p>next</body>", "open\nbold\nnext"),
])
def test_page_text(page, text):
    assert html.page_text(page) == text


def test_links_and_resources(spark):
    page = "<title> A &amp; B </title><body><a href='/x#f'>1</a><a href=y>2</a><a HREF=\"?q\">3</a></body>"
    assert html.page_links(page, "https://h/d/p") == ["https://h/x", "https://h/d/y", "https://h/d/p?q"]
    rows = spark.createDataFrame([("https://h/d/p", "html", page), ("https://h/e.pdf", "pdf", "raw"), ("https://h/n", "html", None)], "url string, type string, body string")
    got = html.resources(rows, {"pdf": lambda b: F.upper(b)}).orderBy("url").collect()
    assert [(r["text"], r["meta"]["filename"], r["meta"]["type"]) for r in got] == [("1\n2\n3", "A & B", "web"), ("RAW", "e.pdf", "pdf")]


def test_repeated_lines(spark):
    lines = [("five", p, 0, "HEAD" if p < 2 else f"l{p}") for p in range(5)] + [("six", p, 0, "ONCE" if p == 0 else "") for p in range(6)]
    lines += [("five", 2, k, t) for k, t in enumerate(["- 3 -", "Page 1 of 5", "12", "Page one"], 1)]
    df = spark.createDataFrame(lines, "doc string, page int, line_no int, line string")
    assert [tuple(r) for r in cleaning.repeated_lines(df).collect()] == [("five", "HEAD", 2)]
    got = {r["doc"]: r["text"] for r in cleaning.joined_pages(cleaning.body_lines(df)).collect()}
    assert got == {"five": "l2\nPage one\n\nl3\n\nl4", "six": "ONCE"}


def _docx(body, header):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = lambda tag, ps: f"<w:{tag} {ns}>" + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in ps) + f"</w:{tag}>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", xml("document", body))
        z.writestr("word/header1.xml", xml("hdr", header))
    return raw.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.DOCX").write_bytes(_docx(["HEAD", " one ", "", "two", "two"], ["HEAD"]))
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.txt").write_text("x")
    got = files.load(files.scan(spark, str(tmp_path))).collect()
    assert [(r["text"], r["meta"]["type"]) for r in got] == [("one\n\ntwo\n\ntwo", "docx")]


def test_ids_and_upsert(spark):
    rows = spark.createDataFrame([("b", k, t) for k, t in enumerate("tutt")], "batch string, k int, document string")
    got = [r["id"] for r in store.with_ids(rows, "batch", ["k"]).orderBy("k").collect()]
    assert got[2] == f"{got[0]}-1" and got[3] == f"{got[0]}-2" and got[1] != got[0]


def test_store_versions(spark, tmp_path):
    s = store.VectorStore(spark, str(tmp_path / "s"), "id string, v int")
    assert s.version() == 0 and not s.is_populated()
    s.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int"))
    s.upsert(spark.createDataFrame([("b", 2)], "id string, v int"))
    assert s.version() == 2 and {tuple(r) for r in s.read().collect()} == {("a", 1), ("b", 2)}
    assert {tuple(r) for r in s.read(1).collect()} == {("a", 1), ("b", 1)}
    assert s.lookup(spark.createDataFrame([("b",), ("z",)], "id string")).count() == 1


def test_history(spark, tmp_path):
    path = tmp_path / "h.json"
    path.write_text('{"version": 1, "base_url": "b", "urls": {"u1": {"type": "html", "chunks": 3, "ingested_at": 1.5, "context": "c"}, "u2": {"type": "pdf", "chunks": 1, "ingested_at": 2}}}')
    past = history.read_json(spark, str(path))
    assert {r["url"]: r["chunks"] for r in past.collect()} == {"u1": 3, "u2": 1}
    path.write_text("{broken")
    assert history.read_json(spark, str(path)).count() == 0 and history.read_json(spark, str(tmp_path / "none")).count() == 0


RANKS = "qid long, id string, rank int"


def test_fusion(spark):
    make = lambda ids: spark.createDataFrame([(1, x, k) for k, x in enumerate(ids)], RANKS)
    order = lambda d, s: [r["id"] for r in retrieval.fuse(make(d), make(s)).orderBy("rank").collect()]
    assert order("ab", "bc") == ["b", "a", "c"] and order("a", "c") == ["a", "c"]


@pytest.mark.parametrize("n,reranked", [(5, False), (6, True)])
def test_rerank_gate(spark, n, reranked):
    rows = spark.createDataFrame([(1, "q w", k, "q w" if k == n - 1 else "z", k) for k in range(n)], "qid long, query string, id long, document string, rank int")
    got = retrieval.rerank(rows, 5, retrieval.overlap_scorer).orderBy("final_rank").collect()
    assert len(got) == 5 and got[0]["id"] == (n - 1 if reranked else 0) and (got[0]["cross_encoder_score"] is not None) is reranked


def test_threshold(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, None)], "id long, embedding array<float>")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, embedding array<float>")
    found = lambda t: [r["id"] for r in retrieval.dense_topk(corpus, asked, 5, t).orderBy("rank").collect()]
    assert found(0.0) == [1] and found(1.0) == [1, 2]


def test_hybrid_search_and_index(spark, tmp_path):
    texts = ["red apple pie", "green apple", "blue sky over hills", "apple apple tart", "sky", "hills"]
    rows = models.embedded(spark.createDataFrame(list(enumerate(texts)), "id long, document string"), "document")
    index = retrieval.BM25Index.build(rows, "id", "document", version=3)
    index.save(str(tmp_path / "i"))
    assert retrieval.BM25Index.load(spark, str(tmp_path / "i"), 2) is None and retrieval.BM25Index.load(spark, str(tmp_path / "none"), 3) is None
    loaded = retrieval.BM25Index.load(spark, str(tmp_path / "i"), 3)
    asked = models.embedded(spark.createDataFrame([(0, "apple tart"), (1, "zzz")], "qid long, query string"), "query", query=True)
    got = retrieval.search(rows, loaded, asked, 2).collect()
    by = {r["qid"]: r for r in got if r["final_rank"] == 0}
    assert by[0]["document"] == "apple apple tart" and by[0]["retrieval_method"].startswith("hybrid_dense_bm25")
    assert by[1]["retrieval_method"].startswith("dense_only")
    answer = retrieval.responses(retrieval.search(rows, loaded, asked, 2), asked).collect()
    assert len(answer) == 2 and '"total_results":2' in answer[0]["response"]
    with pytest.raises(ValueError):
        retrieval.search(rows, loaded, asked, 0)
    assert retrieval.health(rows, None, SearchConfig()).first()["bm25_ready"] is False


def test_config(tmp_path):
    path = tmp_path / "c.json"
    assert CollectionConfig().save_if_absent(path) and not CollectionConfig().save_if_absent(path)
    path.write_text('{"query_prefix": "q:", "other": 1}')
    assert CollectionConfig.load(path).query_prefix == "q:" and CollectionConfig.load(tmp_path / "no") == CollectionConfig()
    path.write_text("nonsense")
    assert CollectionConfig.load(path) == CollectionConfig()


def test_links_of_pages_that_share_a_url(spark, tmp_path):
    rows = [(1, "https://h/p", '<a href="/x">1</a>'), (2, "https://h/p", '<a href="/y">1</a><a href="/z">2</a>')]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.queries()["page_links"](spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], r["pos"], r["href"]) for r in got) == [(1, 0, "/x"), (2, 0, "/y"), (2, 1, "/z")]


def test_dense_tiles(spark):
    import numpy as np

    made = np.random.default_rng(7).integers(-2, 3, (1500, 4)) + 0.5
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(made)]
    corpus = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame(rows[:700], "qid long, embedding array<float>")
    got = {}
    for r in retrieval.dense_topk(corpus, asked, 3, -0.5, query_block=600).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    unit = made / np.linalg.norm(made, axis=1, keepdims=True)
    exact = np.round(unit[:700] @ unit.T, 9)
    assert got == {q: np.lexsort((np.arange(1500), -s))[:3].tolist() for q, s in enumerate(exact)}


def test_dense_holds_tiles_only():
    import tracemalloc

    import numpy as np

    q, ids = np.random.default_rng(1).random((4096, 2048)), np.arange(512)
    best = retrieval._Best(4096, 20)
    tracemalloc.start()
    for first in range(0, 4096, retrieval._TILE):
        best.offer(first, q[first : first + retrieval._TILE, :512], ids, q[first : first + retrieval._TILE, :512] >= 0)
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
    assert best.id[5].tolist() == np.lexsort((ids, -np.round(q[5, :512], 9)))[:20].tolist()


def test_bm25_scores_documents_where_they_are(spark, tmp_path):
    import math

    texts = ["red apple pie", "green Apple", "blue sky over hills", "apple apple tart", "sky", None, "", "red apple pie", "apple", "apple green"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, document string").repartition(3)
    asked = spark.createDataFrame([("a", "apple tart apple"), ("b", "zzz"), ("c", "red sky"), ("d", None)], "qid string, query string")
    split = [(t or "").lower().split() for t in texts]
    n, avg, terms = len(split), sum(map(len, split)) / len(split), {t for d in split for t in d}
    raw = {t: math.log(n - (f := sum(t in d for d in split)) + 0.5) - math.log(f + 0.5) for t in terms}
    assert raw["apple"] < 0
    low = 0.25 * sum(raw.values()) / len(raw)
    want = {}
    for q, words in (("a", ["apple", "tart", "apple"]), ("c", ["red", "sky"])):
        score = {i: sum((raw[w] if raw[w] >= 0 else low) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in words) for i, d in enumerate(split)}
        best = sorted((i for i in score if score[i] > 0), key=lambda i: (-round(score[i], 9), i))[:3]
        want |= {(q, r): (i, round(score[i], 6)) for r, i in enumerate(best)}
    built = retrieval.BM25Index.build(rows, "id", "document")
    built.save(str(tmp_path / "i"))
    for index in (built, retrieval.BM25Index.load(spark, str(tmp_path / "i"))):
        assert {(r["qid"], r["rank"]): (r["id"], round(r["score"], 6)) for r in index.search(asked, 3).collect()} == want
    plan = built.search(asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and plan.count("hashpartitioning") == 1
    assert built.search(asked.where("qid = 'b'")).count() == 0 and built.search(asked.limit(0)).count() == 0


def test_queries_in_blocks(monkeypatch):
    monkeypatch.setattr(retrieval, "_CELLS", 4)
    weights = [{0: 1.0, 1: 2.0}, {1: 3.0}, {2: 1.0}, {}, {0: 1.0, 1: 1.0, 2: 1.0, 3: 1.0, 4: 5.0}]
    got = {}
    for first, many, own, (t, q, x) in retrieval._blocks(weights):
        for a, b, c in zip(t, q, x):
            got.setdefault(first + int(b), {})[int(own[a])] = float(c)
    assert [got.get(k, {}) for k in range(5)] == weights


def test_chunkers_get_small_batches(spark):
    name = "spark.sql.execution.arrow.max{}PerBatch"
    before = {k: spark.conf.get(name.format(k)) for k in ("Bytes", "Records")}

    @F.pandas_udf("array<string>")
    def sizes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [str(len(texts))])

    try:
        for k in before:
            spark.conf.unset(name.format(k))
        rows = spark.range(2000).select(F.repeat(F.lit("word "), 2000).alias("t")).coalesce(1)
        got = [int(r["chunk"]) for r in chunking.chunks(rows, "t", sizes).collect()]
        assert len(got) == 2000 and max(got) <= 256
    finally:
        for k, v in before.items():
            spark.conf.set(name.format(k), v)
