import pytest
from pyspark.sql import functions as F

from quern.functions import present, text, urls


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("url,kind", [
    ("https://h/a.PDF?x=1", "pdf"), ("https://h/b.doc", "docx"), ("https://h/c.xlsx", "skip"), ("https://h/d.php", "html"), ("https://h", "html"),
    ("https://h/pub/Информација о.pdf", "pdf"),
])
def test_classify(spark, url, kind):
    assert one(spark, urls.classify(F.col("u")), u=url) == kind


@pytest.mark.parametrize("url,same", [("http://H/x", True), ("https://sub.h/x", False), ("mailto:a@h", False)])
def test_same_domain(spark, url, same):
    assert one(spark, urls.same_domain(F.col("u"), "h"), u=url) is same


@pytest.mark.parametrize("link", ["", "x", "/y?q=1#f", "?z=2", "//o/p", "https://k/l#m", "../u", "./v", "/a/../b", "mailto:a@b", "c/../d/./e.html?f", ".."])
def test_resolve_is_urljoin(spark, link):
    from urllib.parse import urldefrag, urljoin

    base = "https://h.x/dir/page.html?old=1#top"
    assert one(spark, urls.resolve(F.col("l"), F.col("b")), l=link, b=base) == urldefrag(urljoin(base, link)).url


def test_path_filter(spark):
    u = F.col("u")
    assert one(spark, urls.relevant_path(u, ("^/Pub",), ("/img/",)), u="https://h/pub/a")
    assert not one(spark, urls.relevant_path(u, ("^/pub",), ("/img/",)), u="https://h/pub/img/a")
    assert one(spark, urls.relevant_path(u), u="https://h/any")
    assert one(spark, urls.relevant_path(u, ("",)), u="https://h/any")


def test_sentences(spark):
    assert one(spark, text.sentences(F.col("t")), t="Ovo je. Šta? da. Й x. 2 y") == ["Ovo je.", "Šta? da.", "Й x. 2 y"]


def test_tokens(spark):
    assert one(spark, text.tokenize(F.col("t")), t="Šta je ZFS-2026 i МАТ_1?") == ["šta", "je", "zfs", "2026", "i", "мат_1"]
    assert one(spark, text.tokenize(F.col("t")), t="éx") == ["e", "x"]


@pytest.mark.parametrize("raw,expected", [
    ('```json\n{"context": "c", "questions": ["a", " b ", "d"]}\n```', ("c", ["a", "b"])),
    ('Sure: {"context": "c"} bye', ("c", [])),
    ('{"context": " ", "questions": "one?"}', (None, ["one?"])),
    ('{"context": 5, "questions": [1, "x"]}', (None, ["x"])),
    ("[]", None), ("nonsense", None), ("", None), (None, None), ('{"context": "", "questions": []}', None),
])
def test_generated_answers(spark, raw, expected):
    got = spark.createDataFrame([(raw,)], "r string").select(text.parse_generated(F.col("r")).alias("p")).first()["p"]
    assert (got if got is None else (got["context"], got["questions"])) == expected


def test_prompt(spark):
    made = one(spark, text.prompt(F.col("u"), F.col("t"), F.col("x"), "{url}|{title}|{text}|{{}}"), u="U", t="", x=" a \n b ")
    assert made == "U|U|a b|{}"
    assert one(spark, text.prompt(F.col("u"), F.col("t"), F.col("x")), u="U", t="T", x=" \n") is None


def test_present(spark):
    assert one(spark, present.percent(F.col("s")), s=0.8123) == "81.2%"
    assert [one(spark, present.clamp_k(F.col("k")), k=k) for k in ("0", "7", "99", "x")] == [1, 7, 50, 5]
    assert [one(spark, present.band(F.col("s")), s=s) for s in (0.8, 0.65, 0.5, 0.1)] == ["high", "good", "fair", "low"]
    assert one(spark, present.preview(F.col("t"), 3), t="abcd") == "abc…"
