import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, skey string, bucket int"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls in every column, empty and long texts, repeats, an id with two texts, and clashing extra columns."""
    long = " ".join(f"w{k} y{k % 7}" for k in range(20000))
    rows = [
        (1, "One two three four five six.\nSeven eight.", "en", "a", 1, 0.5, "k", 1),
        (1, "One two three four five six.\nSeven eight.", "en", "a", 1, 0.5, "k", 1),
        (2, None, "en", None, None, None, None, None), (None, "lone text of no id at all", None, "b", 2, 0.1, "x", 2),
        (3, "", "de", "", 0, 0.0, "", 0), (4, " \t\n ", None, "a", 3, 0.2, "z", 9), (5, "ONE two three FOUR five six.\nseven eight.", "en", "c", 1, 1.0, "q", 3),
        (6, long, "en", "a", 2, 0.3, "k", 4), (7, "two words", "en", "b", 1, 0.1, "k", 1), (8, "two words", "fr", "b", 1, 0.1, "k", 1),
        (9, "çà и 漢字  \x00 \x1f 😀 </s>", "fr", "c", 1, 0.1, "k", 1), (7, "two words again and some more of them", "en", "b", 1, 0.1, "k", 1),
        (10, "12 %% !!", None, "c", 1, 0.1, "k", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
