import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, block int, id string, score double"
LONG = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
LINE = "A line that several documents share, long enough to count."
PASSAGE = "This passage of text is longer than fifty bytes and it turns up again and again in other documents."
ROWS = [
    (1, f"{LINE}\nalpha beta gamma delta epsilon zeta\n{PASSAGE}", "en", "a"),
    (2, f"  {LINE.upper()}  \nother words stand here\n\n{PASSAGE} And more.", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, None),
    (5, "   \t \n ", "de", "b"),
    (6, LONG, "en", "a"),
    (6, LONG, "en", "a"),
    (7, "short", "fr", None),
    (8, LONG + " end", "en", "c"),
    (None, f"{LINE}\nno id here", None, "c"),
    (9, "naïve café 你好 \U0001f600 " * 30, "zh", "a"),
    (10, "same " * 400, "en", "b"),
    (11, f"{PASSAGE}{PASSAGE}", "en", "a"),
    (12, "\x0b\x0cform\x0bfeed\rreturn nbsp", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and extra columns with names used inside operators."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "k", 1, "x", 0.5) for i, t, lang, s in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(1, 40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
