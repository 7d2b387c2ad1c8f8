import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long_text = " ".join(f"word{i % 977} runs" for i in range(40_000))
    text = "The quick brown fox jumps over the lazy dog and then it sleeps near the old river bank until morning comes again."
    rows = [
        (1, text, "en", "a"), (2, text, "en", "a"), (2, text, "en", "a"), (3, text + " Indeed so.", None, None), (4, None, "fr", "b"),
        (5, "", "de", "b"), (6, "", "de", "b"), (7, long_text, "en", "c"), (8, long_text + " tail", "en", "c"), (None, text, "en", "c"),
        (None, None, None, None), (9, "\x00\x0b  .,!?   ", "en", None), (10, "one two", "es", "a"), (10, "three different words", "es", "a"),
        (11, "x" * 200_000, "en", "a"), (12, "é ñ ü ß Ω 日本 🎉" * 30, None, "z"),
    ]
    extra = ["row", "node", "n_kept", "_key", "length", "label", "salt", "rank"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *("x" for _ in extra)) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (3, 1, 0), (7, 0, 0), (8, 0, 0), (8, 0, 0), (None, 1, 0), (11, None, 1), (99, 1, 1)], "doc_id long, quality int, toxic int"
    )
