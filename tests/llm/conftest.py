import pytest

SCHEMA = "n_chars string, doc_id long, text string, lang string, source string, score string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and extra columns with clashing names."""
    long = " ".join(f"w{i} and, then\nthe {'ab' * (i % 9)}." for i in range(4000))
    rows = [
        (1, None), (2, ""), (3, " "), (4, "a"), (5, "one two  three\t\n\n four"), (5, "one two  three\t\n\n four"), (7, long), (7, "other text"),
        (None, "no id here"), (9, None), (10, "<|endoftext|> ünïcode 日本語 😀😀 'tis don't"), (11, "x" * 3000), (12, "a\0b\0 c"), (13, "same words here now"), (14, "same words here now"),
    ]
    return spark.createDataFrame([(None, i, t, None, None, "clash") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
