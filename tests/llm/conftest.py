import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and columns whose names operators use themselves."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 59),
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 59),
        (2, None, "en", "a", None),
        (3, "", "en", None, 0),
        (4, long, None, "b", len(long)),
        (5, " \t\n\x0b\x0c\r ", "de", "b", 7),
        (None, "der schnelle braune fuchs springt über den faulen hund", "de", None, 54),
        (6, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"\n123 456', "fr", "c", 60),
        (7, "123 456 !!!", "fr", "c", 11),
    ]
    df = spark.createDataFrame([(*r, "x", 5, [1]) for r in rows], f"{DOCS}, size string, copies int, spans array<int>")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
