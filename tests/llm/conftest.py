import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, rank int, slot long, n int, sig long, key long, kind string, token string, __k string, mark long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    long = " ".join(f"word{i % 977} x{i * i % 1009}" for i in range(40_000))
    words = "the quick brown fox jumps over the lazy dog while it rains in spain and france today"
    texts = [
        (1, words, "en", "a"), (2, words, "en", "a"), (3, words.replace(" ", "  \n"), None, "b"), (4, None, "en", None), (5, "", None, "b"), (6, "", "fr", "b"),
        (7, long, "en", "a"), (8, long + " end", "en", "a"), (9, "un deux trois quatre cinq", "fr", "a"), (9, "un deux trois quatre cinq", "fr", "a"),
        (10, "a b", "fr", "c"), (11, "A  B", "fr", "c"), (12, "12345 67890 !!!", None, ""), (13, "\t\n \x0b", "en", "a"), (None, "no id here at all", None, None),
        (14, "7" * 3000 + " " + "4 " * 3000, None, "a"), (15, "a@b.c.d..e x@y.z@q.r 1.2.3.4.5.6.7.8 +1 (743) 555-3824 4539 1488 0343 6467 256.1.1.1", "en", "a"),
        (16, "Ünïcode 日本語 🙂🙂 ñ@b.c", "en", "a"), (17, "a." * 4000 + "@" + "b.c" * 4000, "en", "a"),
    ]
    return spark.createDataFrame([(i, t, lang, s, None, 1, 2, 3, 4, 5, 6, "k", "t", "z", 7) for i, t, lang, s in texts], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id < 0")


@pytest.fixture(scope="session")
def texts(sf):
    import pandas as pd

    return pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id").reset_index(drop=True)
