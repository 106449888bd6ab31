import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     T.StructField("row", T.StringType()), T.StructField("key", T.StringType()), T.StructField("text_sha", T.StringType()),
                     *[T.StructField(c, T.StringType()) for c in ("copies", "same", "K_ID", "m_key", "rank", "part_no", "block", "digest", "n")]])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names the operators use themselves."""
    def make(rows):
        full = [(i, t, *(more + (None,) * (3 - len(more))), "x", "y", "z", *"abcdefghi") for i, t, *m in rows for more in [tuple(m)]]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and white-space texts, repeated rows, one long text, copies, other scripts, a special token."""
    base = "the quick brown fox jumps over the lazy dog while seven wizards box with quick jackdaws near the old mill "
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "Hello world", "en", "a"), (5, "hello   World ", "en", "b"),
        (6, "Hello world", "en", "a"), (6, "Hello world", "en", "a"), (None, "Hello world", "en", "b"), (None, None, None, "a"),
        (7, base * 3, "en", "a"), (8, base * 3 + "tail", "en", "b"), (9, base.upper() * 3, "en", "c"), (10, "привет мир это русский текст", "ru", "b"),
        (11, "日本語のテキスト 123 ١٢٣", "ja", None), (12, "a <|endoftext|> b's  c\n\n d", "en", "a"), (13, "word " * 20000, "en", "c"),
        (14, "émigré naïve façade 😀😀 ꟎", "fr", "a"), (15, "12345 !!! ???", "en", "b"), (16, base + base[:40], "en", "c"), (17, "one two three", "en", "a"),
        (18, "One two  three", "en", "b"), (19, "x" * 50000, "en", "a"), (20, "\x00\x1c odd \x85 bytes ", "en", "a"),
    ]


@pytest.fixture(scope="session")
def sample_rows(spark):
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
