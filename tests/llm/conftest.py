import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, shard string, comp string, n int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source) with extra columns whose names clash with the operators' own."""

    def of(rows):
        full = [(*r, *[None] * (4 - len(r))) for r in rows]
        return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "x", "y", 2) for i, t, lang, s in full], DOCS)

    return of


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in any column, empty and long texts, repeated rows, ties."""
    long = " ".join(f"word{i % 977} the{i % 31}" for i in range(30_000))
    return make([(1, None, None, None), (2, "", "en", "a"), (3, "Same text here", "en", "a"), (4, "same TEXT here", None, "b"), (4, "same TEXT here", None, "b"), (None, "no id", "de", None), (None, None, None, None), (5, long, "fr", "a"), (6, "  \n\t ", "en", "a"), (7, "123 456 !!", "en", "a"), (8, "éÉ ß 日本語", "de", "c")])
