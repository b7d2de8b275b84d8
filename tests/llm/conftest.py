import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents (doc_id, text, lang, source, n_chars) beside columns whose names operators use themselves."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), 1, "h", 2, "k", "c", 3) for i, t, s in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, row int, hash string, n int, key string, cls string, mark int")

    return make
