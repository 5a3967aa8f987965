import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece int, label int, hash long, node long, path string, score double"


@pytest.fixture()
def docs_of(spark):
    """Documents with columns of clashing names, from (doc_id, text[, lang]) rows."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None, 7, 7, 7, 7, "p", 0.5) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture()
def odd_rows():
    """Null and empty texts, a null id, repeated rows, no letters, a very long text."""
    return [
        (1, None), (2, ""), (3, " \n\t "), (None, "the cat sat on the mat"), (5, "the cat sat on the mat"),
        (5, "the cat sat on the mat"), (6, "12 !? 34"), (7, "a"), (8, "word " * 60_000), (9, "x" * 300_000), (10, "naïve Ärger 5kg")]
