import pytest


@pytest.fixture
def docs(spark):
    """Rows as documents: (doc_id, text[, lang]), with columns whose names clash with the operators' own."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", 0.5, 7) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, score double, part int")

    return make
