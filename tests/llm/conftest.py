import pytest


@pytest.fixture
def documents(spark):
    """Make documents from [(doc_id, text), ...] or longer rows."""

    def make(rows, extra=""):
        rows = [(*r, None, "s", 0) if len(r) == 2 else r for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + extra)

    return make
