import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text[, source]) rows, in the columns of the given tables and two that clash."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", 1) for r in rows]
        return spark.createDataFrame(full, DOCS + ", kept string, row int").repartition(3)

    return make


@pytest.fixture(scope="session")
def given(spark, small):
    return lambda name: spark.read.parquet(f"{small}/{name}.parquet")
