import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, node string, key long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, "s", None, "r", "n", 1) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def small_docs(spark):
    """All documents of the smallest tables, as (doc_id, text) and as a table."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return [(r.doc_id, r.text) for r in table.collect()], table
