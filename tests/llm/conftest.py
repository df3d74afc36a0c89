import pytest


@pytest.fixture
def table(spark):
    """Build a DataFrame from rows and a DDL schema, over a few partitions."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(texts):
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
