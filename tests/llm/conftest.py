"""Small tables for the tests of the corpus operators."""

import pytest
from tables import DOC_SCHEMA, odd_texts


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts under distinct, equal and null ids, with extra columns of clashing names."""
    rows = []
    for i, text in enumerate(odd_texts()):
        rows.append((i, text, "en" if i % 2 else None, "s", 0))
    rows += [(3, "one", None, None, None), (3, "one", None, None, None), (None, "a b c d e", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    return df.selectExpr("*", "'x' AS score", "1 AS n_tokens", "2 AS node", "'y' AS spans", "3 AS `start`", "4 AS component")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
