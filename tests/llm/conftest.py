import pytest


@pytest.fixture
def docs_of(spark):
    """documents from (doc_id, text) pairs, with columns whose names clash with those of operators."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "x", "y", 1, "z") for i, t in rows],
            "doc_id long, text string, key string, `row` string, n_lines int, id string")
    return make


@pytest.fixture(scope="session")
def docs_of_any(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
