import duckdb
import pytest

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def documents(duck):
    """``doc_id`` to text of the smallest table."""
    return dict(duck.sql("select doc_id, text from documents").fetchall())


@pytest.fixture
def docs(spark):
    """A frame of documents from ``(doc_id, text)`` with extra columns of clashing names."""

    def make(rows):
        full = [(i, t, "x", 1, "y", None) for i, t in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, row_id string, n int, hub string, findings string"
        )

    return make
