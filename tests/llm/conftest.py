import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


@pytest.fixture
def docs(spark):
    """docs([(id, text), ...]) with the other columns filled in, nulls and clashing names as asked."""

    def make(pairs, source="a"):
        rows = [(i, t, "en", source if not isinstance(source, dict) else source.get(i), len(t or "")) for i, t in pairs]
        return _frame(spark, rows, DOCS)

    return make


@pytest.fixture
def frame(spark):
    return lambda rows, ddl: _frame(spark, rows, ddl)


@pytest.fixture
def odd_texts():
    """Null, empty, blank, repeated, short, and one very long text."""
    long_text = " ".join(f"word{i % 5000}" for i in range(40_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "a b c d e f g h i j k l"), (6, long_text), (7, long_text)]


__all__ = ["T"]
