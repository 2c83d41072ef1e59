import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """A table from (id, text) pairs, with clashing extra columns on demand."""

    def make(rows, *extra):
        out = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
        from pyspark.sql import functions as F

        for name in extra:
            out = out.withColumn(name, F.lit("x"))
        return out

    return make


@pytest.fixture(scope="session")
def vocabulary():
    from tidewell.llm.queries import vocabulary

    return vocabulary()
