import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (id, text) pairs, with columns whose names the operators use inside."""

    def make(pairs, extra=False):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs], SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            for c in ("id", "key", "items", "payload", "line", "component", "at", "z", "score"):
                df = df.withColumn(c, F.lit(1))
        return df

    return make


@pytest.fixture(scope="session")
def odd():
    """Null, empty, blank, short, repeated and very long texts, and a null id."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30000))
    return [(1, None), (2, ""), (3, " \n\t\n"), (4, "one"), (5, "a b\nc d\na b"), (5, "a b\nc d\na b"), (6, long), (7, long), (None, "no id here"), (8, "x" * 50000), (9, "é ß 漢字 🙂 end")]
