import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
])
PROSE = "the quick brown fox {} jumps over the lazy dog while rain falls on {} quiet hills near {} "


def prose(n):
    return "".join(PROSE.format(n * 7 + i, n + i * 3, i * n) for i in range(8))


@pytest.fixture(scope="session")
def docs(spark):
    """Null ids and texts, empty, short, long and repeated texts, and a clashing column."""
    texts = [
        (1, prose(1)), (2, prose(1)), (3, prose(2) + "passage " * 40), (4, "x" + prose(2)),
        (5, None), (6, ""), (7, "é" * 150), (8, "é" * 150), (9, "one"), (9, "one"),
        (None, prose(3)), (10, prose(3)), (11, "a" * 5000), (12, " \n\t "), (13, prose(1)[:-4] + "end"),
        (10, prose(4)),
    ]
    rows = [(i, t, "en", "s", len(t or ""), "clash") for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
