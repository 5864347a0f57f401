import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("_key", T.StringType()), T.StructField("id", T.IntegerType()), T.StructField("tokens", T.LongType())])


@pytest.fixture(scope="session")
def corpus(spark):
    """The sf0.001 documents with what is awkward: nulls, empty and long texts, ties, repeated rows, clashing columns."""
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    long = " ".join(f"w{i % 977}" for i in range(30000))
    odd = [(9001, None, "en", "a"), (9002, "", None, None), (9003, " \t\n", "en", "a"), (9004, "one", "en", "a"), (9005, "one", "en", None), (9006, long, "en", "b"), (9007, long + " more", "en", "b"), (9008, "\U0001f600 漢字 ÄÖ", "de", "c"), (9009, "12 34", "fr", "c")]
    rows += odd
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, 2) for r in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus.limit(0)
