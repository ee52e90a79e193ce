"""Small documents with the awkward cases: nulls, empty and long texts, ties, repeated rows, other columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("size", T.StringType())])
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def docs(spark, texts, sources=None, ids=None):
    rows = [(ids[i] if ids else i, t, "en", sources[i] if sources else f"s{i % 3}", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


AWKWARD = [None, "", " ", "one", "one", "a b c d e f g", "A B C D E F G", "ünï cödé\nline two\n\nline", LONG, "x" * 5000, "tab\there\x0bvt", "end "]
