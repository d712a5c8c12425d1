"""Tables with nulls, empty and long texts, ties, repeats and clashing extra columns."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()),
                     T.StructField("fp", T.StringType()), T.StructField("id", T.StringType()),
                     T.StructField("score", T.StringType()), T.StructField("rank", T.StringType()),
                     T.StructField("position", T.StringType()), T.StructField("label", T.StringType())])


def row(i, text, source="a"):
    return (i, text, "en", source, len(text or ""), "x", "x", "x", "x", "x", "x", "x")


def odd_documents(spark):
    long_text = " ".join(f"word{i % 977} and token{i}" for i in range(30000))
    rows = [row(1, None), row(2, ""), row(3, "  \t\n "), row(4, "one"), row(5, "One"), row(6, "one two"),
            row(7, long_text, "b"), row(8, long_text, "b"), row(9, "ünï cödé 你好 " * 30, None),
            row(10, "idiot trash " * 5, None), row(10, "idiot trash " * 5, None), row(None, "no id here", "c"),
            row(11, 'the api_key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" is here', "c"), row(12, None, None)]
    return spark.createDataFrame(rows, DOCS)


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


def write_tables(path, documents=None, labels=None, spark=None):
    if documents is not None:
        documents.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    if labels is not None:
        labels.write.mode("overwrite").parquet(f"{path}/labels.parquet")
