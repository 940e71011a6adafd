"""Awkward tables that every operator must take."""

from pyspark.sql import functions as F

#: Names that operators use inside; documents may have columns of these names.
CLASHES = ["id", "words", "score", "labels", "key", "rep", "value", "windows", "length", "start", "rank", "norm", "base", "item_id", "n_shingles", "whole", "spans"]
LONG = " ".join(f"word{i * i % 7919} of" for i in range(15_000))
EDGE_TEXTS = [(None, None), (None, "a text without an id"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (5, LONG), (6, LONG), (7, "é 😀 ß " * 40), (8, "x" * 200_000), (9, "9" * 50_000 + "@" * 1000 + "." * 1000)]


def edge_docs(spark):
    df = spark.createDataFrame(EDGE_TEXTS, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES})


def no_docs(spark):
    return edge_docs(spark).where("false")


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
