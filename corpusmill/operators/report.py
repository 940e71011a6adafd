"""Tokenizer quality and checks of stored tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.order import shuffle_key
from corpusmill.functions.text import word_count
from corpusmill.session import materialized


def tokens_per_word(docs: DataFrame, text: Column, n_tokens: Column, by: list[str]) -> DataFrame:
    """avg_tokens_per_word, the mean of each document's ratio, and micro_tokens_per_word, the ratio of sums. Empty texts are left out."""
    counted = docs.select(*by, word_count(text).alias("w"), n_tokens.alias("t")).where("w > 0")
    return counted.groupBy(*by).agg(F.avg(F.col("t") / F.col("w")).alias("avg_tokens_per_word"), (F.sum("t") / F.sum("w")).alias("micro_tokens_per_word"), F.count("*").alias("n_docs"))


def round_trip(docs: DataFrame, key: str, original: Column, decoded: Column, by: list[str], examples: int = 5) -> DataFrame:
    """n_docs, n_failures and the first failing keys, joined by commas. The best few of each task are kept, never all.

    What is encoded and decoded is one flag for each document, kept for both counts and keys.
    """
    checked = materialized(docs.select(*by, F.col(key).alias("k"), (~original.eqNullSafe(decoded)).alias("failed")))
    counts = checked.groupBy(*by).agg(F.count("*").alias("n_docs"), F.count_if("failed").alias("n_failures"))
    first = checked.where("failed").withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("k"))).where(F.col("r") <= examples)
    shown = first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda x: x.cast("string")), ",").alias("first_failures"))
    return counts.join(shown, by, "left").withColumn("first_failures", F.coalesce("first_failures", F.lit("")))


def failure_examples(docs: DataFrame, key: str, original: str, decoded: str, n: int = 5) -> DataFrame:
    """index, original and decoded of the first n failures."""
    failed = docs.where(~F.col(original).eqNullSafe(F.col(decoded))).orderBy(key).limit(n)
    return failed.select(F.col(key).alias("index"), F.col(original).alias("original"), F.col(decoded).alias("decoded"))


def validate_stored(docs: DataFrame, stored: DataFrame, encoded: Column, n_sample: int, seed: int = 42) -> DataFrame:
    """source, n_checked, n_missing and n_mismatch of n_sample documents of each source, drawn by a seeded order.

    docs: source, doc_id and what encoded needs; stored: doc_id and tokens. Any difference counts, also in length.
    """
    draw = Window.partitionBy("source").orderBy(shuffle_key(F.col("doc_id"), seed), "doc_id")
    drawn = docs.withColumn("_r", F.row_number().over(draw)).where(F.col("_r") <= n_sample).withColumn("_fresh", encoded)
    met = drawn.join(stored.select(F.col("doc_id").alias("_id"), F.col("tokens").alias("_stored")), F.col("doc_id") == F.col("_id"), "left")
    return met.groupBy("source").agg(F.count("*").alias("n_checked"), F.count_if(F.col("_id").isNull()).alias("n_missing"), F.count_if(F.col("_id").isNotNull() & ~F.col("_stored").eqNullSafe(F.col("_fresh"))).alias("n_mismatch"))
