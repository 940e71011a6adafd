"""Word counts that grow with arriving documents. The reference has no stream; counts are sums, so batches can be added up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.functions.text import pretokens
from corpusmill.operators.counts import clean_docs


def start_word_counts(docs: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Counts the words of each micro-batch into a folder of its own, so that a batch that runs again replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        words = clean_docs(batch).select(F.explode(pretokens(F.col("clean"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        words.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def total_counts(batches: DataFrame) -> DataFrame:
    """word and n over all batches written so far."""
    return batches.groupBy("word").agg(F.sum("n").alias("n"))
