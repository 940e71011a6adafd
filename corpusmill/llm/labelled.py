"""A bounded, deterministic sample of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import bounded_batches, crc_fold


#: Bytes of text that a classifier learns from at most.
MAX_BYTES = 64 << 20


def training_texts(docs: DataFrame, labels: DataFrame, label: str, limit: int, per_class: int | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """text and label (0 or 1) of at most limit labelled documents outside the held-out fold, the first by a hash of the id.

    per_class bounds the documents with label 1 too; of the documents in that order, those stay whose texts, and all before, have
    max_bytes together at most. Documents without text, null ids and labels other than 0 and 1 are left out; of
    several labels of one id the largest counts.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (crc_fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = (F.xxhash64("doc_id"), "doc_id")
    if per_class is None:
        picked = chosen.orderBy(*order).limit(limit)
    else:
        picked = chosen.where("label = 1").orderBy(*order).limit(per_class).unionByName(chosen.where("label = 0").orderBy(*order).limit(min(limit - per_class, limit)))
    # At most limit rows of two numbers: small enough for every executor, whatever the corpus.
    own = bounded_batches(docs).select(F.col("doc_id").alias("own_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = own.join(F.broadcast(picked), own["own_id"] == picked["doc_id"])
    so_far = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(*order, "text"))
    return found.withColumn("so_far", so_far).where(F.col("so_far") <= max_bytes).select(F.col("own_id").alias("doc_id"), "text", "label")
