"""From documents to packed training sequences: toxicity, near duplicates, benchmark passages, personal data, packing.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import load, path_of_stored, scratch_until, stored
from corpusmill.llm.decontam import contains_item
from corpusmill.llm.near_dup import keep_first
from corpusmill.llm.packing import pack
from corpusmill.llm.pii import redact_pii
from corpusmill.llm.toxicity import THRESHOLD, toxicity_of, train_toxicity

#: Near duplicates of this similarity, in percent, are one group.
SIMILARITY = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window scores below the threshold."""
    model = train_toxicity(docs, load(spark, sf_dir, "labels"))
    return docs.where(toxicity_of(F.col("text").cast("string"), model) < THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_first(docs, SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return docs.where(~contains_item(F.col("text").cast("string"), load(spark, sf_dir, "benchmark")))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    hidden = redact_pii(docs)
    if "n_chars" in hidden.columns:
        hidden = hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return hidden.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", hide_personal_data),
    ("packing", pack_sequences),
]

#: Trained networks, signatures and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage keeps for itself is deleted once its result is written."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch_until(spark) as keep:
            docs = stored(stage(spark, docs, sf_dir))
            keep.add(path_of_stored(docs))
    return STAGES[-1][1](spark, docs, sf_dir)
