"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import load
from corpusmill.llm.decontam import contaminated
from corpusmill.llm.license_scan import scan_licenses
from corpusmill.llm.near_dup import near_duplicates
from corpusmill.llm.packing import pack
from corpusmill.llm.pii import BASE, KINDS, detect_pii, span_digest
from corpusmill.llm.quality import score_quality, train_quality
from corpusmill.llm.substring import remove_repeats
from corpusmill.llm.topk import top_k
from corpusmill.llm.toxicity import score_toxicity, train_toxicity
from corpusmill.llm.url_filter import judge_urls


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(load(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda kind: F.size(F.filter(F.col("pii_spans"), lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = detect_pii(load(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(count, BASE), F.sha2(span_digest(BASE), 256).alias("base_sha256"), span_digest(KINDS).alias("spans"), F.array_join(F.transform("pii_spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, load(spark, sf_dir, "labels")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, load(spark, sf_dir, "labels")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(load(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(load(spark, sf_dir, "pages"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), percent=85)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_pii": op2_pii,
    "op3_topk": op3_topk,
    "op4_quality": op4_quality,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_near_dup": op9_near_dup,
    "op10_packing": op10_packing,
}
