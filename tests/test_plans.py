"""What the plans must look like: pruned scans, no Python where none is needed, no single task for all rows."""

import re

import pytest
from pyspark.sql import functions as F

from corpusmill import session
from corpusmill.plans.queries import QUERIES

#: Queries whose operators have Arrow functions; all others stay in the JVM.
WITH_PYTHON = {"bpe_doc_tokens", "bpe_decode", "tokens_per_word", "stored_validation", "bpe_full_tokens_per_word", "flat_bytes"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_python_only_where_needed(spark, sf_dir, name):
    assert bool(re.search("Python|Arrow|Pandas", plan_of(QUERIES[name](spark, sf_dir)))) == (name in WITH_PYTHON)


@pytest.mark.parametrize(("name", "columns"), [
    ("word_counts", {"text"}), ("clean_documents", {"doc_id", "text", "lang"}), ("doc_offsets_by_source", {"doc_id", "text", "source"}),
    ("chat_prompts", {"conv_id", "turn", "role", "text"}), ("masked_cross_entropy", {"vec_id", "embedding", "label"}), ("softmax_top_k", {"vec_id", "embedding"}),
])
def test_scans_read_what_they_need(spark, sf_dir, name, columns):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>+(?:\n|$)", QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString())
    read = {c.split(":")[0] for s in schemas for c in re.split(r",(?![^<]*>)", s) if ":" in c}
    assert read == columns


def test_filters_reach_the_scan(spark, sf_dir):
    assert "EqualTo(role,user)" in QUERIES["chat_prompts"](spark, sf_dir)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["word_counts", "byte_pair_counts"])
def test_counts_are_summed_before_the_shuffle(spark, sf_dir, name):
    assert "partial_" in plan_of(QUERIES[name](spark, sf_dir))


def test_small_tables_in_few_files_are_dealt_to_all_cores(spark, tmp_path, monkeypatch):
    def shuffles(df):
        return plan_of(session.spread(df)).count("Exchange")

    rows = spark.range(400_000).withColumn("x", F.md5(F.col("id").cast("string")))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    rows.repartition(8).write.parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / n)) for n in ("one", "many"))
    assert (shuffles(one), shuffles(many), shuffles(one.limit(0)), shuffles(spark.read.parquet(str(tmp_path / "one")).where("id < 0"))) == (1, 0, 0, 1)
    assert session.spread(one).agg(F.count("*"), F.sum("id"), F.countDistinct("x")).first() == rows.agg(F.count("*"), F.sum("id"), F.countDistinct("x")).first()
    monkeypatch.setattr(session, "SPREAD_BYTES", 1000)
    assert shuffles(one) == 0


def test_materialized_tables_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame(spark.sparkContext.parallelize(range(7)).map(count).map(lambda x: (x,)), "x long")
    before = seen.value
    kept = session.materialized(rows)
    assert seen.value - before == 7
    assert sorted(r["x"] for r in kept.collect()) == list(range(7))
    assert seen.value - before == 7
