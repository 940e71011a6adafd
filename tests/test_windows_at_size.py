"""Windows and their joins where there are many more windows than rows of bounds."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import windows
from corpusmill.plans.queries import QUERIES
from tests.test_plans import plan_of


def test_starts_are_made_by_many_tasks(spark, monkeypatch):
    bounds = spark.createDataFrame([("TRAIN", 0, 10**6), ("VAL", 10**6, 10**6 + 7)], "split string, start_idx long, end_idx long")
    n = F.when(F.col("split") == "TRAIN", 100_000).otherwise(3)
    rows = windows.window_starts(bounds, n)
    assert sorted(r["window_id"] for r in rows.where("split = 'TRAIN'").collect()) == list(range(100_000))
    assert sorted(r["window_id"] for r in rows.where("split = 'VAL'").collect()) == [0, 1, 2]
    each = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(each) > 1
    assert max(each) < 100_000
    monkeypatch.setattr(windows, "CHUNK", 7)
    assert windows.window_starts(bounds, n).exceptAll(rows).count() == rows.exceptAll(windows.window_starts(bounds, n)).count() == 0


def test_what_is_exploded_is_not_broadcast(spark):
    """Few rows of bounds or of the index stand for many windows and blocks."""
    bounds = spark.createDataFrame([("TRAIN", 0, 10**6)], "split string, start_idx long, end_idx long")
    index = spark.range(4).select("id", F.col("id").alias("doc_id"), (F.col("id") * 250_000).alias("global_offset"), F.lit(250_000).cast("long").alias("length"))
    starts = windows.window_starts(bounds, F.lit(50_000))
    for met in (windows.docs_at(starts, index), windows.spans(starts, index, 128)):
        assert "BroadcastHashJoin" not in plan_of(met)
    assert windows.docs_at(starts, index).count() == 50_000
    wide = windows.spans(starts, index, 128, block=16)
    assert wide.exceptAll(windows.spans(starts, index, 128)).count() == windows.spans(starts, index, 128).exceptAll(wide).count() == 0


@pytest.mark.parametrize("name", ["window_asof_doc", "window_doc_overlap", "packed_windows", "segment_position_ids", "window_batches"])
def test_queries_of_windows_broadcast_one_row_only(spark, sf_dir, name):
    """That row is the number of documents, which a cross join takes."""
    assert "BroadcastHashJoin" not in plan_of(QUERIES[name](spark, sf_dir))
