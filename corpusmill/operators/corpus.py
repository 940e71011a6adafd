"""Token store offsets, the shuffled global index, and the split of documents into training and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.order import shuffle_key
from corpusmill.session import materialized

#: Ids of one block of a running sum within a source; hex digits of a block of the shuffled order.
BLOCK_IDS, BLOCK_DIGITS = 65_536, 3


def running_sum(df: DataFrame, value: str, block: Column, order: list, groups: list[str] | None = None, name: str = "offset") -> DataFrame:
    """df with the exclusive running sum of value in the given order, within groups, and the row's number from 0 as <name>_pos.

    block must rise with the order. Blocks are summed up first, the few block sums are run through, and only rows of one block
    meet in one task: neither a whole source nor the whole table ever does.
    """
    groups = groups or []
    blocked = df.withColumn("_block", block)
    sums = blocked.groupBy(*groups, "_block").agg(F.sum(value).alias("_sum"), F.count("*").alias("_count"))
    before = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*groups, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"), F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(*groups, "_block").orderBy(*order)
    own = blocked.withColumn("_own", F.coalesce(F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_row", F.row_number().over(within) - 1)
    joined = own.join(starts, [*groups, "_block"])
    return joined.select(*df.columns, (F.col("_base") + F.col("_own")).cast("long").alias(name), (F.col("_first") + F.col("_row")).cast("long").alias(f"{name}_pos"))


def doc_offsets(lengths: DataFrame) -> DataFrame:
    """source, doc_id, offset and length: where each document begins in its source's token stream, documents by id."""
    return running_sum(lengths, "length", F.floor(F.col("doc_id") / BLOCK_IDS), ["doc_id"], ["source"]).select("source", "doc_id", "offset", "length")


def shuffled_index(lengths: DataFrame, seed: int = 42) -> DataFrame:
    """pos, doc_id, source, length, local_offset and global_offset of all documents in a seeded order.

    Running sums read their rows twice, and lengths may cost a pass over all texts: both steps start from a written table.
    """
    local = materialized(doc_offsets(materialized(lengths)).withColumnRenamed("offset", "local_offset").withColumn("key", shuffle_key(F.col("doc_id"), seed)))
    run = running_sum(local, "length", F.substring("key", 1, BLOCK_DIGITS), ["key", "doc_id"], name="global_offset")
    return run.select(F.col("global_offset_pos").alias("pos"), "doc_id", "source", "length", "local_offset", "global_offset")


def with_split(index: DataFrame, n_validation: int, position: str = "pos") -> DataFrame:
    """index with split: the last n_validation of the order are VAL, the others TRAIN; with 0, all are TRAIN."""
    total = index.agg(F.count("*").alias("_total"))
    return index.crossJoin(F.broadcast(total)).withColumn("split", F.when(F.col(position) >= F.col("_total") - n_validation, "VAL").otherwise("TRAIN")).drop("_total")  # one row on the right


def split_bounds(index: DataFrame, n_validation: int, ctx_len: int) -> DataFrame:
    """split, start_idx and end_idx: window starts lie in [start_idx, end_idx). A split without room has end_idx = start_idx."""
    parts = with_split(index, n_validation)
    ends = F.col("global_offset") + F.col("length")
    found = parts.agg(
        F.coalesce(F.max(F.when(F.col("split") == "TRAIN", ends)), F.lit(0)).alias("train_end"),
        F.coalesce(F.max(ends), F.lit(0)).alias("total"),
    )
    train = F.struct(F.lit("TRAIN").alias("split"), F.lit(0).cast("long").alias("start_idx"), (F.col("train_end") - ctx_len - 1).alias("end_idx"))
    val = F.struct(F.lit("VAL").alias("split"), F.col("train_end").cast("long").alias("start_idx"), (F.col("total") - ctx_len - 1).alias("end_idx"))
    rows = found.select(F.explode(F.array(train, val)).alias("r")).select("r.*")
    return rows.select("split", "start_idx", F.greatest("start_idx", "end_idx").alias("end_idx"))


def source_files(documents: DataFrame, source: str = "source") -> DataFrame:
    """file_id, from 0 in the order of the sources, and source: one row for each file of the corpus."""
    return documents.select(source).distinct().select((F.row_number().over(Window.orderBy(source)) - 1).alias("file_id"), source)


def numbered(rows: DataFrame, key: str, name: str = "index") -> DataFrame:
    """rows with their number from 0 in the order of a key of whole numbers."""
    run = running_sum(rows.withColumn("_one", F.lit(1)), "_one", F.floor(F.col(key) / BLOCK_IDS), [key], name=name)
    return run.drop("_one", f"{name}_pos")
