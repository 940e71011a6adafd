"""A session with this library's defaults, and what workers need to import it."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: A table of at most so many bytes is dealt anew where its files are fewer than the cores; a task gets TASK_BYTES of it or more.
SPREAD_BYTES, TASK_BYTES = 64 << 20, 1 << 20


def build_session(app: str = "corpusmill", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """UTC, adaptive plans, Arrow. The shuffle partitions are left to the cluster unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    options = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    if shuffle_partitions:
        options["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; one of our own only where that is unset and all tasks run on this machine.

    A cluster without the setting is an error: its executors could not read each other's folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialized(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: computed once, its lineage cut, a lost executor costs no earlier stage.

    The table is deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/corpusmill-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    df.write.parquet(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows of files as they are, but of a small table in few files dealt to all cores: a row group is read by one task, and what
    follows would stay in it. Larger tables, and those of enough files, are left alone, so nothing large is shuffled for it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SPREAD_BYTES or len(df.inputFiles()) >= cores:
        return df
    tasks = min(cores, -(-size // TASK_BYTES))
    return df.repartition(tasks) if tasks > 1 else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
