"""Files of a corpus: listing, seeded sampling, Parquet and JSON lines with explicit schemas."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import parent_name


def list_files(spark: SparkSession, folder: str, suffix: str = ".parquet", recursive: bool = False) -> list[str]:
    """Paths of the files in a folder of any store that Spark reads, in order."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found, statuses = [], path.getFileSystem(conf).listFiles(path, recursive)
    while statuses.hasNext():
        name = statuses.next().getPath().toString()
        if name.endswith(suffix):
            found.append(name)
    return sorted(found)


def sample_files(paths: list[str], n: int, seed: int = 42) -> list[str]:
    """n of the paths without replacement, the same for one seed whatever order they come in; an error if there are fewer."""
    if n > len(paths):
        raise ValueError(f"{n} files asked for, there are {len(paths)}")
    return sorted(sorted(paths), key=lambda p: hashlib.md5(f"{seed}:{p}".encode()).hexdigest())[:n]


def read_documents(spark: SparkSession, paths: list[str], schema: T.StructType, lang: str) -> DataFrame:
    """Documents of Parquet files with lang, source (the whole path) and doc_id.

    Only the schema's columns are read. doc_id is the file's place among the sorted paths times 2^32, and the row's number in its
    file: it rises in the order of files and rows and hangs on no setting of the read, but leaves gaps.
    """
    docs = spark.read.schema(schema).parquet(*paths).select("*", F.col("_metadata.file_path").alias("source"), F.col("_metadata.row_index").alias("_row"))
    # Paths as Spark itself spells them, whatever the spelling they were given in.
    spelt = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in sorted(set(paths))]
    spelt = [p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString() for p in spelt]
    places = spark.createDataFrame(list(enumerate(spelt)), "_place long, _path string")
    placed = docs.join(places, docs["source"] == places["_path"])
    return placed.select(*[f.name for f in schema.fields], F.lit(lang).alias("lang"), "source", (F.shiftleft("_place", 32) + F.col("_row")).alias("doc_id"))


def read_json_lines(spark: SparkSession, folder: str, schema: T.StructType, recursive: bool = True) -> DataFrame:
    """Records of all *.jsonl files with dataset, the name of the folder that the file lies in, and path."""
    reader = spark.read.schema(schema).option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", str(recursive).lower())
    rows = reader.json(folder).withColumn("path", F.input_file_name())
    return rows.withColumn("dataset", parent_name(F.col("path")))


def head_rows(docs: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by the key."""
    return docs.orderBy(key).limit(n)


def scan_sizes(spark: SparkSession, paths: list[str], batch_rows: int = 10_000) -> DataFrame:
    """path, n_rows and n_batches of batch_rows for each Parquet file with rows. No column is read: the rows are counted by the footers."""
    sizes = spark.read.parquet(*paths).select(F.col("_metadata.file_path").alias("path")).groupBy("path").agg(F.count("*").alias("n_rows"))
    return sizes.withColumn("n_batches", F.ceil(F.col("n_rows") / batch_rows))
