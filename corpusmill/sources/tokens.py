"""Token stores: Parquet tables of token arrays, and flat files of 16-bit ids with their metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.corpus import doc_offsets

#: Tokens of one flat file, but for the last document's; tokens that a scan reads at once.
FLAT_TOKENS, SCAN_TOKENS = 1 << 26, 1 << 20
#: Ids of a flat file are unsigned 16-bit numbers.
MAX_FLAT_ID = 65_535


def write_store(tokens: DataFrame, path: str) -> None:
    """source, doc_id and tokens as Parquet, a folder for each source."""
    tokens.select("source", "doc_id", "tokens").write.mode("overwrite").partitionBy("source").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def token_slice(tokens, start, n):
    """n tokens from place start, counted from 0."""
    return F.slice(tokens, start + 1, n)


def packed_bytes(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id and the tokens' little-endian 16-bit bytes; an error for an id that does not fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column(1):
                ids = np.asarray(row.as_py() or [], np.int64)
                if len(ids) and (ids.max() > MAX_FLAT_ID or ids.min() < 0):
                    raise ValueError(f"token id {ids.max()} does not fit 16 bits")
                out.append(ids.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "raw"])

    return tokens.select(F.col(id_col).cast("long").alias("id"), "tokens").mapInArrow(run, "id long, raw binary")


def unpacked_tokens(rows: DataFrame, raw: str = "raw", id_col: str = "id") -> DataFrame:
    """id and tokens of packed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x.as_py() or b"", "<u2").astype(np.int32).tolist() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "tokens"])

    return rows.select(F.col(id_col).cast("long").alias("id"), raw).mapInArrow(run, "id long, tokens array<int>")


def store_metadata(offsets: DataFrame, langs: DataFrame | None = None) -> DataFrame:
    """One row for each source: total_tokens and documents, an array of offset and length in order. offsets: see doc_offsets()."""
    rows = offsets.groupBy("source").agg(F.sum("length").alias("total_tokens"), F.transform(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length"))), lambda d: F.struct(d["offset"].alias("offset"), d["length"].alias("length"))).alias("documents"))
    return rows.join(langs, "source", "left") if langs is not None else rows


_FLAT = "source string, part long, path string, first long, n_tokens long"


def write_flat(store: DataFrame, folder: str, file_tokens: int = FLAT_TOKENS) -> DataFrame:
    """Flat files of the token stream of each source, documents by id, and their list: source, part, path, first (the stream's
    tokens before the file) and n_tokens. store: source, doc_id and tokens.

    A long stream is cut into files of some file_tokens, always between documents. A task writes its rows as they come, under a name
    of its own that becomes the file's name at the end, so that a task that is lost or run twice leaves no half a file. folder is a
    path or an address that both Spark and pyarrow know; the list is kept there as Parquet. Documents with null tokens are left out.
    """
    store = store.where(F.col("tokens").isNotNull())
    lengths = store.select("source", "doc_id", F.size("tokens").cast("long").alias("length"))
    placed = store.select("source", "doc_id", "tokens").join(doc_offsets(lengths), ["source", "doc_id"]).withColumn("part", F.floor(F.col("offset") / file_tokens))
    keyed = placed.select(F.sha2("source", 256).alias("name"), "source", "part", "offset", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, store_fs, root = TaskContext.get().taskAttemptId(), *_filesystem(folder)
        current, out, done = None, None, []

        def close() -> None:
            out.close()
            source, part, name, first, n = current
            store_fs.move(f"{root}/{name}-{part}.bin.{attempt}", f"{root}/{name}-{part}.bin")
            done.append((source, part, f"{root}/{name}-{part}.bin", first, n))

        for batch in batches:
            for name, source, part, offset, row in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                if current is None or current[:3] != (source, part, name):
                    if current is not None:
                        close()
                    store_fs.create_dir(root, recursive=True)
                    current, out = (source, part, name, offset, 0), store_fs.open_output_stream(f"{root}/{name}-{part}.bin.{attempt}")
                ids = np.asarray(row.values, np.int64)
                if len(ids) and (ids.max() > MAX_FLAT_ID or ids.min() < 0):
                    raise ValueError(f"token id {ids.max()} does not fit 16 bits")
                out.write(ids.astype("<u2").tobytes())
                current = (*current[:4], current[4] + len(ids))
        if current is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["source", "part", "path", "first", "n_tokens"])

    written = keyed.repartition("name", "part").sortWithinPartitions("name", "part", "offset").mapInArrow(run, _FLAT)
    written.write.mode("overwrite").parquet(f"{folder}/files")
    return store.sparkSession.read.parquet(f"{folder}/files")


def _filesystem(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder) if ":/" in folder else (pa.fs.LocalFileSystem(), folder)


def flat_slices(wanted: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """wanted with tokens: n tokens of a source's stream from start. What one row asks for must lie in one file, as each document does.

    files: what write_flat() gave. Only the bytes that are asked for are read.
    """
    rows = wanted.join(files.select(F.col("source").alias("_source"), "path", "first", "n_tokens"), F.col("source") == F.col("_source"))
    inside = rows.where((F.col("start") >= F.col("first")) & (F.col("start") + F.col("n") <= F.col("first") + F.col("n_tokens")))
    names = wanted.columns
    asked = inside.select(*names, "path", (F.col("start") - F.col("first")).alias("_at"), F.col("n").alias("_n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store_fs, _ = _filesystem(folder)
        for batch in batches:
            found = []
            for path, at, n in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns - 3, batch.num_columns)), strict=True):
                with store_fs.open_input_file(path) as f:
                    f.seek(2 * at)
                    found.append(np.frombuffer(f.read(2 * n), "<u2").astype(np.int32))
            kept = [batch.column(i) for i in range(batch.num_columns - 3)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.list_(pa.int32()))], [*names, "tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields)
    return asked.mapInArrow(run, f"{fields}, tokens array<int>")


def read_flat(spark: SparkSession, folder: str, scan_tokens: int = SCAN_TOKENS) -> DataFrame:
    """source, start, n and tokens: the whole streams of flat files, in pieces of at most scan_tokens."""
    files = spark.read.parquet(f"{folder}/files")
    starts = F.expr(f"sequence(first, first + n_tokens - 1, {scan_tokens}L)")
    pieces = files.where("n_tokens > 0").select("source", F.explode(starts).alias("start"), (F.col("first") + F.col("n_tokens")).alias("end"))
    return flat_slices(pieces.select("source", "start", F.least(F.lit(scan_tokens), F.col("end") - F.col("start")).alias("n")), files, folder)
