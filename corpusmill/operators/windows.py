"""Packed training windows: sampled starts, the document at a start, the documents that a window spans, its tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.order import pick

#: Windows that one row is exploded to.
CHUNK = 1 << 14


def window_starts(bounds: DataFrame, n_windows: Column, seed: int = 42) -> DataFrame:
    """window_id, split and start: n_windows starts for each split, uniform in its bounds, each picked by split and window_id.

    n_windows may depend on the bounds. A split without room gives none. Chunks of ids are dealt to the cores before they are
    exploded, so that the few rows of bounds neither hold all ids in an array nor leave them to one task.
    """
    room = bounds.where("end_idx > start_idx").withColumn("n", n_windows.cast("long"))
    chunks = room.where("n > 0").select("split", "start_idx", "end_idx", "n", F.explode(F.expr(f"sequence(0L, n - 1, {CHUNK}L)")).alias("low"))
    dealt = chunks.repartition(2 * bounds.sparkSession.sparkContext.defaultParallelism, "split", "low")
    numbered = dealt.select("split", "start_idx", "end_idx", F.explode(F.expr(f"sequence(low, least(low + {CHUNK}L, n) - 1)")).alias("window_id"))
    key = F.concat_ws(":", "split", F.col("window_id").cast("string"))
    return numbered.select("window_id", "split", (F.col("start_idx") + pick(key, F.col("end_idx") - F.col("start_idx"), seed)).alias("start"))


def _blocks(begin: Column, end: Column, size: int) -> Column:
    """Numbers of the blocks that [begin, end) touches."""
    return F.sequence(F.floor(begin / size), F.floor((end - 1) / size))


def docs_at(starts: DataFrame, index: DataFrame, block: int = 4096) -> DataFrame:
    """starts with the document that holds each start and the start's place in it: a backward as-of join.

    Documents are dealt to the blocks of the token stream that they touch, so that it is an equal join on the block. Neither side is
    ever broadcast: the planner takes what explode() makes for as small as its input.
    """
    docs = index.where("length > 0").select("doc_id", "global_offset", "length", F.explode(_blocks(F.col("global_offset"), F.col("global_offset") + F.col("length"), block)).alias("block"))
    asked = starts.withColumn("block", F.floor(F.col("start") / block))
    inside = (F.col("start") >= F.col("global_offset")) & (F.col("start") < F.col("global_offset") + F.col("length"))
    return asked.join(docs.hint("merge"), "block").where(inside).select(*starts.columns, "doc_id", (F.col("start") - F.col("global_offset")).alias("doc_start"))


def spans(starts: DataFrame, index: DataFrame, ctx_len: int, block: int | None = None) -> DataFrame:
    """window_id, split, start, doc_id, doc_offset, take_from and take: the parts of documents in each window of ctx_len + 1 tokens.

    Both sides are dealt to blocks of some windows; a pair is emitted only in the first block that both touch. Neither side is ever
    broadcast, as in docs_at().
    """
    size = block or 8 * max(ctx_len, 1)
    need = ctx_len + 1
    docs = index.where("length > 0").select("doc_id", "global_offset", "length", F.explode(_blocks(F.col("global_offset"), F.col("global_offset") + F.col("length"), size)).alias("block"))
    asked = starts.select("window_id", "split", "start", F.explode(_blocks(F.col("start"), F.col("start") + need, size)).alias("block"))
    first = F.greatest(F.floor(F.col("start") / size), F.floor(F.col("global_offset") / size))
    begin, end = F.greatest("start", "global_offset"), F.least(F.col("start") + need, F.col("global_offset") + F.col("length"))
    met = asked.join(docs.hint("merge"), "block").where((F.col("block") == first) & (begin < end))
    return met.select("window_id", "split", "start", "doc_id", F.col("global_offset").alias("doc_offset"), (begin - F.col("global_offset")).alias("take_from"), (end - begin).alias("take"))


def packed_windows(starts: DataFrame, index: DataFrame, tokens: DataFrame, ctx_len: int, eos_id: int) -> DataFrame:
    """window_id, split, start, input_tokens, output_tokens, segment_ids and position_ids. tokens: doc_id and tokens.

    Documents travel as blocks of ctx_len tokens: a window meets the few that it touches, however long the document.
    """
    size = max(ctx_len, 1)
    place, last = F.col("part_no") * size, F.col("take_from") + F.col("take")
    blocks = token_blocks(tokens, size)
    parts = spans(starts, index, ctx_len).withColumn("part_no", F.explode(_blocks(F.col("take_from"), last, size))).join(blocks.hint("merge"), ["doc_id", "part_no"])
    low = F.greatest(F.col("take_from") - place, F.lit(0))
    cut = parts.select("window_id", "split", "start", F.struct("doc_offset", "part_no", F.slice("block", low.cast("int") + 1, (F.least(last - place, F.lit(size)) - low).cast("int")).alias("part")).alias("p"))
    whole = cut.groupBy("window_id", "split", "start").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"])).alias("t"))
    shifted = whole.select("window_id", "split", "start", F.slice("t", 1, F.size("t") - 1).alias("input_tokens"), F.slice("t", 2, F.size("t") - 1).alias("output_tokens"))
    return shifted.withColumn("segment_ids", segment_ids(F.col("input_tokens"), eos_id)).withColumn("position_ids", position_ids(F.col("segment_ids")))


def window_batches(windows: DataFrame, batch_size: int, drop_last: bool = False) -> DataFrame:
    """split, batch_id, n_windows, and window_id and the four arrays of packed windows, each as an array in the order of window_id.

    Windows are numbered in their split already, so that only those of one batch meet.
    """
    arrays = [c for c in ("window_id", "input_tokens", "output_tokens", "segment_ids", "position_ids") if c in windows.columns]
    grouped = windows.withColumn("batch_id", F.floor(F.col("window_id") / batch_size)).groupBy("split", "batch_id").agg(F.array_sort(F.collect_list(F.struct(*arrays))).alias("w"))
    if drop_last:
        grouped = grouped.where(F.size("w") == batch_size)
    return grouped.select("split", "batch_id", F.size("w").alias("n_windows"), *(F.col(f"w.{c}").alias(c) for c in arrays))


def token_blocks(tokens: DataFrame, size: int) -> DataFrame:
    """doc_id, part_no, from 0, and block of each size tokens; the last block may be shorter. No tokens are one empty block.

    Slices are taken outside of lambdas, where each would read the whole document. explode_outer() gives the planner no filter on
    tokens, which it would push below them and so compute them twice.
    """
    n = F.greatest(F.floor((F.size("tokens") - 1) / size), F.lit(0)).cast("int")
    each = tokens.select("doc_id", "tokens", F.explode_outer(F.sequence(F.lit(0), n)).alias("part_no"))
    return each.select("doc_id", "part_no", F.slice("tokens", F.col("part_no") * size + 1, F.lit(size)).alias("block"))


def _numbers(array: Column) -> Column:
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(F.array().cast("array<int>"))


def _runs(begins: Column, n: Column, body: Callable[[Column, Column], Column]) -> Column:
    """body(number from 0, length) of each run, one behind the other. begins: where runs begin, the first at 0; n: where the last ends."""
    sizes = F.zip_with(begins, F.concat(F.slice(begins, F.lit(2), F.size(begins)), F.array(n)), lambda a, b: b - a)
    return F.flatten(F.transform(sizes, lambda size, k: body(k, size)))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def segment_ids(tokens: Column, eos_id: int) -> Column:
    """For each token, 1 and the number of ends of documents before it; in time linear in the tokens."""
    ends = lambda t: F.transform(F.filter(_numbers(t), lambda i: F.get(t, i) == eos_id), lambda i: i + 1)
    return _once(tokens, lambda t: _runs(F.concat(F.array(F.lit(0)), ends(t)), F.size(t), lambda k, size: F.array_repeat(k + 1, size)))


def position_ids(segments: Column) -> Column:
    """Places counted from 0 within each run of equal segment ids; in time linear in the segments."""
    begins = lambda s: F.filter(_numbers(s), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    return _once(segments, lambda s: _runs(begins(s), F.size(s), lambda k, size: F.sequence(F.lit(0), size - 1)))
