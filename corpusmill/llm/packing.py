"""Packing by minimum bin slack: a bitset subset-sum picks the multiset of lengths that fills each window closest to its capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import batch_column, bounded_batches, stored
from corpusmill.llm.encoder import encoder

CAPACITY, END_ID = 2048, 1
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Pieces of one length that one task ranks, about; buckets at least.
BUCKET_ROWS, MIN_BUCKETS = 50_000, 64


@dataclass(frozen=True)
class Pattern:
    """So many sequences, each with these counts of lengths."""

    counts: tuple[tuple[int, int], ...]
    repeats: int

    @property
    def total(self) -> int:
        return sum(length * n for length, n in self.counts)


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts of lengths whose sum is the largest that is at most capacity.

    Bit s of a bitset says that the sum s can be reached. A length with n pieces enters as 1, 2, 4... and the rest of them, so
    that shifts number its logarithm. The bitsets are kept, and the counts read off them backwards.
    """
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x in counts if counts[x] and x <= capacity), reverse=True):
        left, size = min(counts[length], capacity // length), 1
        while left and not reach >> capacity & 1:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left, size = left - take, size * 2
        if reach >> capacity & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= length * take
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that together hold each piece once. Each window takes the longest piece left and the fill closest to the rest.

    A pattern is repeated as long as its pieces last, so their number follows the number of lengths, not of pieces.
    """
    left, out = {k: n for k, n in counts.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        fill = best_fill(left, capacity - longest)
        left[longest] += 1
        fill[longest] = fill.get(longest, 0) + 1
        repeats = min(left[k] // n for k, n in fill.items())
        out.append(Pattern(tuple(sorted(fill.items(), reverse=True)), repeats))
        for k, n in fill.items():
            left[k] -= n * repeats
            if not left[k]:
                del left[k]
    return out


def power_of_two(n: int) -> bool:
    return n & (n - 1) == 0


def binary_parts(length: int) -> list[int]:
    """The powers of two that add up to length, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def split_to_powers(pattern: Pattern) -> list[Pattern]:
    """A pattern of powers of two as patterns whose sums are powers of two; largest first, the parts fill them without a rest."""
    left, out = dict(pattern.counts), []
    for size in binary_parts(pattern.total):
        counts = []
        for length in sorted(left, reverse=True):
            take = min(left[length], size // length)
            if take:
                counts.append((length, take))
                left[length], size = left[length] - take, size - length * take
        out.append(Pattern(tuple(counts), pattern.repeats))
    return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pieces_of(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int, list[int]]]:
    """start, length and crc32 of each piece, and of a last, shorter one the crc32 of its binary parts."""
    out = []
    for start in range(0, len(ids), capacity):
        own = ids[start : start + capacity]
        parts = []
        if len(own) < capacity:
            at = 0
            for n in binary_parts(len(own)):
                parts.append(_crc(own[at : at + n]))
                at += n
        out.append((start, len(own), _crc(own), parts))
    return out


def cut(docs: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: str, ranks: str | None) -> DataFrame:
    """Encodes each text once: id, start, length, crc, parts and doc_tokens of its pieces of capacity tokens and the rest."""
    chosen = bounded_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks).encode
        for batch in batches:
            own, rows = [], []
            for i, text in enumerate(batch_column(batch, "text")):
                ids = np.append(encode(text.as_py()), np.uint32(END_ID))
                for piece in pieces_of(ids, capacity):
                    own.append(i)
                    rows.append((*piece, len(ids)))
            start, length, crc, parts, total = zip(*rows, strict=True) if rows else ((),) * 5
            arrays = [pa.array(x, pa.int64()) for x in (start, length, crc)] + [pa.array(parts, pa.list_(pa.int64())), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch_column(batch, "id").take(pa.array(own, pa.int64())), *arrays], ["id", "start", "length", "crc", "parts", "doc_tokens"])

    kind = T.StructType([T.StructField("id", chosen.schema["id"].dataType)] + [T.StructField(n, T.LongType()) for n in ("start", "length", "crc")] + [T.StructField("parts", T.ArrayType(T.LongType())), T.StructField("doc_tokens", T.LongType())])
    return chosen.mapInArrow(run, kind)


def _ranges(patterns: list[Pattern], capacity: int, sequence: int) -> tuple[dict[int, dict[str, np.ndarray]], dict[int, int], int]:
    """By length and the rank of a piece among those of its length: where its range begins and where it goes.

    A window is filled, or its sum is a power of two, or its pieces stay apart: they are numbered in apart_at and counted for each
    length. At last, the next free sequence.
    """
    rows: dict[int, list[tuple]] = {}
    used: dict[int, int] = {}
    alone: dict[int, int] = {}
    for p in patterns:
        apart, offset = p.total < capacity and not power_of_two(p.total), 0
        for length, n in p.counts:
            begin = used.get(length, 0)
            rows.setdefault(length, []).append((begin, sequence, n, offset, apart, alone.get(length, 0)))
            used[length] = begin + n * p.repeats
            if apart:
                alone[length] = alone.get(length, 0) + n * p.repeats
            offset += n * length
        sequence += 0 if apart else p.repeats
    names = ("begin", "sequence", "each", "offset", "apart", "apart_at")
    return {length: {n: np.array(x, np.int64) for n, x in zip(names, zip(*own, strict=True), strict=True)} for length, own in rows.items()}, alone, sequence


class Places:
    """Where each piece goes, by its length and its rank among the pieces of that length.

    What windows that stay short hold is cut into powers of two, which are packed again: they fill windows without a rest. Those
    of the last window, less than capacity tokens in all, are grouped to sums that are powers of two, a sequence for each.
    """

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.first, alone, n = _ranges(plan(counts, capacity), capacity, 0)
        self.base: dict[tuple[int, int], int] = {}
        sizes: dict[int, int] = {}
        for length, pieces in sorted(alone.items()):
            for size in binary_parts(length):
                self.base[length, size] = sizes.get(size, 0)
                sizes[size] = sizes.get(size, 0) + pieces
        filled = [q for p in plan(sizes, capacity) for q in (split_to_powers(p) if p.total < capacity else [p])]
        self.second, _, self.sequences = _ranges(filled, capacity, n)

    def of_pieces(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """sequence, offset, whether the piece stays apart, and its number among those of its length."""
        at = self.first[length]
        row = np.searchsorted(at["begin"], rank, "right") - 1
        copy, slot = np.divmod(rank - at["begin"][row], at["each"][row])
        return at["sequence"][row] + copy, at["offset"][row] + slot * length, at["apart"][row] == 1, at["apart_at"][row] + rank - at["begin"][row]

    def of_parts(self, length: int, size: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence and offset of the parts of this size that pieces of this length, numbered among those apart, are cut into."""
        at, rank = self.second[size], self.base[length, size] + number
        row = np.searchsorted(at["begin"], rank, "right") - 1
        copy, slot = np.divmod(rank - at["begin"][row], at["each"][row])
        return at["sequence"][row] + copy, at["offset"][row] + slot * size


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, ranks: str | None = RANKS) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id and offset in the sequence.

    A document is cut into pieces of capacity tokens and a rest. Full pieces are sequences of their own, rests are packed by
    minimum bin slack. What is in a window that stays short and is no power of two is cut into powers of two, which are packed
    again, the last of these to sums that are powers of two; so nothing is padded. The plan is made from the number of pieces of each
    length, at most capacity numbers.

    Null and empty texts have one token, the end's. Repeated rows and null ids are packed each for itself; other columns are not
    read; an empty table gives no rows.
    """
    pieces = stored(cut(docs, id_col, text_col, capacity, vocabulary, ranks))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    buckets = max(MIN_BUCKETS, sum(counts.values()) // BUCKET_ROWS)
    places = Places(counts, capacity)

    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "start", "crc"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("id", "start", "crc")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("rank"))
    kind = T.StructType([pieces.schema["id"]] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = {n: batch_column(batch, n).to_numpy() for n in ("start", "length", "crc", "doc_tokens", "rank")}
            parts, rows = batch_column(batch, "parts"), []
            for length in np.unique(number["length"]):
                length, who = int(length), np.flatnonzero(number["length"] == length)
                sequence, offset, apart, order = places.of_pieces(length, number["rank"][who])
                whole, cut_up = who[~apart], who[apart]
                rows.append((whole, number["start"][whole], number["length"][whole], number["crc"][whole], sequence[~apart], offset[~apart]))
                if len(cut_up):
                    crcs, begin = np.array(parts.take(pa.array(cut_up)).to_pylist(), np.int64), 0
                    for k, size in enumerate(binary_parts(length)):
                        rows.append((cut_up, number["start"][cut_up] + begin, np.full(len(cut_up), size), crcs[:, k], *places.of_parts(length, size, order[apart])))
                        begin += size
            if rows:
                who, start, length, crc, sequence, offset = (np.concatenate(x) for x in zip(*rows, strict=True))
                arrays = [batch_column(batch, "id").take(pa.array(who)), *(pa.array(x, pa.int64()) for x in (start, length, crc, number["doc_tokens"][who], sequence, offset))]
                yield pa.RecordBatch.from_arrays(arrays, kind.names)

    placed = ranked.select("id", "start", "length", "crc", "parts", "doc_tokens", "rank").mapInArrow(place, kind)
    return placed.withColumnRenamed("id", id_col)
