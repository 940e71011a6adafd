"""What several operators share: the scratch folder, word spans and hashes over whole Arrow batches, small helpers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import spread

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that one numpy pass takes; its arrays of eight bytes a character then stay near 16 MB each.
SLICE_BYTES = 2 << 20
#: Bytes of text whose words are hashed at once; its arrays then fit a core's cache.
HASH_BYTES = 1 << 18
#: Bytes of a batch between the JVM and Python. Either side holds several copies of it, and texts can be long.
BATCH_BYTES = "4m"
#: Share of the driver's largest heap that may be in use or kept free before garbage is collected between plans.
HEAP_SHARE = 0.4


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, in whose session batches for Python now hold BATCH_BYTES at most, or one row."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


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


def release_driver(spark: SparkSession) -> bool:
    """Has the driver's JVM collect its garbage if more than HEAP_SHARE of its largest heap is in its hands, so that it gives the rest back:
    a long row of plans lets the heap grow to its limit. Whether it did. Free memory of the driver's Python goes back in any case."""
    release_memory()
    java = spark._jvm.java.lang
    runtime = java.Runtime.getRuntime()
    if full := runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        java.System.gc()
    return full


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, so lost executors cost no earlier stage.

    The table is deleted by discard(), or when the driver's JVM ends. What the plan took of the driver is given back.
    """
    spark = bounded_batches(df).sparkSession
    path = f"{scratch_dir(spark)}/corpusmill-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    df.write.parquet(path, compression=compression)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    _SCRATCH[path] = weakref.ref(out)
    release_driver(spark)
    return out


#: Paths of the tables that stored() wrote, with the frames that it gave for them.
_SCRATCH: dict[str, weakref.ref] = {}


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() gave and that no later plan reads any more."""
    for df in tables:
        for path in [p for p, of in _SCRATCH.items() if of() is df]:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _SCRATCH.pop(path, None)


@contextlib.contextmanager
def scratch_until(spark: SparkSession) -> Iterator[set[str]]:
    """All tables that stored() writes inside go at the end, but for paths that are added to the set: for whoever knows when a
    result has been read. Not for two threads at once."""
    before, keep = set(_SCRATCH), set()
    try:
        yield keep
    finally:
        for path in set(_SCRATCH) - before - keep:
            _delete(spark, path)


def path_of_stored(df: DataFrame) -> str:
    return next(p for p, of in _SCRATCH.items() if of() is df)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def release_memory() -> None:
    """Gives memory that is free back to the system: a worker process lives through many stages and shares its executor's bound."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def batch_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and each text's offset, with the end at last. Nulls count as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about limit bytes each, and at least one text."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def golden(k: int) -> np.uint64:
    """k times GOLDEN, modulo 2^64."""
    return np.uint64(int(k) * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """Finds the words of many texts at once and hashes each to 64 bits.

    separators: the byte values that end a word (bytes of 128 and above never do); lower: A-Z count as a-z.
    A word's hash is a polynomial over random byte values, mixed; it depends on nothing but the word.
    """

    def __init__(self, separators: bytes, lower: bool, seed: int = 1) -> None:
        self.inside = np.ones(256, bool)
        self.inside[list(separators)] = False
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 2**64, 256, np.uint64)
        if lower:
            self.values[65:91] = self.values[97:123]
        self.base = np.uint64(rng.integers(0, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(5))
        self.inverse = np.uint64(pow(int(self.base), -1, 2**64))
        self.powers = self.backward = np.ones(0, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers), HASH_BYTES + 1)
            up, down = np.full(n, self.base), np.full(n, self.inverse)
            up[0] = down[0] = 1
            self.powers, self.backward = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def __getstate__(self) -> dict:
        """Without the tables of powers: whoever gets the hasher makes them anew."""
        return self.__dict__ | {"powers": np.ones(0, np.uint64), "backward": np.ones(0, np.uint64)}

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and lengths in bytes of all words, and the number of the first word of each text, with the end at last."""
        inside = self.inside[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at = offsets[:-1][offsets[:-1] < len(data)]
        begins[at] = inside[at]
        starts = np.flatnonzero(begins)
        so_far = np.cumsum(inside, dtype=np.int64)
        lengths = np.diff(np.append(so_far[starts] - 1, so_far[-1] if len(so_far) else 0))
        return starts, lengths, np.searchsorted(starts, offsets)

    def _cuts(self, data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
        """Ranges of about limit bytes that no word crosses; a longer one only for a longer word."""
        low, n = 0, len(data)
        while low < n:
            high = low + limit
            if high >= n:
                high = n
            else:
                gaps = np.flatnonzero(~self.inside[data[low + 1 : high + 1]])
                edge = offsets[np.searchsorted(offsets, high, "right") - 1]
                if len(gaps) or edge > low:
                    high = max(low + 1 + int(gaps[-1]) if len(gaps) else 0, int(edge))
                else:
                    rest = ~self.inside[data[high:]]
                    gap = high + int(rest.argmax()) if rest.any() else n
                    high = min(gap, int(offsets[np.searchsorted(offsets, high, "right")]))
            yield low, high
            low = high

    def hashes(self, data: np.ndarray, offsets: np.ndarray, limit: int = HASH_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """spans(), and the words' hashes before them. Arrays of eight bytes a character are held for some limit bytes only."""
        if len(data) <= limit:
            return self._hashes(data, offsets)
        parts = []
        for low, high in self._cuts(data, offsets, limit):
            inner = offsets[np.searchsorted(offsets, low, "right") : np.searchsorted(offsets, high)] - low
            words, starts, lengths, _ = self._hashes(data[low:high], np.concatenate([[0], inner, [high - low]]))
            parts.append((words, starts + low, lengths))
        words, starts, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
        return words, starts, lengths, np.searchsorted(starts, offsets)

    def _hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts, lengths, first = self.spans(data, offsets)
        self._reach(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        words = (sums[starts + lengths] - sums[starts]) * self.backward[starts]
        return mixed(words + lengths.astype(np.uint64) * GOLDEN), starts, lengths, first


#: Separators of words `[^\x20\x09-\x0D]+`.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
#: Separators of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
NOT_ALNUM = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def grams(words: np.ndarray, n: int, seed: int = 2) -> np.ndarray:
    """A 64-bit hash of each n consecutive words, by their start; empty if there are fewer."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    factors = np.random.default_rng(seed).integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    m = len(words) - n + 1
    out = words[:m] * factors[0]
    for k in range(1, n):
        out += words[k : k + m] * factors[k]
    return mixed(out + golden(n))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 5; 0 is held out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5
