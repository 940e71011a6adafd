"""Byte-level BPE: training by rounds or by a heap, special tokens, encoding and decoding.

Ties between pairs go to the higher count, then the smaller left id, then the smaller right id; so both ways of training and any
number of partitions give one model.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill import schemas
from corpusmill.functions.text import nfc, pretokens
from corpusmill.operators.counts import pair_counts, word_bytes
from corpusmill.session import materialized

#: The special tokens of the base tokenizer and of the chat tokenizer, in the order of their ids.
BASE_SPECIALS = ("<eos>", "<bos>", "<pad>", "<unk>", "<mask>")
CHAT_SPECIALS = ("<user>", "<assistant>")
#: Merges up to which words are encoded by Catalyst alone; word types, and their bytes, up to which one task trains.
FOLD_MERGES, TASK_TYPES, TASK_BYTES = 1_000, 32_000_000, 320_000_000
#: Pairs that a distributed round looks at.
ROUND_PAIRS = 256
CACHED_WORDS = 200_000
#: Merges up to which all words of a slice are encoded by replacing; pieces or ids of a slice; words that training rewrites at once.
REPLACED_MERGES, SLICE, TRAIN_WORDS = 100, 1 << 18, 1 << 18
#: Stands between words; no id is as high.
BREAK = "\U0010ffff"


@dataclass(frozen=True)
class Merge:
    left: int
    right: int
    new_id: int
    n: int = 0


@dataclass(frozen=True)
class BpeModel:
    """Merges in rank order and special tokens; never changed, so nothing of an earlier training can stay behind."""

    merges: tuple[Merge, ...] = ()
    specials: dict[str, int] = field(default_factory=dict)

    @cached_property
    def vocab(self) -> dict[int, bytes]:
        out = {i: bytes([i]) for i in range(256)}
        for m in self.merges:
            out[m.new_id] = out[m.left] + out[m.right]
        return out | {i: t.encode() for t, i in self.specials.items()}

    @cached_property
    def ids_of_bytes(self) -> dict[bytes, int]:
        """The inverse vocabulary; of equal byte strings the last id counts."""
        return {b: i for i, b in sorted(self.vocab.items())}

    @cached_property
    def ranks(self) -> dict[tuple[int, int], int]:
        return {(m.left, m.right): m.new_id for m in self.merges}

    @property
    def size(self) -> int:
        return 256 + len(self.merges) + len(self.specials)

    def with_specials(self, tokens: Iterable[str]) -> BpeModel:
        """New tokens get the next ids; known ones keep theirs."""
        specials, size = dict(self.specials), self.size
        for t in tokens:
            if t not in specials:
                specials[t] = size
                size += 1
        return replace(self, specials=specials)

    @cached_property
    def special_pattern(self) -> str | None:
        """An alternation, longest first; None without special tokens."""
        parts = sorted(map(re.escape, self.specials), key=lambda x: (-len(x), x))
        return "|".join(parts) or None

    def merge_word(self, ids: list[int]) -> list[int]:
        """Merges the pair of the lowest rank, all its places from the left, until none is left."""
        ranks = self.ranks
        while len(ids) > 1:
            best = min(zip(ids, ids[1:], strict=False), key=lambda p: ranks.get(p, 1 << 60))
            new = ranks.get(best)
            if new is None:
                break
            ids = _replace(ids, best, new)
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.vocab.get(i, b"") for i in ids).decode("utf-8", errors="replace")

    def merges_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r, m.left, m.right, m.new_id, m.n) for r, m in enumerate(self.merges, 1)], schemas.MERGES)

    def vocab_frame(self, spark: SparkSession) -> DataFrame:
        special = set(self.specials.values())
        return spark.createDataFrame([(i, b, i in special) for i, b in sorted(self.vocab.items())], schemas.VOCAB)

    def save(self, spark: SparkSession, folder: str) -> None:
        """Three small tables: merges, vocabulary and special tokens."""
        self.merges_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{folder}/merges")
        self.vocab_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{folder}/vocab")
        spark.createDataFrame(sorted(self.specials.items(), key=lambda x: x[1]), "token string, id int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/specials")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> BpeModel:
        merges = sorted(spark.read.parquet(f"{folder}/merges").collect(), key=lambda r: r["rank"])
        specials = sorted(spark.read.parquet(f"{folder}/specials").collect(), key=lambda r: r["id"])
        return BpeModel(tuple(Merge(r["left"], r["right"], r["new_id"], r["n"]) for r in merges), {r["token"]: r["id"] for r in specials})


def _replace(ids: list[int], pair: tuple[int, int], new: int) -> list[int]:
    """One merge, by the rule of _marked(): ids as text with a comma on both sides of each, replaced from the left."""
    return [int(x) for x in f",{',,'.join(map(str, ids))},".replace(f",{pair[0]},,{pair[1]},", f",{new},")[1:-1].split(",,")]


def _marked(ids: Column) -> Column:
    """Ids as text with a comma on both sides of each: replacing one pair's text is greedy from the left and never overlaps."""
    return F.concat(F.lit(","), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",,"), F.lit(","))


def _unmarked(marked: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(marked, "^,|,$", ""), ",,"), lambda x: x.cast("int"))


def _check_size(vocab_size: int) -> int:
    if vocab_size < 256:
        raise ValueError("a byte-level vocabulary has 256 tokens at least")
    return vocab_size - 256


def independent(pairs: Iterable[tuple[int, int]]) -> int:
    """How many pairs, best first, can be merged in one round as if one by one: up to the first that has an id with an earlier one,
    or that is an id twice.

    Merging a pair changes no count of pairs that share no id with it. A pair that it makes new counts no more than some other pair
    that shares an id with it did; that one comes later in the order than those taken, and so does the new pair, as its id is the
    highest. Only of an id twice can the new pairs count more than any other pair did: runs of the id make them. It comes last.
    """
    used: set[int] = set()
    k = 0
    for pair in pairs:
        if not used.isdisjoint(pair):
            break
        used.update(pair)
        k += 1
        if pair[0] == pair[1]:
            break
    return k


def train_rounds(words: DataFrame, vocab_size: int, checkpoint_every: int = 8) -> BpeModel:
    """Distributed rounds: count pairs, take the best ones that are independent of each other, replace them in all words.

    words: word and n. At most ROUND_PAIRS pairs reach the driver in a round, whatever the number of words; words without a pair
    left are dropped; the words are written to a checkpoint when the lineage has grown by some rounds.
    """
    merges: list[Merge] = []
    rounds = _check_size(vocab_size)
    start = current = words.select("n", _marked(word_bytes(F.col("word"))).alias("ids")).persist()
    grown = 0
    while len(merges) < rounds:
        best = pair_counts(current, _unmarked(F.col("ids"))).orderBy(F.desc("n"), "left", "right").limit(ROUND_PAIRS).collect()
        if not best:
            break
        for found in best[: min(independent([(r["left"], r["right"]) for r in best]), rounds - len(merges))]:
            new = 256 + len(merges)
            merges.append(Merge(found["left"], found["right"], new, found["n"]))
            current = current.withColumn("ids", F.replace("ids", F.lit(f",{found['left']},,{found['right']},"), F.lit(f",{new},")))
        grown += 1
        if grown % checkpoint_every == 0 and len(merges) < rounds:
            current = materialized(current.where(F.contains("ids", F.lit(",,"))))
    start.unpersist()
    return BpeModel(tuple(merges))


def _repeated(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1 and so on, sizes[i] numbers for each i, one behind the other."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _grouped(keys: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key with its words, every word once. Words must rise."""
    order = np.argsort(keys, kind="stable")
    keys, words = keys[order], words[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (words[1:] != words[:-1])
    keys, words = keys[fresh], words[fresh].astype(np.int32)
    bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else ()
    for low, high in pairwise(bounds):
        yield int(keys[low]), words[low:high]


def _train_arrays(raw: np.ndarray, sizes: np.ndarray, weights: np.ndarray, rounds: int) -> list[Merge]:
    """Merges of words whose bytes stand one behind the other in raw.

    Pair counts are kept up and the best pair comes off a heap; the words of a pair are found by its list and rewritten as arrays.
    A byte of a word takes some 8 bytes of memory.
    """
    ids = raw.astype(np.uint16 if rounds + 256 <= 1 << 16 else np.uint32)
    begins, sizes = np.cumsum(sizes, dtype=np.int64) - sizes, sizes.astype(np.int32)
    totals: defaultdict[int, int] = defaultdict(int)
    where: defaultdict[int, list[np.ndarray]] = defaultdict(list)
    for low in range(0, len(sizes), TRAIN_WORDS):
        n = sizes[low : low + TRAIN_WORDS]
        t, w = ids[begins[low] : begins[low] + int(n.sum())].astype(np.int64), np.repeat(np.arange(low, low + len(n)), n)
        inside = np.flatnonzero(w[1:] == w[:-1])
        keys = t[inside] << 32 | t[inside + 1]
        found, at = np.unique(keys, return_inverse=True)
        for k, n_k in zip(found.tolist(), _summed(at, weights[w[inside]], len(found)), strict=True):
            totals[k] += n_k
        for k, some in _grouped(keys, w[inside]):
            where[k].append(some)
    heap = [(-n, k) for k, n in totals.items()]
    heapq.heapify(heap)
    merges: list[Merge] = []
    while len(merges) < rounds and heap:
        n, key = heapq.heappop(heap)
        if totals.get(key, 0) != -n or n == 0:
            continue  # an older count of this pair
        left, right, new = key >> 32, key & 0xFFFFFFFF, 256 + len(merges)
        merges.append(Merge(left, right, new, -n))
        holders = np.unique(np.concatenate(where.pop(key)))
        for low in range(0, len(holders), TRAIN_WORDS):
            some = holders[low : low + TRAIN_WORDS]
            at = _repeated(begins[some], sizes[some])
            t, w = ids[at].astype(np.int64), np.repeat(np.arange(len(some)), sizes[some])
            inside = w[1:] == w[:-1]
            hits = np.flatnonzero((t[:-1] == left) & (t[1:] == right) & inside)
            if left == right and len(hits):  # of a run, every other place from its left
                runs = np.flatnonzero(np.concatenate(([True], np.diff(hits) != 1)))
                hits = hits[(np.arange(len(hits)) - np.repeat(runs, np.diff([*runs, len(hits)]))) % 2 == 0]
            if not len(hits):
                continue
            gone = _near(hits, (-1, 0, 1), inside)
            kept = np.ones(len(t), bool)
            kept[hits + 1] = False
            after = t.copy()
            after[hits] = new
            after, w_after = after[kept], w[kept]
            made = _near(np.flatnonzero(after == new), (-1, 0), w_after[1:] == w_after[:-1])
            made_keys = after[made] << 32 | after[made + 1]
            found, place = np.unique(np.concatenate((t[gone] << 32 | t[gone + 1], made_keys)), return_inverse=True)
            change = np.concatenate((-weights[some[w[gone]]], weights[some[w_after[made]]]))
            for k, d in zip(found.tolist(), _summed(place, change, len(found)), strict=True):
                if d:
                    totals[k] = total = totals.get(k, 0) + d
                    if total > 0 and k != key:
                        heapq.heappush(heap, (-total, k))
                    elif total <= 0 and k != key:
                        del totals[k]
            for k, these in _grouped(made_keys, some[w_after[made]]):
                where[k].append(these.copy())
            sizes[some] -= np.bincount(w[hits], minlength=len(some)).astype(np.int32)
            ids[_repeated(begins[some], sizes[some])] = after
        totals.pop(key, None)
    return merges


def _summed(place: np.ndarray, values: np.ndarray, n: int) -> list[int]:
    """Sums of whole values by place, exact at any size."""
    out = np.zeros(n, np.int64)
    np.add.at(out, place, values)
    return out.tolist()


def _near(places: np.ndarray, steps: tuple[int, ...], inside: np.ndarray) -> np.ndarray:
    """Pairs at the given steps from places that lie inside of a word, each once."""
    near = np.zeros(len(inside) + 2, bool)
    for step in steps:
        near[places + step + 1] = True
    return np.flatnonzero(near[1:-1] & inside)


def train_heap(counts: Iterable[tuple[str, int]], vocab_size: int) -> BpeModel:
    """The same model from word counts in memory: pair counts are kept up, the best pair comes off a heap."""
    rounds = _check_size(vocab_size)
    words = [(raw, n) for word, n in counts if len(raw := word.encode()) > 1]
    sizes, weights = np.array([len(r) for r, _ in words], np.int64), np.array([n for _, n in words], np.int64)
    return BpeModel(tuple(_train_arrays(np.frombuffer(b"".join(r for r, _ in words), np.uint8), sizes, weights, rounds)))


def _train_task(words: DataFrame, vocab_size: int) -> BpeModel:
    """train_heap() in one task, whose words are never objects; only merges reach the driver."""
    rounds = _check_size(vocab_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raws, sizes, weights = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            words = batch.column(0).cast(pa.large_binary())
            offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset :][: len(words) + 1]
            raws.append(np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].copy())
            sizes.append(np.diff(offsets).astype(np.int32))
            weights.append(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
        made = _train_arrays(np.concatenate(raws), np.concatenate(sizes), np.concatenate(weights), rounds)
        columns = [[m.left for m in made], [m.right for m in made], [m.new_id for m in made]]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array([m.n for m in made], pa.int64())], ["left", "right", "new_id", "n"])

    some = words.where(F.octet_length("word") > 1).select(F.encode("word", "UTF-8").alias("word"), F.col("n").cast("long").alias("n"))
    made = some.coalesce(1).mapInArrow(run, "left int, right int, new_id int, n long").collect()
    return BpeModel(tuple(Merge(*r) for r in sorted(made, key=lambda r: r["new_id"])))


def train(words: DataFrame, vocab_size: int, driver_types: int = TASK_TYPES) -> BpeModel:
    """Trains on word and n: in one task while the word types, which are checked, fit there, else by rounds."""
    words = materialized(words)
    n, size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    return (_train_task if n <= driver_types and size <= TASK_BYTES else train_rounds)(words, vocab_size)


def encode_word(word: Column, model: BpeModel) -> Column:
    """Ids of a pre-token by folding the merges in rank order over its bytes; no Python.

    A pair with a merge's id can only be merged later, so one pass in rank order does what lowest rank first does.
    """
    if len(model.merges) > FOLD_MERGES:
        raise ValueError("too many merges for a fold: use encode()")
    steps = F.array(*(F.struct(F.lit(f",{m.left},,{m.right},").alias("pair"), F.lit(f",{m.new_id},").alias("id")) for m in model.merges)) if model.merges else None
    start = _marked(word_bytes(word))
    return _unmarked(F.aggregate(steps, start, lambda ids, m: F.replace(ids, m["pair"], m["id"])) if steps is not None else start)


def split_specials(text: Column, model: BpeModel, allow_special: bool = True) -> Column:
    """The text cut at special tokens, which stay as pieces of their own."""
    if not allow_special or model.special_pattern is None:
        return F.array(text)
    found = f"(?:{model.special_pattern})"
    gaps = F.split(text, found, -1)
    marks = F.concat(F.regexp_extract_all(text, F.lit(found), F.lit(0)), F.array(F.lit("")))
    return F.filter(F.flatten(F.zip_with(gaps, marks, lambda g, m: F.array(g, m))), lambda x: F.coalesce(x != "", F.lit(False)))


def pieces(text: Column, model: BpeModel, allow_special: bool = True) -> Column:
    """Special tokens and pre-tokens of a text in order; a piece is special if it is one of the model's tokens in full."""
    cut = split_specials(text, model, allow_special)
    if not model.specials or not allow_special:
        return F.flatten(F.transform(cut, pretokens))
    return F.flatten(F.transform(cut, lambda x: F.when(x.isin(*model.specials), F.array(x)).otherwise(pretokens(x))))


def encode(text: Column, model: BpeModel, allow_special: bool = True) -> Column:
    """Ids of a text: cut at special tokens, composed, pre-tokenized in the JVM, merged in Arrow batches.

    Nothing is shuffled. Of each slice of SLICE pieces only the distinct ones become objects; with many merges a worker keeps the ids
    of those it has met lately, CACHED_WORDS at most. Pre-tokens come from the JVM, so that one Unicode version decides. With
    allow_special=False the tokens' text is ordinary text.
    """
    specials = model.specials if allow_special else {}
    cache: dict[str, list[int]] = {}

    def ids_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        if len(model.merges) <= REPLACED_MERGES:
            # As encode_word() folds: in rank order, on text of one character for each id.
            text = BREAK.join([chr(specials[w]) if w in specials else w.encode().decode("latin-1") for w in words] + [""])
            for m in model.merges:
                text = text.replace(chr(m.left) + chr(m.right), chr(m.new_id))
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
            ends = np.flatnonzero(codes == ord(BREAK))
            return codes[codes != ord(BREAK)], np.diff(ends, prepend=-1) - 1
        out = []
        for w in words:
            known = cache.get(w)
            if known is None:
                if len(cache) >= CACHED_WORDS:
                    cache.clear()
                known = cache[w] = [specials[w]] if w in specials else model.merge_word(list(w.encode()))
            out.append(known)
        return np.fromiter((i for k in out for i in k), np.int32), np.array([len(k) for k in out], np.int64)

    def of_slice(rows: pa.ListArray) -> pa.ListArray:
        coded = rows.flatten().dictionary_encode()
        flat, sizes = ids_of(coded.dictionary.to_pylist())
        place = coded.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes[place])))
        values = flat[_repeated((np.cumsum(sizes) - sizes)[place], sizes[place])]
        return _listed(rows, ends, pa.array(values, pa.int32()))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def merged(rows: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *map(of_slice, _slices(rows))])

    return merged(pieces(nfc(text), model, allow_special))


def _sizes(rows: pa.ListArray) -> np.ndarray:
    return rows.value_lengths().fill_null(0).to_numpy().astype(np.int64)


def _slices(rows: pa.ListArray) -> Iterator[pa.ListArray]:
    """Rows in slices of some SLICE elements, one row at least."""
    ends, low = np.cumsum(_sizes(rows)), 0
    while low < len(rows):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE, "right")))
        yield rows.slice(low, high - low)
        low = high


def _listed(rows: pa.ListArray, ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Lists of the values that the elements of rows stand for, null where rows are. ends: where each element's values begin, and the last end."""
    offsets = ends[np.concatenate(([0], np.cumsum(_sizes(rows))))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=rows.is_null())


def decode(ids: Column, model: BpeModel) -> Column:
    """Text of ids; bytes that are no UTF-8 become U+FFFD. Unknown ids are nothing."""
    size = max(model.vocab) + 1
    parts = [model.vocab.get(i, b"") for i in range(size)] + [b""]

    def of_slice(rows: pa.ListArray, table: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> list[str | None]:
        flat = rows.flatten().fill_null(size).to_numpy().astype(np.int64)
        flat[(flat < 0) | (flat > size)] = size
        ends = np.concatenate(([0], np.cumsum(sizes[flat])))[np.concatenate(([0], np.cumsum(_sizes(rows))))].tolist()
        raw = table[_repeated(first[flat], sizes[flat])].tobytes()
        return [raw[a:b].decode("utf-8", errors="replace") if known else None for a, b, known in zip(ends, ends[1:], rows.is_valid().to_pylist(), strict=False)]

    @F.arrow_udf("string")
    def decoded(rows: pa.Array) -> pa.Array:
        sizes = np.array([len(x) for x in parts], np.int64)
        table, first = np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes
        return pa.concat_arrays([pa.array([], pa.string()), *(pa.array(of_slice(x, table, first, sizes), pa.string()) for x in _slices(rows))])

    return decoded(ids)


def byte_tokens(text: Column, specials: dict[str, int]) -> Column:
    """Ids of a text for a model without merges: its bytes, and the ids of special tokens; no Python."""
    model = BpeModel((), specials)
    cut = split_specials(text, model)

    def of_piece(x: Column) -> Column:
        out = word_bytes(x)
        for token, i in specials.items():
            out = F.when(x == token, F.array(F.lit(i))).otherwise(out)
        return out

    return F.flatten(F.transform(cut, of_piece))
