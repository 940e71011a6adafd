"""Substring dedup: passages that recur across documents are confirmed, compiled to automata and located in every document."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import BLANKS, WordHasher, batch_column, bounded_batches, discard, golden, grams, mixed, signed, slices, stored, text_bytes

WINDOW, ANCHOR = 13, 5
#: Windows whose words travel together as one passage.
PASSAGE = 32
#: Bits of a filter for each value, and of a filter at least and at most (32 MB). A fuller filter lets more windows through to the
#: exact stages; it never changes the result.
FILTER_BITS_EACH, MIN_FILTER_BITS, MAX_FILTER_BITS = 16, 1 << 20, 1 << 28
#: Copies of whole texts whose ids are broadcast to leave them out of the scans, 100 MB at most; more go through the scans.
BROADCAST_COPIES = 1_000_000
#: Phrases of one automaton; each takes up to 39 nodes.
SHARD_PHRASES = 10_000
#: Tasks that the documents with one text, one window or one passage are dealt to; documents from which on a window is dealt.
SALTS, HOT_WINDOW = 32, 10_000
_BUCKET = 32_768  # bits of Spark's bitmap buckets


@lru_cache(maxsize=1)
def _hasher() -> WordHasher:
    """One for each process: its tables of powers are large."""
    return WordHasher(BLANKS, lower=False, seed=13)


@dataclass
class Windows:
    """Of each window of each text: anchor, hash, text and word, the number of its first word. starts and ends: the bytes of all
    words; first: the number of each text's first word, with the end at last.

    A window's anchor is the least hash of the runs of ANCHOR words in it: equal windows have equal anchors, and neighbouring
    windows mostly share theirs, so anchors are some five times fewer than windows.
    """

    anchors: np.ndarray
    hashes: np.ndarray
    text: np.ndarray
    word: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def block(self, at: np.ndarray) -> np.ndarray:
        """The number of the passage that windows begin in."""
        return (self.word[at] - self.first[self.text[at]]) // PASSAGE

    def bytes_of(self, raw: bytes, head: np.ndarray, tail: np.ndarray) -> pa.Array:
        """The words from each window of head to each one of tail."""
        begin, end = self.starts[self.word[head]], self.ends[self.word[tail] + WINDOW - 1]
        return pa.array([raw[p:q] for p, q in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())


def windows_of(data: np.ndarray, offsets: np.ndarray, bits: int = 64, window: int = WINDOW, anchor: int = ANCHOR) -> Windows:
    words, starts, lengths, first = _hasher().hashes(data, offsets)
    counts = np.maximum(np.diff(first) - window + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    if not len(text):
        return Windows(np.zeros(0, np.uint64), np.zeros(0, np.uint64), text, text, starts, starts + lengths, first)
    at = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(len(text))
    runs = grams(words, anchor)
    low, reach, width = runs, 1, window - anchor + 1
    while reach < width:
        step = min(reach, width - reach)
        low, reach = np.minimum(low[: len(low) - step], low[step:]), reach + step
    return Windows(mixed(low[at]), grams(words, window)[at] >> np.uint64(64 - bits), text, at, starts, starts + lengths, first)


def _salted(ids: pa.Array) -> np.ndarray:
    return (mixed(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).view(np.uint64) + golden(1)) >> np.uint64(32)).astype(np.int64) % SALTS


_FOUND = pa.schema([("value", pa.int64()), ("doc_id", pa.int64()), ("block", pa.int32()), ("salt", pa.int32()), ("words", pa.binary())])


def _scan(docs: DataFrame, bits: int, pick: Callable[[Windows], np.ndarray], of: str = "hashes", passages: bool = False, each: bool = False, hot: Filter | None = None) -> DataFrame:
    """value, doc_id, block, salt and words of the windows whose numbers pick() gives: their anchors or hashes.

    block: the number of the passage that the window begins in; salt: other than 0 only for values in hot. words: null, or with
    each those of the window. passages: each value comes once a text, and the words of each passage with such a window come in
    further rows with a null value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch_column(batch, "text"))
            ids = batch_column(batch, "doc_id")
            salts = _salted(ids)
            for a, b in slices(offsets):
                own = data[offsets[a] : offsets[b]]
                w = windows_of(own, offsets[a : b + 1] - offsets[a], bits)
                at = pick(w)
                values, raw = getattr(w, of), own.tobytes() if passages or each else b""
                if passages and len(at):
                    text, block = w.text[at], w.block(at)
                    new = np.append(True, (np.diff(text) != 0) | (np.diff(block) != 0))
                    head = at[new] - (w.word[at[new]] - w.first[text[new]]) % PASSAGE
                    tail = np.minimum(head + PASSAGE, np.searchsorted(w.text, text[new], "right")) - 1
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(head), pa.int64()), ids.take(pa.array(text[new] + a)), pa.array(block[new].astype(np.int32)), pa.nulls(len(head), pa.int32()), w.bytes_of(raw, head, tail)], schema=_FOUND)
                    order = np.argsort(values[at], kind="stable")  # keeps the order of texts among equal values
                    text, same = text[order], values[at[order]]
                    at = at[order[np.append(True, (text[1:] != text[:-1]) | (same[1:] != same[:-1]))]]
                text, values = w.text[at], np.ascontiguousarray(values[at])
                salt = np.where(hot(values), salts[a:b][text], 0) if hot is not None else np.zeros(len(at), np.int64)
                words = w.bytes_of(raw, at, at) if each else pa.nulls(len(at), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(signed(values)), ids.take(pa.array(text + a)), pa.array(w.block(at).astype(np.int32)), pa.array(salt.astype(np.int32)), words], schema=_FOUND)

    return docs.mapInArrow(run, "value long, doc_id long, block int, salt int, words binary")


class Filter:
    """A Bloom filter of two bits a value, of a size that follows the number of values up to MAX_FILTER_BITS."""

    def __init__(self, values: DataFrame) -> None:
        spark, self.n = values.sparkSession, values.count()
        self.size = MIN_FILTER_BITS
        while self.size < min(FILTER_BITS_EACH * self.n, MAX_FILTER_BITS):
            self.size *= 2
        mask = F.lit(self.size - 1)
        places = values.select(F.explode(F.array(F.col("value").bitwiseAND(mask), F.shiftrightunsigned("value", 32).bitwiseAND(mask))).alias("place"))
        number = F.col("place") + 1
        rows = places.groupBy(F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
        table = np.zeros(self.size // 8, np.uint8)
        for r in rows.toLocalIterator() if self.n else ():
            begin = (r["bucket"] - 1) * _BUCKET // 8
            table[begin : begin + _BUCKET // 8] = np.frombuffer(r["bits"], np.uint8)
        self.table: Broadcast = spark.sparkContext.broadcast(table)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        if not self.n:
            return ~out
        mask, table = np.uint64(self.size - 1), self.table.value
        for place in (x & mask, x >> np.uint64(32) & mask):
            out &= table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1
        return out


def spelled(numbers: np.ndarray, places: int = 3) -> str:
    """Word numbers below 128 ** places as that many letters each, of an alphabet of 128 letters for each of the places.

    An automaton looks through a node's letters one by one: with a letter for each word its root would be as wide as the
    vocabulary. As each place has its own letters, matches begin and end with words.
    """
    letters = [(numbers >> 7 * (places - 1 - k) & 127) + 0x100 + 128 * k for k in range(places)]
    return np.stack(letters, axis=1).astype("<u4").tobytes().decode("utf-32-le")


def locate(texts: list[list[bytes]], ids: list[int], passages: list[list[tuple[int, bytes]]], window: int = WINDOW) -> list[np.ndarray]:
    """For each text, which of its windows also stand in a passage of a smaller id.

    passages: for each text, ids and words of passages that may recur in it. The windows of all of them are compiled to one
    automaton, each with the smallest id that it comes from, and every text is streamed through it: what it finds are equal words.
    """
    codes: dict[bytes, int] = {}
    read: dict[tuple[int, bytes], np.ndarray] = {}
    for own in passages:
        for key in own:
            if key not in read:
                read[key] = np.array([codes.setdefault(w, len(codes) + 1) for w in key[1].split()], np.int64)
    places = 3
    while len(codes) + 1 >= 128**places:
        places += 1
    first: dict[str, int] = {}
    for (doc, _), numbers in read.items():
        letters = spelled(numbers, places)
        for k in range(0, len(letters) - (window - 1) * places, places):
            phrase = letters[k : k + window * places]
            if first.get(phrase, doc) >= doc:
                first[phrase] = doc
    out = [np.zeros(max(len(t) - window + 1, 0), bool) for t in texts]
    if not first:
        return out
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    docs = np.array(list(first.values()), np.int64)
    for k, phrase in enumerate(first):
        automaton.add_word(phrase, k)
    automaton.make_automaton()
    for text, i, own, hit in zip(texts, ids, passages, out, strict=True):
        if own and len(hit):
            found = np.array(list(automaton.iter(spelled(np.array([codes.get(w, 0) for w in text], np.int64), places))), np.int64).reshape(-1, 2)
            found = found[docs[found[:, 1]] < i]
            hit[found[:, 0] // places - window + 1] = True
    return out


def covered(hit: np.ndarray, n_words: int, window: int = WINDOW) -> np.ndarray:
    """The words that windows cover."""
    edge = np.zeros(n_words + 1, np.int64)
    begins = np.flatnonzero(hit)
    edge[begins] += 1
    edge[begins + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(text_bytes(batch_column(batch, "text"))[1]):
            yield batch.slice(a, b - a)


def _locate(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            ids, whole, flagged = (batch_column(batch, n).to_pylist() for n in ("id", "whole", "flagged"))
            passages, column = batch_column(batch, "passages"), batch_column(batch, "text")
            data, offsets = text_bytes(column)
            raw = data.tobytes()
            words = [raw[a:b].split() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            removed: list[np.ndarray | None] = [np.full(len(own), len(own) >= WINDOW) if w else None for own, w in zip(words, whole, strict=True)]
            unsure: list[list[int] | None] = [None] * len(ids)
            asked = [i for i, known in enumerate(passages.is_valid().to_pylist()) if known and not whole[i]]
            w = windows_of(*text_bytes(column.take(pa.array(asked, pa.int64()))), bits)
            edges = np.searchsorted(w.text, np.arange(len(asked) + 1))
            shard: list[tuple[int, int, list[tuple[int, bytes]]]] = []

            def finish() -> None:
                found = locate([words[i] for _, i, _ in shard], [ids[i] for _, i, _ in shard], [p for _, _, p in shard])  # noqa: B023
                for (k, i, _), hit in zip(shard, found, strict=True):  # noqa: B023
                    removed[i] = covered(hit, len(words[i]))  # noqa: B023
                    hashes = w.hashes[edges[k] : edges[k + 1]]  # noqa: B023
                    confirmed = np.unique(hashes[hit])
                    doubt = ~hit & (np.isin(hashes, confirmed) if len(confirmed) >= flagged[i] else True)  # noqa: B023
                    if doubt.any():
                        unsure[i] = signed(np.unique(hashes[doubt])).tolist()  # noqa: B023
                shard.clear()  # noqa: B023

            size = 0
            for k, i in enumerate(asked):
                own = passages[i].values
                shard.append((k, i, list(zip(own.field("first_doc").to_pylist(), own.field("words").to_pylist(), strict=True))))
                size += PASSAGE * len(own)
                if size >= SHARD_PHRASES:
                    finish()
                    size = 0
            finish()
            kept = [b" ".join(own) if gone is None else b" ".join([x for x, g in zip(own, gone.tolist(), strict=True) if not g]) for own, gone in zip(words, removed, strict=True)]
            counts = [pa.array([len(x) for x in words], pa.int64()), pa.array([0 if g is None else int(g.sum()) for g in removed], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch_column(batch, "id"), *counts, pa.array(kept, pa.binary()).cast(pa.string()), pa.array(unsure, pa.list_(pa.int64()))], ["id", "n_words", "n_removed", "kept_text", "unsure"])

    return run


_LOCATED = "id long, n_words long, n_removed long, kept_text string, unsure array<long>"


def _salt(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int")


def _dealt(values: DataFrame, hot: Filter) -> DataFrame:
    """values with a salt: those in hot once for each, the others once, with 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies = np.where(hot(batch_column(batch, "value").to_numpy().view(np.uint64)), SALTS, 1)
            rows = np.repeat(np.arange(len(batch)), copies)
            salt = np.arange(len(rows)) - np.repeat(np.cumsum(copies) - copies, copies)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(salt.astype(np.int32))], [*batch.schema.names, "salt"])

    return values.mapInArrow(run, T.StructType([*values.schema.fields, T.StructField("salt", T.IntegerType())]))


def _with_passages(pairs: DataFrame, passages: DataFrame) -> DataFrame:
    """id, passages and flagged of each doc_id in pairs (doc_id, first_doc, block, n_windows). A passage that very many documents
    need is dealt to several tasks by a salt of these."""
    asked = pairs.withColumn("salt", _salt(F.col("doc_id")))
    needed = asked.select(F.col("first_doc").alias("from_doc"), F.col("block").alias("from_block"), F.col("salt").alias("to_salt")).distinct()
    texts = passages.groupBy("doc_id", "block").agg(F.collect_set("words").alias("texts")).withColumnsRenamed({"doc_id": "own_doc", "block": "own_block"})
    sent = texts.join(needed, (F.col("own_doc") == F.col("from_doc")) & (F.col("own_block") == F.col("from_block"))).select("from_doc", "from_block", "to_salt", "texts")
    met = asked.join(sent, (F.col("first_doc") == F.col("from_doc")) & (F.col("block") == F.col("from_block")) & (F.col("salt") == F.col("to_salt")))
    each = met.select(F.col("doc_id").alias("flagged_id"), "n_windows", F.transform("texts", lambda x: F.struct(F.col("first_doc"), x.alias("words"))).alias("own"))
    return each.groupBy("flagged_id").agg(F.flatten(F.collect_list("own")).alias("passages"), F.sum("n_windows").alias("flagged"))


def _resolved(located: DataFrame, texts: DataFrame, judged: DataFrame, bits: int) -> DataFrame:
    """located, with those texts done again whose windows share a hash with other words: these windows are counted by their words."""
    doubted = stored(located.where("unsure is not null").select("id", F.explode("unsure").alias("doubted")))
    wanted = doubted.select("doubted").distinct()
    among = Filter(wanted.select(F.col("doubted").alias("value")))
    every = _scan(texts, bits, lambda w: np.flatnonzero(among(w.hashes)), each=True).join(wanted, F.col("value") == F.col("doubted"), "left_semi")
    plain = every.select("value", "doc_id", F.regexp_replace(F.decode("words", "UTF-8"), "[ \\t-\\r]+", " ").cast("binary").alias("words"))
    firsts = plain.groupBy("value", "words").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc")
    exact = firsts.join(doubted, F.col("value") == F.col("doubted")).where("first_doc < id")
    more = exact.groupBy(F.col("id").alias("more_id")).agg(F.collect_set(F.struct("first_doc", "words")).alias("more"))
    redo = judged.join(doubted.select(F.col("id").alias("redo_id")).distinct(), F.col("id") == F.col("redo_id"), "left_semi").join(more, F.col("id") == F.col("more_id"), "left")
    none = F.array().cast(more.schema["more"].dataType)
    redo = redo.select("id", "text", F.concat("passages", F.coalesce("more", none)).alias("passages"), "flagged", "whole")
    # Rows of one id are done again together.
    settled = located.join(doubted.select(F.col("id").alias("redo_id")).distinct(), F.col("id") == F.col("redo_id"), "left_anti")
    return settled.unionByName(redo.mapInArrow(_locate(bits), _LOCATED))


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """id, n_words, n_removed and kept_text of each row: words in a window of 13 that also starts in a document of a smaller id go.

    Words are what stands between blanks, unchanged; kept words are joined by single spaces. Windows are judged on the input.

    Anchors, then windows with a recurring anchor are counted over all documents by their hashes, each summed up before the
    shuffle; that proposes, for each window of a later document, a passage of the first one. These passages' words are sent to the
    later documents; there they are compiled to automata by shards of documents, and every document is streamed through its
    shard's. Words go only where the automaton finds equal words of a smaller id. Windows that it does not confirm share their
    hash with others; they are counted again by their words. hash_bits: bits of a window's hash; any number gives the same rows.
    Copies of a whole text are settled by its digest and left out of the scans.

    Null and empty texts have no words. Rows with a null id lose and cost nothing. Rows of one id are one document for others and
    do not count against each other; repeated rows each give their own row. Texts of any length are taken whole. Other columns are
    not read; an empty table gives no rows.
    """
    rows = bounded_batches(documents).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = rows.where("doc_id is not null")
    # A text with very many copies is dealt to several tasks.
    digests = known.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), _salt(F.col("doc_id")).alias("salt"))
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc")
    first = first.select(F.col("digest").alias("copied"), "first_doc", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("copied_salt"))
    same = (digests["digest"] == first["copied"]) & (digests["salt"] == first["copied_salt"]) & (digests["doc_id"] > first["first_doc"])
    copies = stored(digests.join(first, same).select(F.col("doc_id").alias("copy_id"), "copied").distinct())
    texts = known
    if copies.count() <= BROADCAST_COPIES:
        is_copy = (known["doc_id"] == copies["copy_id"]) & (F.md5(known["text"].cast("binary")) == copies["copied"])
        texts = known.join(F.broadcast(copies), is_copy, "left_anti")

    def new_anchors(w: Windows) -> np.ndarray:
        change = np.ones(len(w.text), bool)
        change[1:] = (w.anchors[1:] != w.anchors[:-1]) | (w.text[1:] != w.text[:-1])
        return np.flatnonzero(change)

    several = F.col("first_doc") < F.col("last_doc")
    span = [F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")]
    table = stored(_scan(texts, hash_bits, new_anchors, of="anchors").groupBy("value").agg(*span).where(several).select("value"))
    anchors = Filter(table)
    discard(table)
    found = _scan(texts, hash_bits, lambda w: np.flatnonzero(anchors(w.anchors))).groupBy("value")
    recurring = stored(found.agg(*span, F.min_by("block", "doc_id").alias("block"), F.count("*").alias("n")).where(several).select("value", "first_doc", "block", "n"))
    repeated, hot = Filter(recurring), Filter(recurring.where(F.col("n") >= HOT_WINDOW))

    occurring = stored(_scan(texts, hash_bits, lambda w: np.flatnonzero(anchors(w.anchors) & repeated(w.hashes)), passages=True, hot=hot), "zstd")
    seen = occurring.where("value is not null").select("value", "doc_id", "salt")
    of = _dealt(recurring.select("value", "first_doc", "block"), hot).withColumnsRenamed({"value": "recurring", "salt": "of_salt"})
    later = seen.join(of, (F.col("value") == F.col("recurring")) & (F.col("salt") == F.col("of_salt"))).where("first_doc < doc_id")
    if not digests.groupBy("doc_id").count().where("count > 1").isEmpty():
        later = later.select("doc_id", "value", "first_doc", "block").distinct()  # a window of repeated rows counts once
    pairs = stored(later.groupBy("doc_id", "first_doc", "block").agg(F.count("*").alias("n_windows")))
    flags = _with_passages(pairs, occurring.where("value is null"))
    whole = copies.groupBy("copy_id").agg(F.collect_set("copied").alias("whole_texts"))
    marked = rows.join(flags, rows["doc_id"] == flags["flagged_id"], "left").join(whole, rows["doc_id"] == whole["copy_id"], "left")
    is_whole = F.coalesce(F.array_contains("whole_texts", F.md5(F.col("text").cast("binary"))), F.lit(False))
    judged = marked.select(F.col("doc_id").alias("id"), "text", "passages", F.coalesce("flagged", F.lit(0)).alias("flagged"), is_whole.alias("whole"))
    located = stored(judged.mapInArrow(_locate(hash_bits), _LOCATED), "zstd")
    if located.where("unsure is not null").isEmpty():
        discard(copies, recurring, occurring, pairs)
    else:
        located = _resolved(located, texts, judged, hash_bits)
    return located.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_text")
