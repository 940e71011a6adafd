"""Benchmark decontamination: CGK embeddings and repeated bit sampling find item-sized windows, edit distance confirms them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import NOT_ALNUM, WordHasher, batch_column, bounded_batches, golden, grams, mixed, release_memory, slices, text_bytes

#: A window contains an item if their edit distance in words is at most this share of the item's words.
MAX_SHARE = 0.2
#: Items with fewer words are looked for as they stand. With fewer code points than these they are reported, but reject no document:
#: a word or two stands in many that never saw the benchmark.
MIN_WORDS, EVIDENCE_CHARS = 8, 20
#: Embeddings, and sampled places of each. See recall_of() for what they reach.
REPEATS, SAMPLES = 40, 3
#: Items and bytes of item text that go to the executors at once; a larger benchmark takes several passes.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
#: Pairs of windows and items whose edit distances are taken at once.
EDIT_PAIRS = 512
_OUTSIDE = np.uint64(0)


def edits(n: int, max_share: float = MAX_SHARE) -> int:
    return int(n * max_share + 1e-9)


def cgk_keys(windows: np.ndarray, repeats: int = REPEATS, samples: int = SAMPLES) -> np.ndarray:
    """A key for each repeat and window; windows: a row of word hashes each, 0 where there is no word.

    Each repeat walks along the window with its own random bits: at step j it puts out the word it stands on and goes on to the
    next one if the bit that the word has at step j is set. Words edited on one side put the walks apart only until they meet
    again, so edit distance becomes Hamming distance; the key is the output at a few sampled steps.
    """
    count, n = windows.shape
    rng = np.random.default_rng(1_000 + n)
    steps = np.sort(rng.integers(0, 2 * n, (repeats, samples)), axis=1)
    padded = np.concatenate([windows, np.full((count, 1), _OUTSIDE)], axis=1).reshape(-1)
    seeds = mixed(np.arange(1, repeats + 1, dtype=np.uint64) * np.uint64(0x51_7C_C1_B7_27_22_0A_95))[:, None]
    base = np.arange(count) * (n + 1)
    at, key = np.zeros((repeats, count), np.int64), np.repeat(seeds, count, axis=1)
    for j in range(int(steps.max()) + 1):
        word = padded[base + at]
        for k in range(samples):
            now = steps[:, k] == j
            if now.any():
                key[now] = mixed(key[now] ^ (word[now] + golden(k + 1)))
        at += ((word ^ seeds) * (golden(2 * j + 1) | np.uint64(1)) >> np.uint64(63)).astype(np.int64)
        np.minimum(at, n, out=at)
    return key


def edit_distances(items: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """For each row, the least edit distance of the item's words to any run of the context's words."""
    count, m = contexts.shape
    steps = np.arange(m + 1)
    row = np.zeros((count, m + 1), np.int64)
    for i in range(items.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (contexts != items[:, i : i + 1]))
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row.min(axis=1)


class _Members:
    """Whether 64-bit hashes are in a set: a table of bits first, then a search in what passes."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.unique(values)
        self.shift = np.uint64(64 - 22)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.values >> self.shift] = True

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in x whose value is in the set, and the value's number there."""
        at = np.flatnonzero(self.bits[x >> self.shift])
        if not len(self.values):
            return at[:0], at[:0]
        found = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        same = self.values[found] == x[at]
        return at[same], found[same]


_SPACED = {c: " " if c in NOT_ALNUM and not 65 <= c <= 90 else chr(c).lower() for c in range(128)}


def _squeezed(text: str) -> str:
    """The text's words in lower case, a space between any two."""
    return " ".join(w for w in text.translate(_SPACED).split(" ") if w)


class ShortItems:
    """Finds items of few words where the same words stand in a text. A script without spaces is looked for within its runs."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.names: dict[str, list[int]] = {}
        for name, text in items:
            plain = _squeezed(text)
            own = (" " if plain[0].isascii() else "") + plain + (" " if plain[-1].isascii() else "")
            self.names.setdefault(own, []).append(name)
        self.keys = list(self.names)
        self.n_words = [len(k.split(" ")) - k.startswith(" ") - k.endswith(" ") for k in self.keys]

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, key in enumerate(self.keys):
            out.add_word(key, k)
        out.make_automaton()
        return out

    def __getstate__(self) -> dict:
        """Without the automaton: each process makes its own."""
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def find(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """As Matcher.find(): the first place of each item in each text."""
        out = []
        for i, text in enumerate(texts):
            plain = f" {_squeezed(text.as_py() or '')} "
            ends: dict[int, int] = {}
            for end, k in self.automaton.iter(plain):
                ends.setdefault(k, end)
            for k, end in ends.items():
                begin = end + 1 - len(self.keys[k]) + self.keys[k].startswith(" ")
                out += [(i, name, 0, self.n_words[k], plain.count(" ", 0, begin) - 1) for name in self.names[self.keys[k]]]
        return out


class Matcher:
    """Finds the items of one block of the benchmark in texts."""

    def __init__(self, items: list[tuple[int, str]], max_share: float = MAX_SHARE, short_chars: int = 1) -> None:
        """short_chars: code points that items of fewer than MIN_WORDS words need to be looked for."""
        self.hasher, self.max_share = WordHasher(NOT_ALNUM, lower=True, seed=11), max_share
        data, offsets = text_bytes(pa.array([t for _, t in items], pa.large_string()))
        words, _, _, first = self.hasher.hashes(data, offsets)
        by_size: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        short = []
        for (name, text), a, b in zip(items, first[:-1], first[1:], strict=True):
            if b - a >= MIN_WORDS:
                by_size[int(b - a)].append((name, words[a:b]))
            elif len(_squeezed(text)) >= short_chars:
                short.append((name, text))
        self.short = ShortItems(short) if short else None
        pairs = {n: np.concatenate([grams(w, 2) for _, w in own]) for n, own in by_size.items()}
        self.pairs = _Members(np.concatenate([np.zeros(0, np.uint64), *pairs.values()]))
        self.has_pair = {n: np.isin(self.pairs.values, own) for n, own in pairs.items()}
        self.sizes = {}
        for n, own in sorted(by_size.items()):
            rows = np.array([w for _, w in own])
            keys = cgk_keys(rows)
            order = np.argsort(keys, axis=1)
            self.sizes[n] = (np.array([name for name, _ in own], np.int64), rows, np.take_along_axis(keys, order, 1), order)

    def _starts(self, words: np.ndarray, first: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each size, the starts of all windows that can be within reach of an item, and their texts.

        An edit destroys at most two of an item's pairs of neighbouring words and moves its end by one word. So an n-word window
        that begins at the first kept pair of a run within k edits holds at least n - 1 - 3k of the pairs that items of n words
        have. That pair is at most 2k words into the run: every start from 2k words before such a window on is taken, and the
        start of the run is among them.
        """
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        all_hits, number = self.pairs(grams(words, 2))
        inside = text[all_hits] == text[all_hits + 1]
        all_hits, number = all_hits[inside], number[inside]
        out = {}
        for n in self.sizes:
            k, hits = edits(n, self.max_share), all_hits[self.has_pair[n][number]]
            end = np.minimum(hits + n - 1, first[1:][text[hits]] - 1)
            hits = hits[np.searchsorted(hits, end) - np.arange(len(hits)) >= max(1, n - 1 - 3 * k)]
            if not len(hits):
                continue
            low = np.maximum(hits - 2 * k, first[:-1][text[hits]])
            low[1:] = np.maximum(low[1:], hits[:-1] + 1)
            counts = hits + 1 - low
            starts = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            out[n] = starts, text[starts]
        return out

    def find(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """text number, item, distance, item's words and the window's first word; the best window for each text and item, of equal
        distances the first."""
        if not self.short:
            return self._find_long(texts)
        best = {}
        for row in self._find_long(texts) + self.short.find(texts):
            key = row[:2]
            best[key] = min(best.get(key, row), row, key=lambda r: (r[2], r[4]))
        return sorted(best.values())

    def _find_long(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        data, offsets = text_bytes(texts)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if not self.sizes:
            return []
        read: list[tuple[np.ndarray, np.ndarray]] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        base = 0
        for a, b in slices(offsets):
            words, _, _, first = self.hasher.hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for n, (starts, text) in self._starts(words, first).items():
                found[n].append((starts + base, text + a))
            read.append((words, first[:-1] + base))
            base += len(words)
        if not found:
            return []
        words, first = np.concatenate([w for w, _ in read]), np.append(np.concatenate([f for _, f in read]), base)
        for n, parts in found.items():
            names, rows, keys, order = self.sizes[n]
            k = edits(n, self.max_share)
            starts, text = (np.concatenate(x) for x in zip(*parts, strict=True))
            for low in range(0, len(starts), 4096):
                of, at = text[low : low + 4096], starts[low : low + 4096, None] + np.arange(n)
                own = np.where(at < first[1:][of][:, None], words[np.minimum(at, base - 1)], _OUTSIDE)
                # Of an item's starts in one block of k + 1 the first is looked at, with k words more around than edits may take.
                block = starts[low : low + 4096] // (k + 1)
                candidates: dict[tuple[int, int, int], int] = {}
                for r, mine in enumerate(cgk_keys(own)):
                    left, right = np.searchsorted(keys[r], mine, "left"), np.searchsorted(keys[r], mine, "right")
                    for w in np.flatnonzero(right > left).tolist():
                        for i in order[r][left[w] : right[w]].tolist():
                            place = int(of[w]), int(block[w]), i
                            candidates[place] = min(candidates.get(place, w), w)
                if not candidates:
                    continue
                every = np.array(sorted((w, i) for (_, _, i), w in candidates.items()))
                for pairs in np.array_split(every, -(-len(every) // EDIT_PAIRS)):
                    at, own = starts[low + pairs[:, 0], None] + np.arange(-4 * k, n + 4 * k), of[pairs[:, 0]]
                    within = (at >= first[:-1][own][:, None]) & (at < first[1:][own][:, None])
                    distance = edit_distances(rows[pairs[:, 1]], np.where(within, words[np.clip(at, 0, base - 1)], _OUTSIDE))
                    for (w, i), d in zip(pairs[distance <= k], distance[distance <= k], strict=True):
                        key, made = (int(of[w]), int(names[i])), (int(d), n, int(starts[low + w] - first[of[w]]))
                        if key not in best or made < best[key]:
                            best[key] = made
        return [(*key, *value) for key, value in sorted(best.items())]


def matchers(benchmark: DataFrame, max_share: float = MAX_SHARE, short_chars: int = 1) -> Iterator[Matcher]:
    """A Matcher for each block of the benchmark. Items with a null id or text are left out."""
    items = bounded_batches(benchmark).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for block in range(blocks):
        yield Matcher([(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()], max_share, short_chars)


def contaminated(documents: DataFrame, benchmark: DataFrame, max_share: float = MAX_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, item_id, distance, item_words, similarity and first_word of each item that a document contains.

    A document contains an item if some run of its words is within max_share of the item's words in edit distance. Words are runs
    of letters and digits in lower case. Items with fewer than MIN_WORDS words must stand as they are, those without words match
    nothing. Null and empty texts contain nothing; texts of any length are taken whole. Of places that tie the first counts.
    Repeated rows each give their own rows, as do null ids; other columns are not read; empty tables give no rows.
    """
    chosen = bounded_batches(documents).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = T.StructType([T.StructField("id", chosen.schema["id"].dataType)] + [T.StructField(n, T.LongType()) for n in ("item_id", "distance", "item_words", "first_word")])

    def scan(matcher: Matcher) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = list(zip(*matcher.find(batch_column(batch, "text")), strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([batch_column(batch, "id").take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:])], kind.names)

        return chosen.mapInArrow(run, kind)

    out = None
    for matcher in matchers(benchmark, max_share):
        out = scan(matcher) if out is None else out.unionByName(scan(matcher))
    return out.select(F.col("id").alias(id_col), "item_id", "distance", "item_words", (1 - F.col("distance") / F.col("item_words")).alias("similarity"), "first_word")


def contains_item(text: Column, benchmark: DataFrame, max_share: float = MAX_SHARE) -> Column:
    """Whether the text contains any item, as a Column, for filters that keep all other columns.

    Items with fewer than MIN_WORDS words count from EVIDENCE_CHARS code points on.
    """
    out = F.lit(False)
    for matcher in matchers(benchmark, max_share, EVIDENCE_CHARS):
        out = out | _hits(matcher)(text)
    return out


def _hits(matcher: Matcher):
    @F.arrow_udf("boolean")
    def hit(texts: pa.Array) -> pa.Array:
        found = np.zeros(len(texts), bool)
        found[[row[0] for row in matcher.find(texts)]] = True
        release_memory()
        return pa.array(found)

    return hit


def recall_of(share: float, n: int = 34, trials: int = 400, seed: int = 0, front: str = "") -> float:
    """The share of passages, edited in that share of their words, of which a window that is hashed gets a key of its item.

    front: "" edits at random places and looks at the window that begins with the passage only; "clipped" leaves out the first
    words, "edited" replaces them, and the starts looked at are those from 2k words before the first kept pair up to it.
    """
    rng = np.random.default_rng(seed)
    k = edits(n, share)
    items = rng.integers(1, 2**63, (trials, n), np.uint64)
    if front:
        # The kept words begin 2k words into the text, so starts 0 to 2k are looked at.
        before = rng.integers(1, 2**63, (trials, 2 * k), np.uint64)
        after = rng.integers(1, 2**63, (trials, n), np.uint64)
        passage = items[:, k:] if front == "clipped" else np.concatenate([before[:, :k], items[:, k:]], axis=1)
        texts = np.concatenate([before if front == "clipped" else before[:, k:], passage, after], axis=1)
        own = cgk_keys(items)
        found = np.zeros(trials, bool)
        for start in range(2 * k + 1):
            found |= (own == cgk_keys(np.ascontiguousarray(texts[:, start : start + n]))).any(axis=0)
        return float(found.mean())
    edited = np.zeros_like(items)
    for row, item in enumerate(items):
        words = list(item)
        for _ in range(k):
            at, kind = int(rng.integers(len(words))), rng.integers(3)
            if kind == 0:
                words[at] = rng.integers(1, 2**63, dtype=np.uint64)
            elif kind == 1:
                words.insert(at, rng.integers(1, 2**63, dtype=np.uint64))
            else:
                del words[at]
        words = (words + list(rng.integers(1, 2**63, n, np.uint64)))[:n]
        edited[row] = words
    return float((cgk_keys(items) == cgk_keys(edited)).any(axis=0).mean())
