"""Quality: a factorisation machine over hashed words, structure statistics and the length, scored in linear time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import BLANKS, WordHasher, batch_column, bounded_batches, crc_fold, slices, text_bytes
from corpusmill.llm.labelled import training_texts

#: Buckets of hashed words, factors, labelled documents to learn from at most, passes over them.
BUCKETS, FACTORS, MAX_TRAINING, EPOCHS = 1 << 18, 8, 8_000, 20
THRESHOLD = 0.3
#: Decimals of a score: below them it may depend on what is scored beside it.
DIGITS = 6
#: Deviations from the mean that a statistic counts for at most, and the penalty on squared weights of statistics.
REACH, PENALTY = 2.0, 1e-3
_MARKS = np.array([*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F), 0x0A])
N_STATS = len(_MARKS) + 13


def _distinct(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values of each group; groups stand in order. Values count by 40 bits, apart from their group."""
    keys = np.sort(groups.astype(np.uint64) << np.uint64(40) | values >> np.uint64(24))
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[first] >> np.uint64(40)).astype(np.int64), minlength=n)


@dataclass
class Features:
    """stats: a row for each text; words: the distinct buckets of each text's words; share: how many of its words are in the bucket,
    of 1; first: where each text's buckets begin, with the end at last."""

    stats: np.ndarray
    words: np.ndarray
    share: np.ndarray
    first: np.ndarray


@lru_cache(maxsize=1)
def _hashers() -> tuple[WordHasher, WordHasher]:
    """For words and lines, one of each for each process: their tables of powers are large."""
    return WordHasher(BLANKS, lower=True), WordHasher(b"\n", lower=False, seed=3)


def features(data: np.ndarray, offsets: np.ndarray) -> Features:
    n, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1).astype(float)
    words, starts, lengths, first = _hashers()[0].hashes(data, offsets)
    lines, _, _, line_first = _hashers()[1].hashes(data, offsets)
    text_of_byte = np.repeat(np.arange(n), np.diff(offsets))
    histogram = np.bincount(text_of_byte * 256 + data, minlength=n * 256).reshape(n, 256)
    n_words, n_lines = np.diff(first), np.diff(line_first)
    text_of_word = np.repeat(np.arange(n), n_words)
    some_words, some_lines = np.maximum(n_words, 1), np.maximum(n_lines, 1)
    word_bytes = np.bincount(text_of_word, weights=lengths, minlength=n)
    upper, lower = histogram[:, 65:91].sum(1), histogram[:, 97:123].sum(1)
    stats = [
        np.log1p(np.diff(offsets)),
        np.log1p(n_words),
        np.log1p(n_lines),
        word_bytes / some_words / 8,
        np.bincount(text_of_word, weights=lengths > 16, minlength=n) / some_words,
        np.bincount(text_of_word, weights=lengths <= 2, minlength=n) / some_words,
        _distinct(text_of_word, words, n) / some_words,
        _distinct(np.repeat(np.arange(n), n_lines), lines, n) / some_lines,
        np.bincount(text_of_word[1:][(words[1:] == words[:-1]) & (text_of_word[1:] == text_of_word[:-1])], minlength=n) / some_words * 3,
        upper / size * 10,
        lower / size,
        histogram[:, 48:58].sum(1) / size * 10,
        histogram[:, 128:].sum(1) / size,
    ]
    marks = np.log1p(histogram[:, _MARKS] / size[:, None] * 200)
    keys, times = np.unique(text_of_word << 18 | (words >> np.uint64(46)).astype(np.int64), return_counts=True)
    share = (times / np.maximum(n_words, 1)[keys >> 18]).astype(np.float32)
    return Features(np.column_stack([*stats, marks]).astype(np.float32), keys & (BUCKETS - 1), share, np.searchsorted(keys >> 18, np.arange(n + 1)))


@dataclass
class FactorisationMachine:
    """score = b + sum of w x + 1/2 sum over factors of ((sum of v x)^2 - sum of v^2 x^2); x: buckets' shares and scaled statistics.

    A bucket is one input however often its words occur, so it does not interact with itself.
    """

    mean: np.ndarray
    scale: np.ndarray
    bias: float
    word_w: np.ndarray
    word_v: np.ndarray
    stat_w: np.ndarray
    stat_v: np.ndarray

    def _sums(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(f.first) - 1
        x = np.clip((f.stats - self.mean) / self.scale, -REACH, REACH)
        sums, squares, linear = np.zeros((n, FACTORS)), np.zeros((n, FACTORS)), np.zeros(n)
        full = np.flatnonzero(np.diff(f.first))
        if len(full):
            begin = f.first[:-1][full]
            linear[full] = np.add.reduceat(self.word_w[f.words] * f.share, begin)
            vx = self.word_v[f.words] * f.share[:, None]
            sums[full] = np.add.reduceat(vx, begin, axis=0)
            vx *= vx
            squares[full] = np.add.reduceat(vx, begin, axis=0)
        return x, sums + x @ self.stat_v, squares + x**2 @ self.stat_v**2, linear + x @ self.stat_w

    def logits(self, f: Features) -> np.ndarray:
        _, sums, squares, linear = self._sums(f)
        return self.bias + linear + 0.5 * (sums**2 - squares).sum(axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


def _part(f: Features, rows: np.ndarray) -> Features:
    counts = np.diff(f.first)[rows]
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(f.first[:-1][rows] - first[:-1], counts) + np.arange(first[-1])
    return Features(f.stats[rows], f.words[at], f.share[at], first)


def gradients(model: FactorisationMachine, f: Features, labels: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Of the mean loss, without penalties; those of words are given for the buckets that occur, which come second; the bias's last."""
    x, sums, squares, linear = model._sums(f)
    wrong = (sigmoid(model.bias + linear + 0.5 * (sums**2 - squares).sum(axis=1)) - labels) / len(labels)
    used, back = np.unique(f.words, return_inverse=True)
    text = np.repeat(np.arange(len(labels)), np.diff(f.first))
    each = wrong[text] * f.share
    again = np.bincount(back, each * f.share, len(used))
    by_factor = [np.bincount(back, each * sums[text, k], len(used)) for k in range(FACTORS)]
    out = {
        "stat_w": x.T @ wrong,
        "stat_v": x.T @ (wrong[:, None] * sums) - model.stat_v * ((x**2).T @ wrong)[:, None],
        "word_w": np.bincount(back, each, len(used)),
        "word_v": np.column_stack(by_factor) - model.word_v[used] * again[:, None],
    }
    return out, used, float(wrong.sum())


def fit(f: Features, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> FactorisationMachine:
    """Learns by Adam on batches; a bucket's weights and moments change in the batches that hold it. With one label only, or no
    rows, the scores are the smoothed share of label 1."""
    rng, n = np.random.default_rng(seed), len(labels)
    share = (labels.sum() + 1) / (n + 2)
    spread = f.stats.std(axis=0) if n else np.ones(N_STATS)
    real = lambda *shape: rng.normal(0, 0.01, shape).astype(np.float32)
    model = FactorisationMachine(f.stats.mean(axis=0) if n else np.zeros(N_STATS), np.where(spread > 1e-6, spread, 1), float(np.log(share / (1 - share))), np.zeros(BUCKETS, np.float32), real(BUCKETS, FACTORS), np.zeros(N_STATS), real(N_STATS, FACTORS).astype(float))
    if len(set(labels.tolist())) < 2:
        model.word_v[:], model.stat_v[:] = 0, 0
        return model
    names = ("word_w", "word_v", "stat_w", "stat_v")
    moments = {k: [np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))] for k in names}
    step, every = 0, np.arange(N_STATS)
    for _ in range(max(epochs, min(60, 40_000 // n))):
        order = rng.permutation(n)
        for low in range(0, n, 256):
            rows = order[low : low + 256]
            grads, used, bias = gradients(model, _part(f, rows), labels[rows])
            step += 1
            for k in names:
                at, penalty = (used, 1e-5) if k.startswith("word") else (every, PENALTY)
                value, (m1, m2) = getattr(model, k), moments[k]
                g = grads[k] + penalty * value[at]
                m1[at] += 0.1 * (g - m1[at])
                m2[at] += 0.001 * (g**2 - m2[at])
                value[at] -= (0.02 / (1 - 0.9**step) * m1[at] / (np.sqrt(m2[at] / (1 - 0.999**step)) + 1e-8)).astype(value.dtype)
            model.bias -= 0.02 * bias
    return model


def train_quality(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING) -> FactorisationMachine:
    """Features are made on the executors; the driver learns from those of at most limit documents and MAX_BYTES of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = features(*text_bytes(batch_column(batch, "text")))
            own = [(f.words[a:b].astype("<u4").tobytes(), f.share[a:b].astype("<f4").tobytes()) for a, b in zip(f.first[:-1], f.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch_column(batch, "doc_id").cast(pa.string()), pa.array(f.stats.tolist(), pa.list_(pa.float32())), pa.array([w for w, _ in own], pa.binary()), pa.array([x for _, x in own], pa.binary()), batch_column(batch, "label")], ["id", "stats", "words", "share", "label"])

    rows = training_texts(docs, labels, "quality", limit).mapInArrow(run, "id string, stats array<float>, words binary, share binary, label int").collect()
    rows.sort(key=lambda r: (r["id"], r["words"], r["share"]))
    words = [np.frombuffer(r["words"], "<u4").astype(np.int64) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    stats = np.array([r["stats"] for r in rows], np.float32).reshape(len(rows), N_STATS)
    share = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(r["share"], "<f4") for r in rows)])
    return fit(Features(stats, np.concatenate([np.zeros(0, np.int64), *words]), share, first), np.array([r["label"] for r in rows], int))


def score_quality(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score and predicted of each row of docs.

    Null and empty texts get the score of a text without words; texts of any length are taken whole. Repeated rows and null ids
    each give their own row; equal texts have equal scores, which may tie. Other columns are not read, nor is the id an input of
    the score; an empty table gives no rows.
    """
    chosen = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch_column(batch, "text"))
            scores = [sigmoid(model.logits(features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))) for a, b in slices(offsets)]
            yield pa.RecordBatch.from_arrays([batch_column(batch, "id"), pa.array(np.round(np.concatenate([np.zeros(0), *scores]), DIGITS))], ["id", "score"])

    scored = chosen.mapInArrow(run, T.StructType([T.StructField("id", chosen.schema["id"].dataType), T.StructField("score", T.DoubleType())]))
    return scored.select(F.col("id").alias(id_col), (crc_fold(F.col("id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))
