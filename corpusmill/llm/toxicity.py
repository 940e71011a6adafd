"""Toxicity: a bidirectional gated recurrent network over word and character inputs with attention pooling, trained in numpy.

A text is scored by the windows from each of its words on; its score is that of its worst window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import NOT_ALNUM, WordHasher, batch_column, bounded_batches, crc_fold, mixed, release_memory, slices, text_bytes
from corpusmill.llm.labelled import training_texts

#: Words of a window; in training, words from one to the next; state size; widths of the word and character inputs; their hash buckets.
WINDOW, TRAINING_STRIDE, HIDDEN, WORD_DIM, CHAR_DIM = 24, 18, 8, 6, 10
WORD_BUCKETS, CHAR_BUCKETS, GRAM = 1 << 16, 1 << 16, 4
#: Labelled documents to learn from at most, and of them toxic ones; rounds of choosing windows and batches in each.
MAX_TRAINING, MAX_TOXIC, ROUNDS, BATCHES, BATCH = 3_000, 1_000, 10, 24, 256
THRESHOLD = 0.5
#: Decimals of a score: below them it may depend on what is scored beside it.
DIGITS = 6
#: Bytes of text and windows scored at once.
SCORE_BYTES, SCORE_WINDOWS = 1 << 19, 4096


@dataclass
class Words:
    """kind: the number of each word among the distinct ones; bucket: of each distinct word; grams: buckets of all their character
    grams, with each one's first in gram_at; first: as in WordHasher."""

    kind: np.ndarray
    bucket: np.ndarray
    grams: np.ndarray
    gram_at: np.ndarray
    first: np.ndarray


@lru_cache(maxsize=1)
def _hasher() -> WordHasher:
    """One for each process: its tables of powers are large."""
    return WordHasher(NOT_ALNUM, lower=True, seed=5)


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of letters and digits in lower case; grams are GRAM bytes from one before the word's start to one after its end."""
    words, starts, lengths, first = _hasher().hashes(data, offsets)
    words, at, kind = np.unique(words, return_index=True, return_inverse=True)
    starts, lengths = starts[at], lengths[at]
    rng = np.random.default_rng(6)
    # A gram's bytes outside its word count as a mark.
    values = rng.integers(0, 2**63, (GRAM, 257), np.uint64)
    values[:, 65:91] = values[:, 97:123]
    counts = np.maximum(lengths + 2 - (GRAM - 1), 1)
    gram_at = np.cumsum(counts) - counts
    total = int(counts.sum())
    inside = np.arange(total) - np.repeat(gram_at, counts)
    begin, length = np.repeat(starts, counts), np.repeat(lengths, counts)
    sums = np.zeros(total, np.uint64)
    for k in range(GRAM):
        at = inside - 1 + k
        own = (at >= 0) & (at < length)
        sums += values[k][np.where(own, data[np.minimum(begin + np.maximum(at, 0), max(len(data) - 1, 0))], 256)] if total else 0
    return Words(kind, (words >> np.uint64(48)).astype(np.uint16) & np.uint16(WORD_BUCKETS - 1), (mixed(sums) >> np.uint64(48)).astype(np.uint16) & np.uint16(CHAR_BUCKETS - 1), gram_at, first)


def read_slices(data: np.ndarray, offsets: np.ndarray) -> Words:
    """read_words() in slices, so that only its short result is held for all texts."""
    parts = [read_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets, SCORE_BYTES)]
    grams, words, kinds = (np.cumsum([0, *(len(getattr(p, n)) for p in parts)]) for n in ("grams", "kind", "bucket"))
    empty = np.zeros(0, np.uint16)
    return Words(
        np.concatenate([np.zeros(0, np.int64), *(p.kind + k for p, k in zip(parts, kinds, strict=False))]),
        np.concatenate([empty, *(p.bucket for p in parts)]),
        np.concatenate([empty, *(p.grams for p in parts)]),
        np.concatenate([np.zeros(0, np.int64), *(p.gram_at + g for p, g in zip(parts, grams, strict=False))]),
        np.concatenate([*(p.first[:-1] + n for p, n in zip(parts, words, strict=False)), words[-1:]]).astype(np.int64),
    )


def window_starts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first word's number of all windows, one from each word on that WINDOW words follow, and the text of each. Every text has
    one window at least."""
    per = np.maximum(1, np.diff(first) - WINDOW + 1)
    text = np.repeat(np.arange(len(per)), per)
    return first[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per), text


def training_starts(first: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Some of window_starts(): TRAINING_STRIDE apart from an offset that is drawn for each text, and the first and the last one."""
    last = np.maximum(0, np.diff(first) - WINDOW)
    per = -(-last // TRAINING_STRIDE) + 2
    text = np.repeat(np.arange(len(last)), per)
    step = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    offset = rng.integers(0, TRAINING_STRIDE, len(last)) - TRAINING_STRIDE
    begin = np.clip(offset[text] + step * TRAINING_STRIDE, 0, last[text])
    new = np.append(True, (np.diff(text) != 0) | (np.diff(begin) != 0)) if len(text) else np.zeros(0, bool)
    return (begin + first[:-1][text])[new], text[new]


def window_words(w: Words, begin: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Numbers of each window's words among the distinct ones, -1 where it has none."""
    at = begin[:, None] + np.arange(WINDOW)
    inside = at < w.first[1:][text][:, None]
    out = np.full(at.shape, -1)
    out[inside] = w.kind[at[inside]]
    return out


def windows(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """window_words() of all windows and the text of each."""
    begin, text = window_starts(w.first)
    return window_words(w, begin, text), text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters and both passes. Gates are update, reset and candidate, each HIDDEN wide, for either direction."""

    def __init__(self, seed: int = 0, bias: float = -1.0) -> None:
        rng, h, d = np.random.default_rng(seed), HIDDEN, WORD_DIM + CHAR_DIM
        real = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {
            "word": real(WORD_BUCKETS, WORD_DIM, scale=0.01),
            "char": real(CHAR_BUCKETS, CHAR_DIM, scale=0.01),
            "w": real(2, d, 3 * h, scale=d**-0.5),
            "b": np.zeros((2, 1, 3 * h), np.float32),
            "u": real(2, h, 3 * h, scale=h**-0.5),
            "a": real(2 * h, scale=0.1),
            "o": real(2 * h, scale=0.5),
            "c": np.array([bias], np.float32),
        }
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.step = 0

    def inputs(self, w: Words) -> np.ndarray:
        """A row for each distinct word, and a row of zeros at last for what is outside a window."""
        x = np.zeros((len(w.bucket) + 1, WORD_DIM + CHAR_DIM), np.float32)
        if len(w.bucket):
            x[:-1, :WORD_DIM] = self.p["word"][w.bucket]
            counts = np.diff(np.append(w.gram_at, len(w.grams)))
            x[:-1, WORD_DIM:] = np.add.reduceat(self.p["char"][w.grams], w.gram_at, axis=0) / np.sqrt(counts)[:, None]
        return x

    def forward(self, x: np.ndarray, at: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows given as rows of word numbers."""
        p, h, (n, steps) = self.p, HIDDEN, at.shape
        gates = np.matmul(x[None], p["w"]) + p["b"]  # once for each word, not for each window that it is in
        mask = (at >= 0).astype(np.float32)
        both = np.zeros((steps, 2, n, h), np.float32)
        state = np.zeros((2, n, h), np.float32)
        memory = []
        for t in range(steps):
            here = (t, steps - 1 - t)
            g = np.stack([gates[0][at[:, here[0]]], gates[1][at[:, here[1]]]])
            r = np.matmul(state, p["u"])
            zr = sigmoid(g[..., : 2 * h] + r[..., : 2 * h])
            z, reset = zr[..., :h], zr[..., h:]
            fresh = np.tanh(g[..., 2 * h :] + reset * r[..., 2 * h :])
            m = np.stack([mask[:, here[0]], mask[:, here[1]]])[..., None]
            new = state + m * (1 - z) * (fresh - state)
            if keep:
                memory.append((state, r[..., 2 * h :], z, reset, fresh, m))
            state = new
            both[here[0], 0], both[here[1], 1] = state[0], state[1]
        hidden = np.concatenate([both[:, 0], both[:, 1]], axis=-1)  # steps, n, 2h
        energy = hidden @ p["a"] + (mask.T - 1) * 1e4
        weight = np.exp(energy - energy.max(axis=0))
        weight /= weight.sum(axis=0)
        weight = weight * mask.T
        pooled = np.einsum("tn,tnk->nk", weight, hidden)
        return pooled @ p["o"] + p["c"][0], {"memory": memory, "hidden": hidden, "weight": weight, "pooled": pooled, "x": x, "at": at} if keep else {}

    def sliding_gates(self, w: Words) -> np.ndarray:
        """What slide() needs of each distinct word: gate, direction, word; and, as further gates, the state (as slide() keeps it)
        after the word alone, the same for all windows that begin with it."""
        p, h = self.p, HIDDEN
        gates = np.matmul(self.inputs(w)[:-1][None], p["w"]) + p["b"]
        scale = np.repeat(np.array([1, -1, -2], np.float32), h)
        with np.errstate(over="ignore"):
            first = 0.5 + (1 / (1 + np.exp(-2 * gates[..., 2 * h :])) - 0.5) / (1 + np.exp(gates[..., :h]))
        gates[..., : 2 * h] -= p["u"][:, :, : 2 * h].sum(axis=1, keepdims=True)
        return np.ascontiguousarray(np.concatenate([gates * scale, first], axis=-1).transpose(2, 0, 1))

    def slide(self, gates: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Logits of the full windows from each of these words on, whatever texts they lie in: forward() with a column for each window.

        The words of all windows' step t are one stretch, so nothing is gathered; of a state only its energy and its part of the
        output are kept. The backward direction reads the words from the last to the first, so that its step t is the same stretch and
        both directions are one array: few calls, of arrays that a core's cache holds. All is written with 1 / (1 + exp), half as dear
        as tanh: 1 - z is 1 / (1 + exp(x)), tanh(x) is 2 / (1 + exp(-2x)) - 1, and the state is kept as (1 + state) / 2, for which
        that is 1 / (1 + exp(-2x)).
        """
        p, h, n = self.p, HIDDEN, len(kind) - WINDOW + 1
        own = np.empty((4 * h, 2, len(kind)), np.float32)
        for d, order in enumerate((kind, kind[::-1])):
            own[:, d] = np.take(gates[:, d], order, axis=1)
        scale, both = np.repeat(np.array([1, -1, -2], np.float32), h)[:, None], []
        for d in range(2):
            rows = np.concatenate([p["u"][d].T * scale, p["a"][None, d * h : (d + 1) * h], p["o"][None, d * h : (d + 1) * h]])
            # Twice the half state less one: what the one takes off stands in the gates, or in a column for a row of ones.
            off = -rows.sum(axis=1, keepdims=True)
            off[: 2 * h] = 0
            both.append(np.concatenate([2 * rows, off], axis=1).astype(np.float32))
        half, r = np.ones((h + 1, 2, n), np.float32), np.empty((3 * h + 2, 2, n), np.float32)
        half[:h] = own[3 * h :, :, :n]
        state, zr, fresh = half[:h], r[: 2 * h], r[2 * h : 3 * h]
        said = np.empty((WINDOW, 2, 2, n), np.float32)  # step, energy and value, direction, window
        with np.errstate(over="ignore"):  # 1 / (1 + inf) is 0, as it should be
            for t in range(1, WINDOW):
                for d in range(2):
                    np.matmul(both[d], half[:, d], out=r[:, d])
                said[t - 1] = r[3 * h :]
                zr += own[: 2 * h, :, t : t + n]
                np.exp(zr, out=zr)
                zr += 1
                fresh /= zr[h:]
                fresh += own[2 * h : 3 * h, :, t : t + n]
                np.exp(fresh, out=fresh)
                fresh += 1
                np.reciprocal(fresh, out=fresh)
                fresh -= state
                fresh /= zr[:h]
                state += fresh
        for d in range(2):
            said[-1, :, d] = both[d][3 * h :] @ half[:, d]
        energy, value = (said[:, k, 0] + said[::-1, k, 1, ::-1] for k in range(2))
        energy -= energy.max(axis=0)
        np.exp(energy, out=energy)
        return np.einsum("tn,tn->n", energy, value) / energy.sum(axis=0) + p["c"][0]

    def backward(self, wrong: np.ndarray, kept: dict, w: Words) -> dict[str, np.ndarray]:
        """Gradients; wrong: of the loss by each logit."""
        p, h, x, at = self.p, HIDDEN, kept["x"], kept["at"]
        n, steps = at.shape
        hidden, weight, pooled = kept["hidden"], kept["weight"], kept["pooled"]
        grads = {"o": pooled.T @ wrong, "c": np.array([wrong.sum()], np.float32)}
        d_pooled = wrong[:, None] * p["o"]
        d_weight = np.einsum("tnk,nk->tn", hidden, d_pooled)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
        grads["a"] = np.einsum("tn,tnk->k", d_energy, hidden)
        d_hidden = weight[..., None] * d_pooled + d_energy[..., None] * p["a"]
        d_gates = np.zeros((2, steps, n, 3 * h), np.float32)
        d_u, d_state = np.zeros_like(p["u"]), np.zeros((2, n, h), np.float32)
        for t in range(steps - 1, -1, -1):
            here = (t, steps - 1 - t)
            state, inner, z, reset, fresh, m = kept["memory"][t]
            d_new = d_state + np.stack([d_hidden[here[0]][:, :h], d_hidden[here[1]][:, h:]])
            d_fresh = d_new * m * (1 - z) * (1 - fresh**2)
            d_z = d_new * m * (state - fresh) * z * (1 - z)
            d_reset = d_fresh * inner * reset * (1 - reset)
            d_g = np.concatenate([d_z, d_reset, d_fresh], axis=-1)
            d_r = np.concatenate([d_z, d_reset, d_fresh * reset], axis=-1)
            d_u += np.matmul(state.transpose(0, 2, 1), d_r)
            d_state = d_new * (1 - m * (1 - z)) + np.matmul(d_r, p["u"].transpose(0, 2, 1))
            d_gates[0, here[0]], d_gates[1, here[1]] = d_g[0], d_g[1]
        flat = d_gates.reshape(2, steps * n, 3 * h)
        own = x[at.T.reshape(-1)]
        grads |= {"u": d_u, "w": np.matmul(own.T[None], flat), "b": flat.sum(axis=1, keepdims=True)}
        d_x = np.matmul(flat, p["w"].transpose(0, 2, 1)).sum(axis=0)
        rows = at.T.reshape(-1)
        real = rows >= 0
        rows, d_x = rows[real], d_x[real]
        grads["word"] = _scatter(w.bucket[rows], d_x[:, :WORD_DIM], WORD_BUCKETS)
        counts = np.diff(np.append(w.gram_at, len(w.grams)))[rows]
        of = np.repeat(np.arange(len(rows)), counts)
        begin = np.cumsum(counts) - counts
        each = w.grams[np.repeat(w.gram_at[rows] - begin, counts) + np.arange(int(counts.sum()))]
        grads["char"] = _scatter(each, (d_x[:, WORD_DIM:] / np.sqrt(counts)[:, None])[of], CHAR_BUCKETS)
        return grads

    def learn(self, w: Words, x_words: np.ndarray, at: np.ndarray, labels: np.ndarray, rate: float) -> float:
        logits, kept = self.forward(x_words, at, keep=True)
        score = sigmoid(logits)
        grads = self.backward(((score - labels) / len(labels)).astype(np.float32), kept, w)
        self.step += 1
        for k, g in grads.items():
            m1, m2 = self.moments[k]
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            self.p[k] -= (rate / (1 - 0.9**self.step) * m1 / (np.sqrt(m2 / (1 - 0.99**self.step)) + 1e-6)).astype(np.float32)
        return float(-np.mean(labels * np.log(score + 1e-6) + (1 - labels) * np.log(1 - score + 1e-6)))


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.column_stack([np.bincount(rows, values[:, k], n) for k in range(values.shape[1])]).astype(np.float32)


def all_logits(model: Network, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all windows, in the order of window_starts(), and the text of each."""
    begin, text = window_starts(w.first)
    short = (np.diff(w.first) < WINDOW)[text]
    out = np.empty(len(begin), np.float32)
    rows = np.flatnonzero(short)
    for a in range(0, len(rows), 4096):
        own = rows[a : a + 4096]
        out[own] = _window_logits(model, w, window_words(w, begin[own], text[own]))
    rows = np.flatnonzero(~short)
    if len(rows):
        slid, gates = np.empty(len(w.kind), np.float32), model.sliding_gates(w)
        for a in range(0, len(w.kind) - WINDOW + 1, SCORE_WINDOWS):
            b = min(a + SCORE_WINDOWS + WINDOW - 1, len(w.kind))
            slid[a : b - WINDOW + 1] = model.slide(gates, w.kind[a:b])
        out[rows] = slid[begin[rows]]
    return out, text


def score_words(model: Network, w: Words) -> np.ndarray:
    """The worst window's score of each text."""
    logits, text = all_logits(model, w)
    worst = np.full(len(w.first) - 1, -np.inf)
    np.maximum.at(worst, text, logits)
    return sigmoid(worst)


def fit(w: Words, labels: np.ndarray, rounds: int = ROUNDS, seed: int = 0) -> Network:
    """Learns from labels of whole texts: of a toxic text the windows that now look worst, of others any and the
    worst, and clean words repeated.

    With one label only, or no texts, every score is the smoothed share of label 1.
    """
    n = len(labels)
    share = (labels.sum() + 1) / (n + 2)
    if len(set(labels.tolist())) < 2:
        model = Network(seed, float(np.log(share / (1 - share))))
        model.p["o"][:] = 0
        return model
    model, rng = Network(seed), np.random.default_rng(seed)
    for k in range(rounds):
        # Windows from other words on in each round, so that they are learnt wherever they begin.
        begin, text = training_starts(w.first, rng)
        at, toxic = window_words(w, begin, text), labels[text] == 1
        logits = rng.normal(0, 1, len(text))
        if k:
            logits = np.concatenate([_window_logits(model, w, at[a : a + 4096]) for a in range(0, len(at), 4096)])
        order = np.lexsort((-logits, text))
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order)) - np.searchsorted(text, text[order])
        # Early rounds take many windows of a toxic text, later ones its worst.
        most = (8, 4, 2)[k] if k < 3 else 1
        positive = np.flatnonzero(toxic & (place < most))
        hard = np.flatnonzero(~toxic)
        hard = hard[np.argsort(-logits[hard])][: BATCHES * BATCH // 8]
        clean = np.flatnonzero(~toxic)
        for _ in range(BATCHES):
            half, eighth = BATCH // 2, BATCH // 8
            rows = np.concatenate([rng.choice(positive, half), rng.choice(clean, half - 2 * eighth), rng.choice(hard, eighth)])
            # Windows of one or two clean words over and over: repetition alone is no sign of toxicity.
            one, other = at[rng.choice(clean, eighth), :2].T
            repeated = np.where(np.arange(WINDOW) % 2 == 0, one[:, None], np.where((rng.random(eighth) < 0.5) | (other < 0), one, other)[:, None])
            part, own = _pick(w, np.concatenate([at[rows], repeated]))
            model.learn(part, model.inputs(part), own, np.repeat([1.0, 0.0], half).astype(np.float32), 0.01 if k < rounds * 2 // 3 else 0.003)
    return model


def _pick(w: Words, at: np.ndarray) -> tuple[Words, np.ndarray]:
    """Only the words of these windows, and the windows in their numbers."""
    used, back = np.unique(at[at >= 0], return_inverse=True)
    own = np.full(at.shape, -1)
    own[at >= 0] = back
    counts = np.diff(np.append(w.gram_at, len(w.grams)))[used]
    begin = np.cumsum(counts) - counts
    grams = w.grams[np.repeat(w.gram_at[used] - begin, counts) + np.arange(int(counts.sum()))]
    return Words(np.arange(len(used)), w.bucket[used], grams, begin, np.array([0, len(used)])), own


def _window_logits(model: Network, w: Words, at: np.ndarray) -> np.ndarray:
    part, own = _pick(w, at)
    return model.forward(model.inputs(part), own)[0]


def train_toxicity(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING, toxic_limit: int = MAX_TOXIC) -> Network:
    """Learns on the driver from whole texts of at most limit documents, of them at most toxic_limit toxic ones, with MAX_BYTES
    together at most."""
    rows = training_texts(docs, labels, "toxic", limit, toxic_limit).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    data, offsets = text_bytes(pa.array([r["text"] for r in rows], pa.large_string()))
    return fit(read_slices(data, offsets), np.array([r["label"] for r in rows], int))


def _scores(model: Network, texts: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(texts)
    parts = [score_words(model, read_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in slices(offsets, SCORE_BYTES)]
    release_memory()
    return np.round(np.concatenate([np.zeros(0), *parts]), DIGITS)


class Scorer:
    """What executors get: the parameters, of fixed size, without the training's state."""

    def __init__(self, model: Network) -> None:
        self.parameters = model.p

    def __call__(self, texts: pa.Array) -> np.ndarray:
        model = Network.__new__(Network)
        model.p = self.parameters
        return _scores(model, texts)


def score_toxicity(docs: DataFrame, model: Network, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score and predicted of each row of docs.

    Null and empty texts get the score of a window without words; of texts of any length all windows are scored. Repeated rows and
    null ids each give their own row; equal texts have equal scores, which may tie. Other columns are not read, nor is the id an
    input of the score; an empty table gives no rows.
    """
    chosen, scorer = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), Scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch_column(batch, "id"), pa.array(scorer(batch_column(batch, "text")))], ["id", "score"])

    scored = chosen.mapInArrow(run, T.StructType([T.StructField("id", chosen.schema["id"].dataType), T.StructField("score", T.DoubleType())]))
    return scored.select(F.col("id").alias(id_col), (crc_fold(F.col("id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def toxicity_of(text: Column, model: Network) -> Column:
    """The score as a Column, for filters that keep all other columns."""
    scorer = Scorer(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(scorer(texts))

    return score(text)
