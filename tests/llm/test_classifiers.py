import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.llm import quality, toxicity
from corpusmill.llm.common import text_bytes
from corpusmill.llm.labelled import training_texts
from corpusmill.llm.queries import op4_quality, op6_toxicity
from tests.llm.tables import EDGE_TEXTS, edge_docs, no_docs, table

#: The largest of the small tables: it has labels enough to tell.
SF = "/root/testdata/sf0.1"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def auc(scores, labels):
    ranks = np.empty(len(scores))
    ranks[np.argsort(scores)] = np.arange(len(scores))
    n = labels.sum()
    return (ranks[labels == 1].mean() - (n - 1) / 2) / (len(labels) - n)


def check(spark, query, label, threshold, least):
    rows = query(spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    assert all(r["held_out"] == held_out(r["doc_id"]) and r["predicted"] == int(r["score"] >= threshold) and 0 <= r["score"] <= 1 for r in rows)
    labels = {r["doc_id"]: r[label] for r in table(spark, SF, "labels").collect()}
    tested = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert auc(np.array([r["score"] for r in tested]), np.array([labels[r["doc_id"]] for r in tested])) >= least


def test_quality_query(spark):
    check(spark, op4_quality, "quality", 0.3, 0.99)


def test_toxicity_query(spark):
    """Many of these tables' toxic labels stand for nothing that a text of that language says, so no more can be asked for."""
    check(spark, op6_toxicity, "toxic", 0.5, 0.9)


def planted(n, seed=0):
    rng = np.random.default_rng(seed)
    syllables = ["ra", "to", "mi", "ke", "lu", "sa", "no", "ti"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(2, 5)))
    texts, labels = [], []
    for i in range(n):
        words = [word() for _ in range(int(rng.integers(5, 120)))]
        toxic = i % 3 == 0
        for _ in range(int(rng.integers(1, 4)) if toxic else 0):
            words.insert(int(rng.integers(len(words) + 1)), ["zork" + word(), "Grumph"][int(rng.integers(2))])
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, np.array(labels)


def test_toxicity_learns_words_and_stems():
    texts, labels = planted(500)
    data, offsets = text_bytes(pa.array(texts))
    model = toxicity.fit(toxicity.read_slices(data, offsets), labels)
    fresh, want = planted(300, seed=1)
    got = toxicity.Scorer(model)(pa.array(fresh)) >= 0.5
    assert (got == want).mean() > 0.97
    again = toxicity.fit(toxicity.read_slices(data, offsets), labels)
    assert np.allclose(toxicity.Scorer(again)(pa.array(fresh)), toxicity.Scorer(model)(pa.array(fresh)))


def plain_words(*ends):
    """Texts of distinct words that end there."""
    every = np.arange(ends[-1])
    return toxicity.Words(every, every, every, every, np.array([0, *ends]))


def test_gradients():
    """Against differences of the loss."""
    data, offsets = text_bytes(pa.array(["one two three four", "five six", "one six seven eight nine ten"]))
    words = toxicity.read_words(data, offsets)
    at, _ = toxicity.windows(words)
    model, labels = toxicity.Network(3), np.array([1.0, 0.0, 1.0])
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    model.p["word"] *= 50
    model.p["char"] *= 50

    def loss():
        s = toxicity.sigmoid(model.forward(model.inputs(words), at)[0].astype(float))
        return -(labels * np.log(s) + (1 - labels) * np.log(1 - s)).sum()

    logits, kept = model.forward(model.inputs(words), at, keep=True)
    grads = model.backward((toxicity.sigmoid(logits) - labels).astype(np.float32), kept, words)
    for name in ("w", "u", "b", "a", "o", "c"):
        flat, g = model.p[name].reshape(-1), np.asarray(grads[name]).reshape(-1)
        for i in np.linspace(0, flat.size - 1, 5).astype(int):
            old, step = flat[i], 1e-2
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * step) - g[i]) < 2e-2 * (1 + abs(g[i])), name
    # The tables: all rows that occur, and some that do not.
    for name, used in (("word", words.bucket), ("char", words.grams)):
        rows, table_, g = np.unique(used), model.p[name], grads[name]
        assert not np.delete(g, rows, axis=0).any()
        for row in rows[:6].tolist():
            for k in (0, table_.shape[1] - 1):
                old, step = table_[row, k], 1e-2
                table_[row, k] = old + step
                up = loss()
                table_[row, k] = old - step
                down = loss()
                table_[row, k] = old
                assert abs((up - down) / (2 * step) - g[row, k]) < 2e-2 * (1 + abs(g[row, k])), name


def test_every_window_is_scored():
    for n in (0, 1, 23, 24, 25, 42, 43, 500):
        at, text = toxicity.windows(plain_words(n, n + 3))
        assert at[text == 0][:, 0].tolist() == ([-1] if n == 0 else list(range(max(1, n - 23))))


def test_sliding_scores_are_those_of_the_network():
    data, offsets = text_bytes(pa.array([*planted(40)[0], "", "one", " ".join(f"w{i % 7}" for i in range(5000))]))
    words, model = toxicity.read_words(data, offsets), toxicity.Network(3)
    model.p["word"] *= 50
    model.p["char"] *= 50
    at, text = toxicity.windows(words)
    logits, of = toxicity.all_logits(model, words)
    assert (of == text).all()
    assert np.allclose(logits, model.forward(model.inputs(words), at)[0], atol=1e-4)


def test_sliding_scores_of_saturated_gates():
    """Where exp() overflows: gates that are fully open or shut."""
    data, offsets = text_bytes(pa.array([" ".join(f"w{i % 7}" for i in range(100)), " ".join(f"v{i % 11}" for i in range(30))]))
    words, model = toxicity.read_words(data, offsets), toxicity.Network(3)
    model.p["word"] *= 1e5
    at, _ = toxicity.windows(words)
    logits, _ = toxicity.all_logits(model, words)
    assert np.isfinite(logits).all()
    assert np.allclose(logits, model.forward(model.inputs(words), at)[0], atol=1e-3)


def test_sliding_takes_a_first_word_once(monkeypatch):
    """What a window costs: the state after its first word is that of the distinct word, and only candidates need a reciprocal."""
    data, offsets = text_bytes(pa.array([" ".join(f"w{i % 7}" for i in range(1000))]))
    words, model, h = toxicity.read_words(data, offsets), toxicity.Network(3), toxicity.HIDDEN
    sizes = {"exp": 0, "reciprocal": 0}
    for name in sizes:

        def counted(x, *args, name=name, own=getattr(np, name), **named):
            sizes[name] += np.size(x)
            return own(x, *args, **named)

        monkeypatch.setattr(np, name, counted)
    n, steps, distinct = len(toxicity.all_logits(model, words)[0]), toxicity.WINDOW - 1, len(words.bucket)
    assert sizes["exp"] <= n * (steps * 2 * 3 * h + toxicity.WINDOW) + distinct * 2 * 2 * h
    assert sizes["reciprocal"] <= n * steps * 2 * h


def test_score_does_not_hang_on_the_words_before():
    """A long passage's own windows are all scored, wherever it begins, so a text scores no less than its passage."""
    rng = np.random.default_rng(0)
    model = toxicity.Network(3)
    model.p["word"] *= 50
    model.p["char"] *= 50
    passage = " ".join(f"w{x}" for x in rng.integers(0, 500, 24))
    texts = [passage, *(" ".join([*(f"v{x}" for x in rng.integers(0, 500, n)), passage, *(f"v{x}" for x in rng.integers(0, 500, 40))]) for n in range(40))]
    scores = toxicity.Scorer(model)(pa.array(texts))
    assert (scores[1:] >= scores[0] - 1e-5).all()


def test_windows_cover_all_words():
    for n in (0, 1, 23, 24, 25, 42, 43, 500):
        at, text = toxicity.windows(plain_words(n, n + 3))
        assert set(at[text == 0][at[text == 0] >= 0]) == set(range(n))
        assert (text == 1).sum() == 1
        assert (text == 0).sum() >= 1


def bag(text):
    """Buckets of a text's words with their shares, read apart from features()."""
    words = text.lower().split()
    f = lambda w: int(quality.features(*text_bytes(pa.array([w]))).words[0])
    return {f(w): words.count(w) / len(words) for w in set(words)}


def test_sum_of_squares_identity():
    """The score against the sum over all pairs of distinct inputs, words that occur often among them."""
    texts = ["a b c b", "", "d !! d\nd", "a", "a a a a"]
    f = quality.features(*text_bytes(pa.array(texts)))
    rng = np.random.default_rng(0)
    m = quality.fit(f, np.array([1, 0, 1, 0, 1]), epochs=1)
    m.word_v[:], m.stat_v[:] = rng.normal(size=m.word_v.shape), rng.normal(size=m.stat_v.shape)
    x = np.clip((f.stats - m.mean) / m.scale, -quality.REACH, quality.REACH)
    for i, got in enumerate(m.logits(f)):
        own = bag(texts[i])
        inputs = [(m.stat_w[k], m.stat_v[k], x[i, k]) for k in range(len(m.stat_w))] + [(m.word_w[b], m.word_v[b], n) for b, n in own.items()]
        linear = m.bias + sum(w * y for w, _, y in inputs)
        pairs = sum(inputs[a][1] @ inputs[b][1] * inputs[a][2] * inputs[b][2] for a in range(len(inputs)) for b in range(a))
        assert abs(got - linear - pairs) < 1e-3 * (1 + abs(got))


def test_repetition_does_not_interact_with_itself():
    f = quality.features(*text_bytes(pa.array(["a a a a", "a"])))
    m = quality.fit(f, np.array([1, 1]))
    m.word_v[:] = 1
    assert np.allclose(m.logits(f), m.bias)


def test_quality_gradients():
    f = quality.features(*text_bytes(pa.array(["a b c b", "", "d !! d\nd", "b a"])))
    labels, rng = np.array([1, 0, 1, 0]), np.random.default_rng(1)
    m = quality.fit(f, labels, epochs=1)
    m.word_v, m.stat_v, m.word_w = rng.normal(size=m.word_v.shape), rng.normal(size=m.stat_v.shape) * 0.1, rng.normal(size=m.word_w.shape)

    def loss():
        p = quality.sigmoid(m.logits(f))
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    grads, used, _ = quality.gradients(m, f, labels)
    for name, rows in (("stat_w", range(0, quality.N_STATS, 7)), ("stat_v", range(0, quality.N_STATS, 7)), ("word_w", range(len(used))), ("word_v", range(len(used)))):
        for row in rows:
            values, at = getattr(m, name), used[row] if name.startswith("word") else row
            where = (at, 2) if values.ndim == 2 else (at,)
            old, step = values[where], 1e-4
            values[where] = old + step
            up = loss()
            values[where] = old - step
            down = loss()
            values[where] = old
            assert abs((up - down) / (2 * step) - (grads[name][row, 2] if values.ndim == 2 else grads[name][row])) < 1e-4, name


def test_training_texts_are_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    every = training_texts(docs, labels, "quality", 1000)
    assert every.count() == sum(not held_out(i) for i in range(50))
    assert training_texts(docs, labels, "quality", 1000, max_bytes=550).count() == 5
    assert training_texts(docs, labels, "quality", 7).count() == 7


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1), (5, 0, 0), (7, 1, 1), (8, 0, None), (None, 1, 1), (9, 3, 0)], "doc_id long, quality int, toxic int")
    docs = edge_docs(spark)
    for scored, empty in (
        (quality.score_quality(docs, quality.train_quality(docs, labels)), quality.score_quality(no_docs(spark), quality.train_quality(no_docs(spark), labels))),
        (toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)), toxicity.score_toxicity(no_docs(spark), toxicity.train_toxicity(no_docs(spark), labels))),
    ):
        rows = scored.collect()
        assert len(rows) == len(EDGE_TEXTS)
        assert all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (2, 1)}) == 1
        assert empty.count() == 0
    model = toxicity.train_toxicity(docs, labels.where("false"))
    kept = docs.where(toxicity.toxicity_of(F.col("text"), model) <= 1)
    assert kept.columns == docs.columns
    assert kept.count() == len(EDGE_TEXTS)
