"""Training by rounds and by a heap, encoding by fold, by merging and in Arrow batches, special tokens."""

import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions.text import MAYBE_COMPOSED, nfc, pretokens
from corpusmill.operators import bpe
from corpusmill.operators.counts import word_counts
from corpusmill.plans.queries import QUERIES, VOCAB_SIZE, _docs

CORPUS = [("low", 5), ("lower", 2), ("newest", 6), ("widest", 3)]
MERGES = [(101, 115, 9), (256, 116, 9), (108, 111, 7), (258, 119, 7), (101, 119, 6), (110, 260, 6), (261, 257, 6), (100, 257, 3)]


def of(model):
    return [(m.left, m.right, m.n) for m in model.merges]


def test_golden_merges(spark):
    words = spark.createDataFrame(CORPUS, "word string, n long")
    assert of(bpe.train_heap(CORPUS, 264)) == MERGES
    assert of(bpe.train_rounds(words, 264)) == MERGES
    assert of(bpe.train(words, 264)) == MERGES
    assert of(bpe.train(words, 264, driver_types=1)) == MERGES
    model = bpe.train_heap(CORPUS, 264)
    assert [model.merge_word(list(w.encode())) for w, _ in CORPUS] == [[259], [259, 101, 114], [262], [119, 105, 263]]


def test_overlaps_and_exhaustion():
    assert of(bpe.train_heap([("aaaa", 1), ("aaa", 2)], 300)) == [(97, 97, 7), (256, 97, 2), (256, 256, 1)]
    with pytest.raises(ValueError, match="256"):
        bpe.train_heap([], 255)


def test_rounds_equal_heap_on_documents(spark, sf_dir):
    words = word_counts(_docs(spark, sf_dir), F.col("clean"))
    assert of(bpe.train_rounds(words, 262)) == of(bpe.train_heap([tuple(r) for r in words.collect()], 262))


def brute_force(counts, size):
    words, merges = [(list(w.encode()), n) for w, n in counts], []
    while len(merges) < size - 256:
        pairs = Counter()
        for ids, n in words:
            for p in zip(ids, ids[1:], strict=False):
                pairs[p] += n
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        merges.append((*best, pairs[best]))
        words = [(bpe._replace(ids, best, 255 + len(merges)), n) for ids, n in words]
    return merges


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcé", min_size=1, max_size=7), st.integers(1, 9), max_size=12))
def test_heap_equals_brute_force(counts):
    assert of(bpe.train_heap(list(counts.items()), 276)) == brute_force(list(counts.items()), 276)


@settings(max_examples=1500, deadline=None)
@given(st.dictionaries(st.text("abcd", min_size=1, max_size=9), st.integers(1, 4), max_size=14))
@example({"aa": 1, "bbbbbb": 1})
def test_independent_pairs_merge_as_one_by_one(counts):
    """The plan of train_rounds() on lists: several merges a round, many ties."""
    words, merges = [(list(w.encode()), n) for w, n in counts.items()], []
    while len(merges) < 20:
        pairs = Counter()
        for ids, n in words:
            for p in zip(ids, ids[1:], strict=False):
                pairs[p] += n
        best = sorted(pairs, key=lambda p: (-pairs[p], p))
        if not best:
            break
        for p in best[: min(bpe.independent(best), 20 - len(merges))]:
            merges.append((*p, pairs[p]))
            words = [(bpe._replace(ids, p, 255 + len(merges)), n) for ids, n in words]
    assert merges == brute_force(list(counts.items()), 276)


def test_rounds_with_checkpoints(spark, sf_dir):
    words = word_counts(_docs(spark, sf_dir).where("lang = 'fr'"), F.col("clean"))
    assert of(bpe.train_rounds(words, 320, checkpoint_every=2)) == of(bpe.train_heap([tuple(r) for r in words.collect()], 320))


def test_training_composes(spark):
    texts = ["été à l'ecole", "e\u0301te\u0301 a\u0300 l'e\u0301cole été", "\u1112\u1161\u11ab 한 \u212b"] * 3
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    counted = {r["word"]: r["n"] for r in word_counts(df, nfc(F.col("t"))).collect()}
    want = Counter(w for t in texts for w in unicodedata.normalize("NFC", t).replace(" ", "\0 ").split("\0") for w in re.findall(r" ?\w+|'", w))
    assert counted == want
    model = bpe.train(word_counts(df, nfc(F.col("t"))), 262)
    both = spark.createDataFrame([("été",), ("e\u0301te\u0301",)], "t string").select(bpe.encode(F.col("t"), model).alias("ids")).collect()
    assert both[0]["ids"] == both[1]["ids"]
    assert len(both[0]["ids"]) < 5


def test_other_texts_are_composed():
    plain = [chr(c) for c in range(0x10FFFF + 1) if not re.search(MAYBE_COMPOSED.replace(r"\x{0}", "\\x00").replace(r"\x{2ff}", "\u02ff").replace(r"\x{2002}", "\u2002").replace(r"\x{20cf}", "\u20cf"), chr(c))]
    assert len(plain) == 0x300 + 0xCE
    assert all(unicodedata.is_normalized("NFC", a) and unicodedata.combining(a) == 0 for a in plain)
    # None of them joins to one before it.
    assert all(unicodedata.is_normalized("NFC", a + b) for a in "aeoAKé \u0627\u1100" for b in plain)


def test_full_vocabulary(spark, sf_dir):
    """The queries of production size against counting all pairs anew for each merge, and against encoding word by word."""
    words = {r["word"]: r["n"] for r in word_counts(_docs(spark, sf_dir), F.col("clean")).collect()}
    merges = [(r["left"], r["right"], r["n"]) for r in QUERIES["bpe_full_merges"](spark, sf_dir).orderBy("rank").collect()]
    assert len(merges) == VOCAB_SIZE - 256
    assert merges[:150] == brute_force(list(words.items()), 406)
    ranks = {p[:2]: k for k, p in enumerate(merges)}

    def n_ids(word):
        ids = list(word.encode())
        while len(ids) > 1 and (best := min(zip(ids, ids[1:], strict=False), key=lambda p: ranks.get(p, 1 << 40))) in ranks:
            ids = bpe._replace(ids, best, 256 + ranks[best])
        return len(ids)

    known, ratios = {}, defaultdict(list)
    for r in _docs(spark, sf_dir).select("lang", "clean", pretokens(F.col("clean")).alias("w")).collect():
        n = sum(known[w] if w in known else known.setdefault(w, n_ids(w)) for w in r["w"])
        if r["clean"]:
            ratios[r["lang"]].append(n / len(r["clean"].split(" ")))
    for r in QUERIES["bpe_full_tokens_per_word"](spark, sf_dir).collect():
        assert r["n_docs"] == len(ratios[r["lang"]])
        assert abs(r["avg_tokens_per_word"] - sum(ratios[r["lang"]]) / r["n_docs"]) < 1e-9


def test_encoding_ways_agree(spark, sf_dir):
    words = word_counts(_docs(spark, sf_dir), F.col("clean"))
    model = bpe.train(words, 256 + 40)
    rows = words.select("word", bpe.encode_word(F.col("word"), model).alias("fold"), bpe.encode(F.col("word"), model).alias("batch")).limit(3000).collect()
    for r in rows:
        assert r["fold"] == r["batch"] == model.merge_word(list(r["word"].encode()))


def test_specials(spark, tmp_path):
    model = bpe.train_heap(CORPUS, 264).with_specials(bpe.BASE_SPECIALS).with_specials(("<eos>", *bpe.CHAT_SPECIALS))
    assert model.specials == {t: 264 + i for i, t in enumerate((*bpe.BASE_SPECIALS, *bpe.CHAT_SPECIALS))}
    assert model.size == 271
    df = spark.createDataFrame([("<user>low<assistant>newest<eos>",), ("",), (None,), ("a<b",)], "t string")
    on, off = (df.select(bpe.encode(F.col("t"), model, allow_special=x).alias("ids")).collect() for x in (True, False))
    assert [r["ids"] for r in on] == [[269, 259, 270, 262, 264], [], None, [97, 60, 98]]
    assert 269 not in off[0]["ids"]
    ids = spark.createDataFrame([([269, 259, 270],), ([0xC3],), ([],), (None,)], "ids array<int>")
    assert [r["t"] for r in ids.select(bpe.decode(F.col("ids"), model).alias("t")).collect()] == ["<user>low<assistant>", "�", "", None]
    model.save(spark, str(tmp_path / "m"))
    again = bpe.BpeModel.load(spark, str(tmp_path / "m"))
    assert (again.merges, again.specials, again.vocab) == (model.merges, model.specials, model.vocab)
    assert bpe.BpeModel().special_pattern is None


def test_round_trip_of_unusual_text(spark):
    texts = ["नमस्ते दुनिया", "emoji 😀 ok", "tabs\tand\nlines", "1़ a"]
    model = bpe.train_heap(CORPUS, 264)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    back = [r["d"] for r in df.select(bpe.decode(bpe.encode(F.col("t"), model), model).alias("d")).collect()]
    assert back[:3] == texts[:3]
    assert back[3] == "1 a"
