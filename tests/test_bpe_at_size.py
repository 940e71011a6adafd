"""Training and coding of more words than one slice holds, and what reaches the driver."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import bpe
from corpusmill.plans import queries
from tests.test_bpe import CORPUS, MERGES, brute_force, of


def test_words_do_not_reach_the_driver(spark, monkeypatch):
    words = spark.createDataFrame(CORPUS, "word string, n long")
    monkeypatch.setattr(type(words), "toLocalIterator", lambda *_: pytest.fail("words on the driver"))
    assert of(bpe.train(words, 264)) == MERGES
    assert of(bpe.train(words.where("n < 0"), 264)) == []


def test_training_in_slices(monkeypatch):
    draw = random.Random(5)
    counts = Counter("".join(draw.choices("aabcé", k=draw.randint(1, 12))) for _ in range(400))
    monkeypatch.setattr(bpe, "TRAIN_WORDS", 7)
    assert of(bpe.train_heap(counts.items(), 256 + 120)) == brute_force(list(counts.items()), 256 + 120)
    big = {w: n + 2**54 for w, n in list(counts.items())[:20]}
    assert of(bpe.train_heap(big.items(), 262)) == brute_force(list(big.items()), 262)


@pytest.mark.parametrize("merges", [0, 8, 150])
def test_coding_in_slices(spark, monkeypatch, merges):
    texts = ["low lower newest", None, "", "é <user> widest 😀 low" * 9, "x", "<user><eos>", "aaaa aaaaa"]
    model = bpe.train_heap([*CORPUS, ("aaaa", 9), ("é😀", 3)], 256 + merges).with_specials(("<eos>", "<user>"))
    monkeypatch.setattr(bpe, "SLICE", 5)
    monkeypatch.setattr(bpe, "REPLACED_MERGES", 10)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    rows = df.select("i", bpe.pieces(F.col("t"), model).alias("p"), bpe.encode(F.col("t"), model).alias("ids")).withColumn("d", bpe.decode(F.col("ids"), model)).orderBy("i").collect()
    for r in rows:
        want = None if r["p"] is None else [i for w in r["p"] for i in ([model.specials[w]] if w in model.specials else model.merge_word(list(w.encode())))]
        assert r["ids"] == want
        assert r["d"] == (None if want is None else model.decode(want))
    odd = [[255, 65], [-1, 9999, 66], [None, 67]]
    assert [x["d"] for x in spark.createDataFrame([(x,) for x in odd], "ids array<int>").coalesce(1).select(bpe.decode(F.col("ids"), model).alias("d")).collect()] == ["�A", "B", "C"]


def test_encoding_queries_train_in_one_task(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(queries, "_MODELS", {})
    queries.QUERIES["bpe_vocab"](spark, sf_dir)
    queries.QUERIES["bpe_doc_tokens"](spark, sf_dir)
    assert [key[-1] for key in queries._MODELS] == [bpe.train]
