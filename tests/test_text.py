"""Hand-checked cases of cleaning, pre-tokenization, selection and names."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.text import clean_text, last_answer, nfc, parent_name, pretokens, prompt, replace_names, stem, word_count
from corpusmill.operators.counts import sample_names, select_docs


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("raw", "clean"), [
    ("Hello  world!", "Hello world!"), ("a\x0bb\x1cc", "abc"), ("x\r\ny\tz", "x y z"), ("p\xa0q r\x85s", "p q r s"),
    ("  lead trail \n", "lead trail"), ("\x00\x07", ""), ("a b", "a b"),
])
def test_clean(spark, raw, clean):
    assert one(spark, raw, clean_text) == clean


@pytest.mark.parametrize(("text", "words"), [
    ("Hello, world 42!", ["Hello", ",", " world", " 42", "!"]), ("don't", ["don", "'", "t"]), ("नमस्ते! आप", ["नमस्ते", "!", " आप"]),
    ("a  b ", ["a", " ", " b", " "]), ("1़ a", ["1", " a"]), ("x٣٤", ["x", "٣٤"]), ("", []),
])
def test_pretokens(spark, text, words):
    assert one(spark, text, pretokens) == words


def test_small_functions(spark):
    assert one(spark, "é", nfc) == "é"
    assert one(spark, "plain", nfc) == "plain"
    assert one(spark, None, nfc) is None
    assert one(spark, "a b  c", lambda c: word_count(clean_text(c))) == 3
    assert one(spark, "", word_count) == 0
    assert one(spark, "/x/y/part-1.snappy.parquet", stem) == "part-1"
    assert one(spark, "/x/y/part-1.parquet", parent_name) == "y"
    assert one(spark, "<user>q<assistant>a<user>r<assistant>b", last_answer) == "b"
    assert one(spark, "q", prompt) == "<user>q<assistant>"


def test_names(spark):
    names = ["Ann", "Bo", "Cy", "Di", "Ed"]
    done = one(spark, "NAME_1 met NAME_10 and NAME_1", lambda c: replace_names(c, F.lit(7), names))
    first, second = done.split(" met ")[0], done.split(" met ")[1].split(" and ")[0]
    assert done == f"{first} met {second} and {first}"
    assert {first, second} <= set(names)
    assert one(spark, "no mark", lambda c: replace_names(c, F.lit(7), names)) == "no mark"


def test_selection(spark):
    rows = [(1, "x" * 99, "en", 0.9), (2, "x" * 100, "en", 0.85), (3, "x" * 100, "en", 0.86), (4, None, "en", 0.9), (5, "x" * 100, "en", None), (6, "y" * 100, "hi", None), (7, " " * 100, "hi", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, language_score double")
    kept = lambda use: sorted(r["doc_id"] for r in select_docs(docs, ("en", "hi"), scored=("en",), use=use).collect())
    assert kept("corpus") == [3, 6, 7]
    assert kept("tokenizer") == [2, 3, 6, 7]
    with pytest.raises(Exception, match="unknown language"):
        select_docs(docs, ("en",)).collect()


def test_samples(spark):
    df = spark.createDataFrame([(x,) for x in "abcabc"], "s string")
    assert len({r["s"] for r in sample_names(df, "s", 2).collect()}) == 2
    with pytest.raises(Exception, match="4 asked for"):
        sample_names(df, "s", 4).collect()
