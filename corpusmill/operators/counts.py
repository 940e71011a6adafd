"""Selection and cleaning of documents; word and byte-pair counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.order import shuffle_key
from corpusmill.functions.text import MIN_CHARS, clean_text, long_enough, pretokens

#: Strict lower bounds of language_score by use. Fixed values.
SCORE_THRESHOLDS = {"tokenizer": 0.80, "corpus": 0.85, "evaluation": 0.0}


def select_docs(docs: DataFrame, languages: tuple[str, ...], scored: tuple[str, ...] = (), use: str = "corpus", min_chars: int = MIN_CHARS) -> DataFrame:
    """Documents long enough in raw text and, in scored languages, above the threshold of the use.

    A language outside languages is an error, raised when the row is met. Null text and null score are dropped.
    """
    known = F.col("lang").isin(*languages)
    checked = F.when(known, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown language: "), F.coalesce("lang", F.lit("null")))).cast("boolean"))
    keep = checked & long_enough(F.col("text"), min_chars)
    if scored:
        keep &= ~F.col("lang").isin(*scored) | F.coalesce(F.col("language_score") > SCORE_THRESHOLDS[use], F.lit(False))
    return docs.where(keep)


def clean_docs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs that are long enough, with the cleaned text as clean."""
    return docs.where(long_enough(F.col("text"), min_chars)).withColumn("clean", clean_text(F.col("text")))


def sample_names(names: DataFrame, column: str, n: int, seed: int = 42) -> DataFrame:
    """n distinct values of the column, without replacement, the first by a seeded order; an error if there are fewer."""
    ranked = names.select(column).distinct().orderBy(shuffle_key(F.col(column), seed), column).limit(n)
    count = F.count("*")
    enough = names.select(column).distinct().agg(F.when(count < n, F.raise_error(F.concat(F.lit(f"{n} asked for, there are "), count.cast("string"))).cast("long")).otherwise(count).alias("enough"))
    return ranked.crossJoin(F.broadcast(enough)).where("enough >= 0").select(column)  # one row on the right


def word_counts(docs: DataFrame, text: Column) -> DataFrame:
    """word and n over all pre-tokens; summed up on the map side before the shuffle."""
    return docs.select(F.explode(pretokens(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def word_bytes(word: Column) -> Column:
    """The UTF-8 bytes of a word as numbers: read as Latin-1, each byte is one character, and its code is the byte."""
    letters = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
    return F.when(word == "", F.array().cast("array<int>")).otherwise(F.transform(letters, lambda c: F.ascii(c)))


def pair_counts(words: DataFrame, ids: Column) -> DataFrame:
    """left, right and n: adjacent ids of all words, each weighted by the word's n; overlapping pairs all count."""
    sized = words.select("n", ids.alias("ids")).where(F.size("ids") > 1)
    left, right = F.slice("ids", F.lit(1), F.size("ids") - 1), F.slice("ids", F.lit(2), F.size("ids") - 1)
    pairs = sized.select("n", F.explode(F.arrays_zip(left.alias("left"), right.alias("right"))).alias("pair"))
    return pairs.groupBy("pair.left", "pair.right").agg(F.sum("n").alias("n"))


def best_pair(pairs: DataFrame) -> DataFrame:
    """The most frequent pair; ties go to the smaller left, then the smaller right id."""
    return pairs.orderBy(F.desc("n"), "left", "right").limit(1)


def pair_words(words: DataFrame, ids: Column) -> DataFrame:
    """left, right and word: the inverted index from pairs to the words that hold them, one row for each."""
    sized = words.select("word", ids.alias("ids")).where(F.size("ids") > 1)
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("ids") - 2), lambda i: F.struct(F.get("ids", i).alias("left"), F.get("ids", i + 1).alias("right"))))
    return sized.select("word", F.explode(pairs).alias("pair")).select("pair.left", "pair.right", "word")
