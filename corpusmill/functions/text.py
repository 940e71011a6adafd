"""Cleaning, pre-tokenization and small string functions, as Columns."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# What cleaning deletes, and the alternatives of the pre-tokenizer in their order.
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
PRETOKEN = r"[ ]?\p{L}[\p{L}\p{M}]*|[ ]?\d+|[ ]?[^\s\p{L}\p{M}\d]+|\s+(?!\S)|\s+"
NAME_MARK = r"NAME_\d+"

#: Composition changes no text of Latin letters up to U+02FF and punctuation from U+2002 to U+20CF.
MAYBE_COMPOSED = r"[^\x{0}-\x{2ff}\x{2002}-\x{20cf}]"

MIN_CHARS = 100


def clean_text(text: Column) -> Column:
    """Control characters go first, then each run of Unicode white space becomes one space, then the ends are stripped."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, CONTROL_CHARS, ""), r"(?U)\s+", " "))


def pretokens(text: Column) -> Column:
    """All matches of the pre-tokenizer, in order. What no alternative matches, such as a mark without a letter, is lost."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PRETOKEN), F.lit(0))


def nfc(text: Column) -> Column:
    """Canonical composition. Only texts that it may change are handed to Python."""

    @F.arrow_udf("string")
    def composed(texts: pa.Array) -> pa.Array:
        return pa.array((None if x is None else unicodedata.normalize("NFC", x) for x in (t.as_py() for t in texts)), pa.string(), size=len(texts))

    return F.coalesce(composed(F.when(text.rlike(MAYBE_COMPOSED), text)), text)


def long_enough(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """On the raw text, in code points; null is not long enough."""
    return F.coalesce(F.length(text) >= min_chars, F.lit(False))


def word_count(text: Column) -> Column:
    """Words between white space of a cleaned text; 0 for the empty one."""
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), " ")))


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def stem(path: Column) -> Column:
    """The file name up to its first dot. Two folders can share one: key outputs by the whole path."""
    return F.substring_index(F.element_at(F.split(path, "/"), -1), ".", 1)


def parent_name(path: Column) -> Column:
    """The name of the folder that a file lies in."""
    return F.element_at(F.split(path, "/"), -2)


def last_answer(chat: Column) -> Column:
    return F.substring_index(chat, "<assistant>", -1)


def prompt(question: Column) -> Column:
    return F.concat(F.lit("<user>"), question, F.lit("<assistant>"))


def replace_names(text: Column, key: Column, names: list[str], seed: int = 42) -> Column:
    """Each distinct NAME_<n> of a text becomes a name of the list, the same one everywhere in the text, another for each mark.

    Names follow one another in the list from a place that md5 of seed and key picks, so that they depend on the conversation and
    are the same in every run. Marks beyond the list's length get a number behind the name. The longest marks are replaced first:
    NAME_1 is the beginning of NAME_10.
    """
    pool = F.array(*(F.lit(n) for n in names))
    marks = F.array_distinct(F.regexp_extract_all(text, F.lit(NAME_MARK), F.lit(0)))
    ordered = F.array_sort(F.transform(marks, lambda m: F.struct(F.length(m).alias("n"), m.alias("mark"))))
    first = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long")

    def named(mark: Column, k: Column) -> Column:
        name, again = F.get(pool, F.pmod(first + k, F.lit(len(names))).cast("int")), F.floor(k / len(names))
        return F.struct(mark["mark"].alias("mark"), F.when(again > 0, F.concat(name, F.lit(" "), (again + 1).cast("string"))).otherwise(name).alias("name"))

    return F.aggregate(F.reverse(F.transform(ordered, named)), text, lambda done, m: F.replace(done, m["mark"], m["name"]))
