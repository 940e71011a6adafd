"""License scan: ordered signature rules with a keyword gate, priorities and suppression of contained detections.

Everything here is a Column expression; no row leaves the JVM and nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import ascii_lower, let
from corpusmill.llm.license_rules import RULES

#: phrase, label. Fixed values.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Words that a rule's match may span at most.
WINDOW = 28
PRIORITIES = 4
BASE_CONFIDENCE = 0.6


def rules() -> list[tuple[str, int, float, str, str]]:
    """label, priority, confidence, keyword and regular expression of each rule, in their order."""
    out = []
    for line in RULES.splitlines():
        label, priority, confidence, pattern = line.split(" ", 3)
        out.append((label, int(priority), float(confidence), re.match(r"[a-z0-9]+(?= |$)", pattern)[0], pattern))
    return out


def _rule_array() -> Column:
    return F.array(
        *(
            F.struct(F.lit(keyword).alias("keyword"), F.lit(f"^(?:{pattern})(?= |$)").alias("pattern"), F.lit(priority).alias("priority"), F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))
            for i, (label, priority, confidence, keyword, pattern) in enumerate(rules())
        )
    )


def normalized(text: Column) -> Column:
    """The text's words in lower case, joined by single spaces."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _base(words: Column) -> Column:
    """start and label of each place of a base phrase."""
    n = F.size(words)

    def at(i: Column) -> Column:
        cases = F.lit(None).cast("struct<start:int,label:string>")
        for phrase, label in BASE_PHRASES:
            parts = phrase.split(" ")
            fits = F.lit(True)
            for back, part in enumerate(reversed(parts[:-1]), 1):
                fits &= F.coalesce(F.get(words, i - back) == part, F.lit(False))
            cases = F.when(fits, F.struct((i - (len(parts) - 1)).cast("int").alias("start"), F.lit(label).alias("label"))).otherwise(cases)
        return cases

    ends = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, i) == "license")
    return F.filter(F.transform(ends, at), lambda x: x.isNotNull())


def _detections(words: Column, keyword_pattern: str) -> Column:
    """All matches of all rules, ordered so that what may contain a detection stands before it."""
    found = "struct<start:int,back:int,priority:int,rule:int,label:string,confidence:double>"
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).rlike(keyword_pattern))

    def at(i: Column) -> Column:
        def matches(window: Column) -> Column:
            def match(rule: Column) -> Column:
                text = F.call_function("regexp_extract", window, rule["pattern"], F.lit(0))
                count = F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1
                return F.when(text != "", F.struct(i.cast("int").alias("start"), (-(i + count)).cast("int").alias("back"), rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["confidence"].alias("confidence")))

            return F.filter(F.transform(F.filter(_rule_array(), lambda r: r["keyword"] == F.get(words, i)), match), lambda x: x.isNotNull())

        return let(F.concat_ws(" ", F.slice(words, i + 1, F.lit(WINDOW))), matches)

    return F.array_sort(F.flatten(F.transform(starts, at)).cast(f"array<{found}>"))


def _kept(detections: Column) -> Column:
    """Labels, best confidence and number of the detections that no other of the same or a stronger priority contains."""
    zero = F.struct(*(F.lit(0).alias(f"end{p}") for p in range(1, PRIORITIES + 1)), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("best"), F.lit(0).alias("count"))

    def step(acc: Column, x: Column) -> Column:
        end = -x["back"]
        covered = F.lit(False)
        for p in range(1, PRIORITIES + 1):
            covered |= (x["priority"] >= p) & (acc[f"end{p}"] >= end)
        ends = [F.when(x["priority"] == p, F.greatest(acc[f"end{p}"], end)).otherwise(acc[f"end{p}"]).alias(f"end{p}") for p in range(1, PRIORITIES + 1)]
        return F.struct(*ends, F.when(covered, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(x["label"]))).alias("labels"), F.when(covered, acc["best"]).otherwise(F.greatest(acc["best"], x["confidence"])).alias("best"), F.when(covered, acc["count"]).otherwise(acc["count"] + 1).alias("count"))

    return F.aggregate(detections, zero, step)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections.

    A base place is a run of words that is one of BASE_PHRASES. A rule is tried only where its keyword stands, within WINDOW
    words, and only in documents that hold any keyword. A detection falls if one of the same or a stronger priority contains
    it (of equal ones the first rule stays). score is the best confidence left, 0 without any detection.

    Null and empty texts have no words and score 0; repeated rows and null ids each give their own row; other columns of docs
    are not read; an empty table gives no rows.
    """
    words_of_rules = sorted({x[3] for x in rules()})
    gate = r"(?:^| )(?:" + "|".join(words_of_rules) + r")(?: |$)"
    keyword = "^(?:" + "|".join(words_of_rules) + ")$"
    nothing = F.lit(None).cast("array<struct<start:int,label:string>>")
    norm = F.col("norm")
    base = F.col("base")
    starts = F.transform(base, lambda x: x["start"])
    base_labels = F.array_sort(F.array_distinct(F.transform(base, lambda x: x["label"])))
    none = F.array().cast("array<string>")
    scanned = (
        docs.select(F.col(id_col).alias("id"), normalized(F.col(text_col)).alias("norm"))
        .select("id", F.when(norm == "", 0).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "))) + 1).cast("long").alias("n_words"), F.when(norm.rlike(gate), F.split(norm, " ")).alias("words"))
        .select(
            "id",
            "n_words",
            F.when(F.col("words").isNotNull(), let(F.col("words"), _base)).otherwise(nothing).alias("base"),
            F.when(F.col("words").isNotNull(), let(F.col("words"), lambda w: _kept(_detections(w, keyword)))).alias("kept"),
        )
    )
    labels = F.array_sort(F.array_union(F.coalesce(base_labels, none), F.coalesce(F.col("kept.labels"), none)))
    return scanned.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(base.isNull(), 0).otherwise(F.size(base)).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.coalesce(F.array_join(base_labels, ","), F.lit("")).alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce(F.col("kept.best"), F.lit(0.0)), F.when(F.size(base) > 0, BASE_CONFIDENCE).otherwise(0.0)).alias("score"),
        F.coalesce(F.col("kept.count"), F.lit(0)).alias("n_detections"),
    )
