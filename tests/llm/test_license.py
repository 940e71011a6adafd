import re

from corpusmill.llm.license_scan import BASE_PHRASES, rules, scan_licenses
from corpusmill.llm.queries import op1_license_scan
from tests.llm.tables import EDGE_TEXTS, docs_of, edge_docs, no_docs, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(text):
    """All detections of all rules by trying every rule at every word, then suppression pair by pair."""
    words, places, labels = words_of(text), [], set()
    for phrase, label in BASE_PHRASES:
        parts = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    found = []
    for number, (label, priority, confidence, keyword, pattern) in enumerate(rules()):
        full = re.compile(f"(?:{pattern})(?= |$)")
        for i, w in enumerate(words):
            if w == keyword and (m := full.match(" ".join(words[i : i + 28]))):
                found.append((i, i + m[0].count(" ") + 1, priority, number, label, confidence))
    kept = []
    for x in found:
        others = [y for y in found if y != x and y[0] <= x[0] and y[1] >= x[1] and y[2] <= x[2]]
        if not any((y[0], -y[1], y[2], y[3]) < (x[0], -x[1], x[2], x[3]) for y in others):
            kept.append(x)
    score = max([x[5] for x in kept] + [0.6] * bool(places) + [0.0])
    every = ",".join(sorted(labels | {x[4] for x in kept}))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), every, score, len(kept)


def fields(r):
    return tuple(r[n] for n in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections"))


def test_query_equals_brute_force(spark, sf_dir):
    got = {r["doc_id"]: fields(r) for r in op1_license_scan(spark, sf_dir).collect()}
    for r in table(spark, sf_dir, "documents").collect():
        assert got[r["doc_id"]] == brute_force(r["text"])


def test_rules_and_suppression(spark):
    texts = [
        "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the Apache License, Version 2.0 (the License)", "the MIT License and the mit license, MIT LICENSE",
        "GNU General Public License version 2 or any later version. GNU Lesser General Public License", "Creative Commons Attribution 4.0 International; CC-BY-SA-4.0",
        "General public\nlicense", "smit license mit licenses", "Permission is hereby granted, free of charge, to any person obtaining a copy", "bsd 3-clause new license", "all rights reserved", "mit " * 50 + "license " * 50,
    ]
    got = {r["doc_id"]: fields(r) for r in scan_licenses(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [brute_force(t) for t in texts]
    assert got[0][5] == "gpl-3.0-or-later"
    assert got[1][4:6] == ("apache", "apache,apache-2.0")
    assert got[2][1:4] == (3, 1, 7)
    assert len(rules()) > 200


def test_no_python_and_no_shuffle(spark, sf_dir):
    plan = op1_license_scan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Arrow" not in plan


def test_edges(spark):
    rows = scan_licenses(edge_docs(spark)).collect()
    assert sorted(map(repr, (fields(r) for r in rows))) == sorted(repr(brute_force(t)) for _, t in EDGE_TEXTS)
    assert scan_licenses(no_docs(spark)).count() == 0
