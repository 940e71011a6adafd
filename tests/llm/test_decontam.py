import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.llm.decontam import MIN_WORDS, Matcher, contains_item, contaminated, edit_distances, edits, recall_of
from corpusmill.llm.queries import op5_decontamination
from tests.llm.tables import EDGE_TEXTS, docs_of, edge_docs, no_docs, table
from tests.llm.test_license import words_of


def least_distance(item, words):
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def brute_force(docs, items):
    """All pairs whose edit distance is small enough; pairs that share too few words need no look."""
    out = set()
    for i, text in docs:
        words = words_of(text)
        for name, item in items:
            own = words_of(item)
            if 0 < len(own) < MIN_WORDS and any(words[a : a + len(own)] == own for a in range(len(words))):
                out.add((i, name, 0))
            if len(own) >= MIN_WORDS and len(set(own) & set(words)) >= len(set(own)) - edits(len(own)):
                d = least_distance(own, words)
                if d <= edits(len(own)):
                    out.add((i, name, d))
    return out


def test_query_equals_brute_force(spark, sf_dir):
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in op5_decontamination(spark, sf_dir).collect()}
    want = brute_force([tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()], [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()])
    assert got == want
    assert got


def test_planted_edits(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"v{x}" for x in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary, int(rng.integers(8, 60))))) for k in range(40)]
    docs = []
    for _ in range(300):
        own = items[int(rng.integers(len(items)))][1].split()
        for _ in range(int(rng.integers(0, edits(len(own)) + 3))):
            at, kind = int(rng.integers(len(own))), rng.integers(3)
            if kind == 0:
                own[at] = str(rng.choice(vocabulary))
            elif kind == 1:
                own.insert(at, str(rng.choice(vocabulary)))
            else:
                del own[at]
        host = list(rng.choice(vocabulary, int(rng.integers(0, 150))))
        at = int(rng.integers(len(host) + 1))
        docs.append(" ".join([*host[:at], *own, *host[at:]]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs_of(spark, docs), bench).collect()}
    want = {(i, k) for i, k, _ in brute_force(list(enumerate(docs)), items)}
    assert got <= want
    assert len(got) >= 0.99 * len(want) > 100


def front_damaged(n_docs=400, seed=4):
    """Items, and texts with a passage whose first words are left out or replaced, as many as edits allow."""
    rng = np.random.default_rng(seed)
    fresh = lambda n: [f"f{x}" for x in rng.integers(0, 1 << 40, n)]
    items = [(k, " ".join(f"i{x}" for x in rng.integers(0, 1 << 40, int(rng.integers(8, 200))))) for k in range(n_docs)]
    docs = []
    for k in range(n_docs):
        own = items[k][1].split()
        gone = edits(len(own))
        docs.append(" ".join([*fresh(int(rng.integers(0, 100))), *(fresh(gone) if k % 2 else []), *own[gone:], *fresh(int(rng.integers(0, 100)))]))
    return items, docs


def test_passages_without_their_first_words():
    items, docs = front_damaged()
    got = {row[:3] for row in Matcher(items).find(pa.array(docs))}
    want = brute_force(list(enumerate(docs)), items)
    assert got <= want
    assert len(want) == len(docs)
    assert len(got) >= 0.995 * len(want)


def test_recall_of_front_damage():
    for n in (10, 34, 100):
        assert recall_of(0.2, n, 200, front="clipped") >= 0.98
        assert recall_of(0.2, n, 200, front="edited") >= 0.98


def test_recall_of_the_hashes():
    assert recall_of(0.2) >= 0.98
    assert recall_of(0.05) == 1


def test_edit_distances():
    rng = np.random.default_rng(1)
    items, contexts = rng.integers(0, 6, (50, 7)).astype(np.uint64), rng.integers(0, 6, (50, 15)).astype(np.uint64)
    assert edit_distances(items, contexts).tolist() == [least_distance(a, b) for a, b in zip(items.tolist(), contexts.tolist(), strict=True)]


def test_edges(spark):
    bench = spark.createDataFrame([(1, "é 😀 ß " * 10), (2, None), (None, "one two three four five six seven eight nine"), (3, ""), (4, "one"), (1, "é 😀 ß " * 10), (5, "word1 of word4 of word9 of word16 of word25 of")], "item_id long, text string")
    rows = contaminated(edge_docs(spark), bench).collect()
    assert {r["doc_id"] for r in rows} == {4, 5, 6, 7}
    assert len(rows) == 5
    assert contaminated(no_docs(spark), bench).count() == contaminated(edge_docs(spark), bench.where("false")).count() == 0
    kept = edge_docs(spark).where(~contains_item(F.col("text"), bench))
    assert kept.columns == edge_docs(spark).columns
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(map(repr, (i for i, _ in EDGE_TEXTS if i not in (5, 6, 7))))


def test_short_items():
    items = [(1, "The Capital, of France?"), (2, "is"), (3, "..."), (4, "法國的首都"), (5, "a b c d e f g"), (2, "capital of")]
    docs = ["what is the  capital of-france", "this", None, "", "問：法國的首都是什麼", "A b. C d e f g h", "b c d e f g", "a b c d e f gg", "the capital of france is the capital of france"]
    got = {row[:3] for row in Matcher(items).find(pa.array(docs))}
    assert got == {(0, 1, 0), (0, 2, 0), (4, 4, 0), (5, 5, 0), (8, 1, 0), (8, 2, 0)}
    plain = [x for x in items if x[0] not in (3, 4)]
    assert got - {(4, 4, 0)} == brute_force([(i, d) for i, d in enumerate(docs) if d], plain)
    assert [row[4] for row in Matcher(items).find(pa.array(docs)) if row[:2] == (0, 1)] == [2]
    assert {row[:3] for row in Matcher(items, short_chars=20).find(pa.array(docs))} == {(0, 1, 0), (8, 1, 0)}
