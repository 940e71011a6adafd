import re
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import near_dup, substring
from corpusmill.llm.components import connected_components
from corpusmill.llm.near_dup import keep_first, near_duplicates, super_minhash
from corpusmill.llm.queries import op7_substring_dedup, op9_near_dup
from corpusmill.llm.sql import ORACLE_SQL
from corpusmill.llm.substring import Filter, covered, locate, remove_repeats
from tests.helpers import spark_rows, sql_rows
from tests.llm.tables import EDGE_TEXTS, docs_of, edge_docs, no_docs, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_force(texts, percent):
    """n_shingles and component of each id, by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    where, common, parent = defaultdict(list), defaultdict(int), {i: i for i in texts}
    for i, s in sets.items():
        for x in s:
            for j in where[x]:
                common[j, i] += 1
            where[x].append(i)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, j), n in common.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in texts}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("name", ["op7_substring_dedup", "op9_near_dup"])
def test_query_equals_sql(spark, sf_dir, name):
    query = {"op7_substring_dedup": op7_substring_dedup, "op9_near_dup": op9_near_dup}[name]
    assert spark_rows(query(spark, sf_dir)) == sql_rows(ORACLE_SQL[name], sf_dir)


def edited_group(rng, n, words, edits, vocabulary=4000):
    """Copies of one text, each with some words replaced, taken out or put in."""
    base, out = [f"w{x}" for x in rng.integers(0, vocabulary, words)], []
    for _ in range(n):
        own = list(base)
        for _ in range(int(rng.integers(0, edits + 1))):
            at, kind = int(rng.integers(len(own))), rng.integers(3)
            if kind == 0:
                own[at] = f"x{rng.integers(10**9)}"
            elif kind == 1:
                own.insert(at, f"x{rng.integers(10**9)}")
            elif len(own) > 8:
                del own[at]
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_large_groups_at_the_limit(spark, percent):
    """Hundreds of copies whose similarities lie on both sides of the limit, a shared passage, chains of edits, exact copies."""
    rng = np.random.default_rng(percent)
    texts = edited_group(rng, 250, 120, 7)
    passage = " ".join(f"p{x}" for x in range(60))
    texts += [passage + " " + " ".join(f"q{x}" for x in rng.integers(0, 10**6, int(rng.integers(5, 40)))) for _ in range(150)]
    chain = [f"c{x}" for x in range(100)]
    for k in range(40):
        chain[k * 2] = f"d{k}"
        texts.append(" ".join(chain))
    texts += [texts[3]] * 20 + ["a b c", "A b  c", "a b", "", "a b c d e f"]
    order = rng.permutation(len(texts))
    docs = {i: texts[j] for i, j in enumerate(order)}
    got = near_duplicates(docs_of(spark, [docs[i] for i in range(len(docs))]), percent)
    assert result(got) == brute_force(docs, percent)


def test_small_and_large_buckets_agree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = edited_group(rng, 60, 100, 8) + edited_group(rng, 30, 40, 3)
    want = brute_force(dict(enumerate(texts)), 85)
    for limit in (2, 1000):
        monkeypatch.setattr(near_dup, "SMALL_BUCKET", limit)
        assert result(near_duplicates(docs_of(spark, texts), 85)) == want


def test_signatures():
    rng = np.random.default_rng(0)
    errors = []
    for n in (1, 3, 40, 400, 3000):
        shared = n * 3 // 4
        a = rng.integers(0, 2**63, shared, np.uint64)
        x, y = np.concatenate([a, rng.integers(0, 2**63, n - shared, np.uint64)]), np.concatenate([a, rng.integers(0, 2**63, n - shared, np.uint64)])
        both = super_minhash(np.concatenate([x, y, y[::-1]]), np.repeat([0, 1, 2], n), 3)
        assert (both[1] == both[2]).all()
        assert (both < np.iinfo(np.uint64).max).all()
        # Each element gives each slot one rank: of one element, all ranks occur.
        if n == 1:
            assert sorted((both[0] >> np.uint64(32)).tolist()) == list(range(near_dup.SLOTS))
        errors.append(abs((both[0] == both[1]).mean() - shared / (2 * n - shared)))
    assert max(errors) < 0.1


def test_sketches_keep_pairs_at_the_limit():
    rng = np.random.default_rng(1)
    n, worst = 300, 0
    for _ in range(60):
        a = rng.integers(0, 2**63, n, np.uint64)
        x, y = np.concatenate([a, rng.integers(0, 2**63, 37, np.uint64)]), np.concatenate([a, rng.integers(0, 2**63, 38, np.uint64)])
        s = near_dup.sketches(super_minhash(np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)]), 2))
        worst = max(worst, sum(bin(int(p) & (2**64 - 1)).count("1") for p in s[0] ^ s[1]))
    assert worst <= near_dup.most_bits(80)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (95, 100), (7, 7), (200, 3)] + [(500, 500 + k) for k in range(1, 40)] + [(None, 4)]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(7)
    got = {r["id"]: r["root"] for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 0, 95: 90, 100: 90, **{500 + k: 500 for k in range(1, 40)}}
    assert connected_components(df.where("false")).count() == 0


def test_near_duplicate_edges(spark):
    rows = near_duplicates(edge_docs(spark), 80).collect()
    assert len(rows) == len(EDGE_TEXTS)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] in (1, 2, 3, 5, 6, None)} == {(1, 1, True), (2, 2, True), (3, 3, True), (5, 5, True), (6, 5, False), (None, None, True)}
    assert near_duplicates(no_docs(spark)).count() == 0
    kept = keep_first(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(map(repr, [None, None, 1, 2, 3, 4, 5, 7, 8, 9]))
    assert keep_first(no_docs(spark)).count() == 0


def repeats(texts, window=13):
    """n_words, n_removed and the kept words of each (id, text)."""
    first, words = {}, [(i, (t or "").encode().split()) for i, t in texts]
    for i, own in words:
        if i is not None:
            for k in range(len(own) - window + 1):
                key = tuple(own[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, own in words:
        gone = [False] * len(own)
        for k in range(len(own) - window + 1):
            if i is not None and first[tuple(own[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(own), sum(gone), b" ".join(w for w, g in zip(own, gone, strict=True) if not g).decode()))
    return sorted(map(repr, out))


def removed(df):
    return sorted(map(repr, ((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect())))


def test_planted_repeats(spark):
    rng = np.random.default_rng(3)
    fill = lambda n: " ".join(f"f{x}" for x in rng.integers(0, 10**6, n))
    passage, short = " ".join(f"p{x}" for x in range(55)), " ".join(f"s{x}" for x in range(13))
    texts = [f"{fill(int(rng.integers(0, 30)))} {passage if i % 3 == 0 else short if i % 3 == 1 else fill(5)}\n{fill(int(rng.integers(0, 30)))}" for i in range(60)]
    texts += [" ".join(passage.split()[10:40]), " ".join(short.split()[:12]), "a " * 40, "a " * 14, "A " * 30, texts[0], texts[0] + " ", fill(200), " ".join(fill(30).split() * 3)]
    rows = [(int(i), texts[j]) for i, j in enumerate(rng.permutation(len(texts)))]
    assert removed(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == repeats(rows)


def test_repeat_edges(spark):
    assert removed(remove_repeats(edge_docs(spark))) == repeats(EDGE_TEXTS)
    assert remove_repeats(no_docs(spark)).count() == 0


def test_one_id_with_two_texts(spark):
    words = lambda a, b: " ".join(f"w{x}" for x in range(a, b))
    rows = [(1, words(0, 30)), (2, words(0, 30)), (2, words(50, 90)), (3, words(50, 90)), (4, words(85, 120))]
    assert removed(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == repeats(rows)


def test_filter_has_no_false_negatives(spark):
    rng = np.random.default_rng(0)
    values = rng.integers(-(2**63), 2**63, 5000)
    own = Filter(spark.createDataFrame([(int(v),) for v in values], "value long"))
    assert own(values.astype(np.int64).view(np.uint64)).all()
    assert own(rng.integers(0, 2**63, 5000, np.uint64)).mean() < 0.05


def test_digest(spark, sf_dir):
    rows = {r["doc_id"]: r["kept_sha256"] for r in op7_substring_dedup(spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["kept_text"] for r in remove_repeats(table(spark, sf_dir, "documents")).collect()}
    assert rows == {i: sha256(t.encode()).hexdigest() for i, t in texts.items()}


@pytest.mark.parametrize("bits", [2, 9])
def test_windows_that_share_a_hash(spark, bits):
    """With hashes of a few bits nearly all windows share one with others; the words decide all the same."""
    rng = np.random.default_rng(bits)
    passages = [" ".join(f"p{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(6)]
    fill = lambda n: " ".join(f"f{x}" for x in rng.integers(0, 10**6, n))
    rows = [(i, f"{fill(int(rng.integers(0, 20)))} {passages[i % 6] if i % 4 else ''} {fill(20)}\t{passages[(i + 1) % 6]}") for i in range(40)]
    rows += [(40, rows[0][1]), (40, fill(30)), (None, rows[2][1])]
    assert removed(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hash_bits=bits)) == repeats(rows)


def test_automaton_finds_equal_words_only():
    passage = b" ".join(b"w%d" % x for x in range(20))
    text = passage.split()
    other = [*text[:7], b"x", *text[8:]]
    hits = locate([text, other, text, []], [5, 5, 2, 9], [[(3, passage)], [(3, passage)], [(3, passage)], [(3, passage)]])
    assert [h.tolist() for h in hits] == [[True] * 8, [False] * 8, [False] * 8, []]
    assert covered(np.array([True, False, False, False]), 16).tolist() == [True] * 13 + [False] * 3


def test_words_beyond_three_letters(monkeypatch):
    numbers = np.array([0, 127, 128, 128**3 - 1, 128**3, 128**4 - 1])
    assert len(set(re.findall("....", substring.spelled(numbers, 4)))) == len(numbers)


def test_one_window_in_half_the_documents(spark, monkeypatch):
    """A hot window and a hot passage are dealt to several tasks, and nothing is lost."""
    monkeypatch.setattr(substring, "HOT_WINDOW", 20)
    rows = [(i, " ".join(f"h{x}" for x in range(30)) + f" own{i} " + " ".join(f"o{i}_{x}" for x in range(i % 20))) for i in range(200)]
    assert removed(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == repeats(rows)


@pytest.mark.parametrize("limit", [5, 10**9])
def test_hot_texts_bands_and_centers(spark, monkeypatch, limit):
    """One text in a third of the rows, one group of near copies in another third, empty texts in the last: dealt, and all the same."""
    monkeypatch.setattr(near_dup, "HOT_ROWS", limit)
    monkeypatch.setattr(near_dup, "HOT_KEYS", 10**9)
    rng = np.random.default_rng(9)
    texts = [" ".join(f"h{x}" for x in range(50))] * 300 + edited_group(rng, 120, 100, 3) + [""] * 150 + [None] * 10 + [" ".join(f"o{i}_{x}" for x in range(12)) for i in range(100)]
    docs = {i: texts[j] for i, j in enumerate(rng.permutation(len(texts)))}
    got = near_duplicates(docs_of(spark, [docs[i] for i in range(len(docs))]).repartition(6), 80)
    assert result(got) == brute_force(docs, 80)


def test_hot_keys_are_dealt(spark):
    rows = spark.range(10_000).select((F.col("id") % 2 * F.col("id")).alias("key"), F.col("id").alias("rep"))
    hot = spark.createDataFrame([(0,)], "hot_key long")
    sizes = {(r["key"], r["salt"]): r["count"] for r in near_dup._dealt(rows, hot, "rep").groupBy("key", "salt").count().collect()}
    assert sum(n for (k, _), n in sizes.items() if k == 0) == 5000
    assert max(sizes.values()) < 5000 / near_dup.SALTS * 1.4
    copied = near_dup._copied(rows.groupBy("key").count(), hot).collect()
    assert {(r["key"], r["salt"]) for r in copied} >= set(sizes)
    assert len(copied) == 5000 + near_dup.SALTS
