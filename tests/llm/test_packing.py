import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusmill.llm.encoder import encoder
from corpusmill.llm.packing import RANKS, VOCABULARY, Places, best_fill, pack, plan, power_of_two
from corpusmill.llm.queries import op10_packing
from tests.llm.tables import EDGE_TEXTS, edge_docs, no_docs, table


@pytest.fixture(scope="module")
def slow():
    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


def check(rows, texts, slow):
    """Each id of each text lies in exactly one piece; sequences are gapless, at most 2048 long and unpadded."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    want = defaultdict(list)
    for i, text in texts:
        want[i].append([*slow.encode(text or "", add_special_tokens=False).ids, 1])
    assert set(pieces) == set(want)
    for i, all_ids in want.items():
        found = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces[i])
        if len(all_ids) == 1:
            at = 0
            for start, length, crc, total in found:
                assert start == at and total == len(all_ids[0])
                assert crc == zlib.crc32(np.array(all_ids[0][start : start + length], "<u4").tobytes())
                at += length
            assert at == len(all_ids[0])
        else:
            assert sum(length for _, length, _, _ in found) == sum(map(len, all_ids))
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        assert power_of_two(at)


def test_query_is_an_exact_round_trip(spark, sf_dir, slow):
    check(op10_packing(spark, sf_dir).collect(), [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()], slow)


def test_edges(spark, slow):
    check(pack(edge_docs(spark)).collect(), EDGE_TEXTS, slow)
    assert pack(no_docs(spark)).count() == 0


ODD = ["", " ", "<|endoftext|> a <|endoftext|>", "\x00\x1c\x85", "a" * 5000, " " * 3000 + "x", "é" * 40, "नमस्ते", "😀‍", "don't we'll I'M", "1²2½", " ­", "tab\t\tx\r\n\r\ny  ", "ªº·ǅ", "«»¿"]


def test_both_libraries_agree(slow):
    encode = encoder(VOCABULARY, RANKS).encode
    for text in ODD:
        assert encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2FF, exclude_categories=("Cs",)), max_size=80))
def test_both_libraries_agree_on_any_text(text):
    slow = encoder(VOCABULARY, RANKS).slow
    assert encoder(VOCABULARY, RANKS).encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=7), st.integers(1, 40))
def test_fill_is_the_closest(counts, capacity):
    sums = {0}
    for length, n in counts.items():
        sums |= {s + length * k for s in sums for k in range(n + 1) if s + length * k <= capacity}
    got = best_fill(counts, capacity)
    assert all(0 < n <= counts[length] for length, n in got.items())
    assert sum(length * n for length, n in got.items()) == max(sums)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_holds_each_piece_once(counts):
    used = defaultdict(int)
    for p in plan(counts, 64):
        assert p.total <= 64 and p.repeats >= 1
        for length, n in p.counts:
            used[length] += n * p.repeats
    assert used == counts


def test_few_sequences():
    rng = np.random.default_rng(0)
    counts = {i + 1: int(x) for i, x in enumerate(rng.multinomial(20_000, rng.dirichlet(np.ones(2047)))) if x}
    least = sum(k * n for k, n in counts.items()) / 2048
    assert Places(counts, 2048).sequences < 1.02 * least
