import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.llm.queries import op8_url_filter
from corpusmill.llm.url_filter import BASE_RULES, MIN_CONFIDENCE, MIN_LIFT, MIN_SUPPORT, TokenRule, judge_urls, match_rules, mine_rules, named_tokens
from tests.llm.tables import table


def parse(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for v, h, p in BASE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda f: len(f[0])) if fits else (None, None)
    return host, path, rule, verdict


def tokens(url):
    """What tokens_of() gives."""
    m = re.match(r"(?s)^(.*?)://([^/?#]*)([^?#]*)\??([^#]*)", url)
    plain = lambda x: re.sub("[0-9]+", "0", x)
    labels, parts = [x for x in parse(url)[0].split(".") if x], [x for x in m[3].split("/") if x]
    names = [x.split("=")[0] for x in m[4].split("&") if x.split("=")[0]]
    out = {f"scheme:{m[1].lower()}", f"depth:{min(len(parts), 5)}", *(f"path:{plain(x)}" for x in parts), *(f"name:{plain(x)}" for x in names)}
    return out | {f"last:{x}" for x in labels[-1:]} | {f"label:{plain(x)}" for x in labels[:-1]}


def best_rules(rows):
    """All rules of token combinations, level by level, best first. rows: tokens and verdict."""
    n, least = len(rows), math.ceil(MIN_SUPPORT * len(rows))
    share = {v: sum(w == v for _, w in rows) / n for v in ("block", "allow")}
    where = {}
    for i, (own, _) in enumerate(rows):
        for t in own:
            where.setdefault(frozenset([t]), set()).add(i)
    level, out = {k: w for k, w in where.items() if len(w) >= least}, []
    single = sorted(min(k) for k in level)
    while level:
        for own, at in level.items():
            for verdict in share:
                count = sum(rows[i][1] == verdict for i in at)
                if count >= least and count / len(at) >= max(MIN_CONFIDENCE, MIN_LIFT * share[verdict]):
                    out.append((-count / len(at), -count, verdict != "block", sorted(own), verdict))
        larger = {own | {t}: at & where[frozenset([t])] for own, at in level.items() for t in single if t > max(own)}
        level = {k: at for k, at in larger.items() if len(at) >= least}
    return sorted(out)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_query_equals_brute_force(spark, folder):
    got = {r["page_id"]: r for r in op8_url_filter(spark, folder).collect()}
    pages = [(r["page_id"], r["url"], *parse(r["url"])) for r in table(spark, folder, "pages").collect()]
    named = set(named_tokens())
    assert named == {"last:net", "label:example", "last:com", "last:org", "path:en", "path:de", "path:fr"}
    rules = best_rules([(tokens(url) - named, verdict) for _, url, _, _, _, verdict in pages if verdict])
    mined = 0
    for i, url, host, path, rule, verdict in pages:
        fitting = [r for r in rules if set(r[3]) <= tokens(url)]
        mined += verdict is None and bool(fitting)
        want = verdict or (fitting[0][4] if fitting else "allow")
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, want), url
    assert mined or not rules


def test_pruned_rules_decide_like_all_rules(spark):
    """Random tokens and verdicts that hang on some of them, so that combinations count."""
    rng = random.Random(4)
    rows = []
    for _ in range(600):
        own = {t for t in "abcdefg" if rng.random() < 0.35} | {"all"}
        rows.append((sorted(own), "block" if {"a", "b"} <= own or "c" in own and "d" not in own else "allow"))
    rules = mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"))
    want = best_rules([(set(own), v) for own, v in rows])
    df = spark.createDataFrame([(own,) for own, _ in rows], "t array<string>")
    got = [r["v"] for r in df.select(match_rules(F.col("t"), rules).alias("v")).collect()]
    assert got == [next((r[4] for r in want if set(r[3]) <= set(own)), None) for own, _ in rows]
    assert any(len(r.tokens) > 1 for r in rules)


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "https://example.net/enx", "x://y://z/q", "http://net/", "http://knet/", "http://a.net", "http://m.example.com/de/1",
    "http://example.com/fr/1", "http://org/fr/", "http://a.org?x=/fr/", "http://exämple.net/en/", "http://a.org#/fr/", "://host/p", "http://a.b.c.net/" + "x/" * 5000, "a\nb://Host.ORG/fr/\n?q",
]


def test_odd_urls(spark):
    df = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(URLS)] + [(None, URLS[4], "clash", 1)] * 2, "page_id long, url string, host string, tokens int")
    rows = judge_urls(df).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        if r["page_id"] is not None:
            assert (r["host"], r["path"], r["rule"]) == parse(URLS[r["page_id"]])[:3], URLS[r["page_id"]]
    assert judge_urls(df.where("false")).count() == 0


def test_mined_rules(spark):
    rows = [(["a", "b"], "block")] * 60 + [(["a", "c"], "allow")] * 40 + [(["d", "c"], "allow")] * 30 + [(["d", "b"], "allow")] * 3
    rules = mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"))
    want = {}
    names = sorted({t for r, _ in rows for t in r})
    for left in [(t,) for t in names] + [(s, t) for s in names for t in names if s < t]:
        for verdict in ("allow", "block"):
            own = [v for r, v in rows if set(left) <= set(r)]
            n = sum(v == verdict for v in own)
            share = sum(v == verdict for _, v in rows) / len(rows)
            if n >= 0.02 * len(rows) and n >= max(0.9, 1.2 * share) * len(own):
                want[left, verdict] = n / len(own)
    want = {k: c for k, c in want.items() if not any(set(o[0]) < set(k[0]) and o[1] == k[1] and d >= c for o, d in want.items())}
    assert {(r.tokens, r.verdict): r.confidence for r in rules} == want
    assert mine_rules(spark.createDataFrame([], "tokens array<string>, verdict string")) == []


def test_index_takes_the_best_rule(spark):
    rules = [TokenRule(("a", "b"), "block", 1.0, 0.5), TokenRule(("a",), "allow", 0.9, 0.5)]
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), (["b"],), ([],), (None,)], "t array<string>")
    assert [r["v"] for r in df.select(match_rules(F.col("t"), rules).alias("v")).collect()] == ["block", "allow", None, None, None]


def test_no_rule_is_cut(spark):
    """Two templates of 14 tokens that always come together, and a smaller site of less confidence with two tokens mixed."""
    big = [[f"{name}{k}" for k in range(14)] for name in "xy"]
    rows = [(big[0], "block")] * 60 + [(big[1], "allow")] * 60 + [(["s", "t", "all"], "block")] * 19 + [(["s", "t", "all"], "allow")] * 2 + [(["s", "u"], "allow")] * 20
    rules = mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"))
    assert {(r.choices(), r.verdict, round(r.confidence, 6)) for r in rules} == {
        ((tuple(sorted(big[0])),), "block", 1.0),
        ((tuple(sorted(big[1])),), "allow", 1.0),
        ((("all", "t"),), "block", round(19 / 21, 6)),
        ((("u",),), "allow", 1.0),
    }
    urls = [["x13"], ["y13", "z"], ["t"], ["all"], ["s"]]
    df = spark.createDataFrame([(u,) for u in urls], "t array<string>")
    assert [r["v"] for r in df.select(match_rules(F.col("t"), rules).alias("v")).collect()] == ["block", "allow", "block", "block", None]
