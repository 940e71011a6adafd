"""URL filter: host and path rules, and association rules mined from their verdicts for the urls that no rule fits."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import ascii_lower, stored

#: verdict, host, path. Fixed values.
BASE_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Share of the labelled urls that a combination needs, share of its urls with the verdict, and how many times the verdict's share
#: in all labelled urls that must be.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.02, 0.9, 1.2
DEFAULT = "allow"
_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class TokenRule:
    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: float
    #: For each of tokens, all that occur in the same labelled urls as it does; any of them fits as well. Empty: only tokens fit.
    alike: tuple[tuple[str, ...], ...] = ()

    def choices(self) -> tuple[tuple[str, ...], ...]:
        return self.alike or tuple((t,) for t in self.tokens)


def host_of(url: Column) -> Column:
    """Lower-cased host: after the first :// up to /, ?, # or the end; empty for null or without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _PATTERN, 1))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PATTERN, 2)


def base_rule(host: Column, path: Column, rules: tuple = BASE_RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        made = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: scheme, last and other labels of the host, path segments, depth and query names; digits count as 0."""
    plain = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"(?s)^([^=]*)", 1)), lambda x: x != "")
    made = F.concat(
        F.array(F.concat(F.lit("scheme:"), ascii_lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))), F.concat(F.lit("depth:"), F.least(F.size(segments), F.lit(5)).cast("string"))),
        F.when(n > 0, F.array(F.concat(F.lit("last:"), F.element_at(labels, -1)))).otherwise(F.array().cast("array<string>")),
        F.when(n > 1, F.transform(F.slice(labels, 1, n - 1), lambda x: F.concat(F.lit("label:"), plain(x)))).otherwise(F.array().cast("array<string>")),
        F.transform(segments, lambda x: F.concat(F.lit("path:"), plain(x))),
        F.transform(names, lambda x: F.concat(F.lit("name:"), plain(x))),
    )
    return F.array_distinct(made)


def named_tokens(rules: tuple = BASE_RULES) -> list[str]:
    """The tokens that the base rules themselves are made of. What follows from them is no more than the rules' own shape."""
    out = set()
    for _, host, path in rules:
        *labels, last = host.split(".")
        out |= {f"last:{last}", *(f"label:{x}" for x in labels), *(f"path:{x}" for x in path.split("/") if x)}
    return sorted(out)


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> list[TokenRule]:
    """Rules from token combinations to a verdict, mined from (tokens, verdict) by FP-growth.

    A rule is pruned if one with fewer of its tokens has its verdict and no lower confidence. No url loses a frequent token and no
    rule is left out otherwise. The miner does not see tokens whose combinations are all pruned: those of one verdict only and those
    of all urls are rules by themselves, and of tokens that occur in the same urls one stands for all.
    """
    n, n_blocked = labelled.agg(F.count("*"), F.count_if(F.col("verdict") == "block")).first()
    if not n:
        return []
    lifted = {"block": min_lift * n_blocked / n, "allow": min_lift * (n - n_blocked) / n}
    # Sums of both halves of a hash of the url's tokens tell in which urls a token is.
    hashed = labelled.select(F.explode("tokens").alias("token"), "verdict", F.xxhash64("tokens").alias("h"))
    counts = hashed.groupBy("token").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("verdict") == "block").alias("blocked"),
        F.sum(F.col("h").bitwiseAND(0xFFFFFFFF)).alias("low"),
        F.sum(F.shiftrightunsigned("h", 32)).alias("high"),
    )
    # As FPGrowth counts the urls that a combination needs.
    least = math.ceil(min_support * n)
    classes: dict[tuple, list[str]] = {}
    for r in counts.where(F.col("n") >= least).collect():
        classes.setdefault((r["n"], r["blocked"], r["low"], r["high"]), []).append(r["token"])
    out: list[TokenRule] = []
    mixed: dict[str, tuple[str, ...]] = {}
    for (all_of, blocked, *_), own in classes.items():
        own = tuple(sorted(own))
        if 0 < blocked < all_of < n:
            mixed[own[0]] = own
            continue
        for verdict, count in (("block", blocked), ("allow", all_of - blocked)):
            if count >= least and count / all_of >= max(min_confidence, lifted[verdict]):
                out.append(TokenRule(own[:1], verdict, count / all_of, count / n, (own,)))
    if mixed:
        spoken = F.array(*map(F.lit, sorted(mixed)))
        baskets = labelled.select(F.array_append(F.array_intersect("tokens", spoken), F.concat(F.lit("verdict:"), "verdict")).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
        rules = model.associationRules.where(F.col("consequent")[0].startswith("verdict:") & ~F.exists("antecedent", lambda x: x.startswith("verdict:")))
        rules = stored(rules.select(F.array_sort("antecedent").alias("tokens"), F.expr("substring(consequent[0], 9)").alias("verdict"), "confidence", "support").where(F.col("confidence") >= F.when(F.col("verdict") == "block", lifted["block"]).otherwise(lifted["allow"])))
        # From small to large: what is pruned by a pruned rule is also pruned by one that stayed, so only these are collected.
        stayed: dict[frozenset, list[tuple[str, float]]] = {}
        for size in sorted(r[0] for r in rules.select(F.size("tokens")).distinct().collect()):
            for r in rules.where((F.size("tokens") == size) & ~_pruned(stayed)("tokens", "verdict", "confidence")).collect():
                stayed.setdefault(frozenset(r["tokens"]), []).append((r["verdict"], r["confidence"]))
                out.append(TokenRule(tuple(r["tokens"]), r["verdict"], r["confidence"], r["support"], tuple(mixed[t] for t in r["tokens"])))
    return sorted(out, key=lambda o: (-o.confidence, -o.support, o.verdict != "block", o.tokens))


def _pruned(stayed: dict[frozenset, list[tuple[str, float]]]):
    """Whether a rule has a smaller one among these, of its verdict and no lower confidence."""
    by_token: dict[str, list[tuple[frozenset, str, float]]] = {}
    for own, heads in stayed.items():
        by_token.setdefault(min(own), []).extend((own, *head) for head in heads)

    @F.pandas_udf("boolean")
    def pruned(tokens: pd.Series, verdict: pd.Series, confidence: pd.Series) -> pd.Series:
        def one(own, v, c) -> bool:
            own = frozenset(own)
            return any(v == w and d >= c and own.issuperset(less) for t in own for less, w, d in by_token.get(t, ()))

        return pd.Series([one(*row) for row in zip(tokens, verdict, confidence, strict=True)], dtype=bool)

    return pruned


def match_rules(tokens: Column, rules: list[TokenRule]) -> Column:
    """The verdict of the first rule, in their order, whose tokens all occur; null if none. Rules are found by an inverted index."""
    index: dict[str, list[tuple[int, int]]] = {}
    for i, rule in enumerate(rules):
        for place, choice in enumerate(rule.choices()):
            for token in choice:
                index.setdefault(token, []).append((i, place))
    sizes, verdicts = [len(r.tokens) for r in rules], [r.verdict for r in rules]

    @F.pandas_udf("string")
    def judged(rows: pd.Series) -> pd.Series:
        def one(own) -> str | None:
            if own is None:
                return None
            hits: dict[int, set[int]] = {}
            for token in own:
                for i, place in index.get(token, ()):
                    hits.setdefault(i, set()).add(place)
            full = [i for i, places in hits.items() if len(places) == sizes[i]]
            return verdicts[min(full)] if full else None

        return rows.map(one)

    return judged(tokens)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = BASE_RULES) -> DataFrame:
    """id, host, path, rule and verdict (allow or block) of each row.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins. Urls that a rule fits are the
    labels that association rules are mined from, without the tokens that the rules name; a url without a rule gets the verdict of
    the best association rule that fits it, or DEFAULT. Of association rules that tie in confidence and support, block wins. Urls of
    any length are taken whole. Null urls and those without :// have an empty host and path and no rule. Repeated rows and null ids each
    give their own row; other columns are not read; an empty table gives no rows.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    parsed = pages.select(F.col(id_col).alias("id"), url.alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    parsed = parsed.withColumn("base", base_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    parsed = stored(parsed.select("id", "host", "path", "base", "tokens"))
    labelled = parsed.where("base is not null").select(F.array_except("tokens", F.array(*map(F.lit, named_tokens(rules)))).alias("tokens"), F.col("base.verdict").alias("verdict"))
    mined = mine_rules(labelled)
    return parsed.select(F.col("id").alias(id_col), "host", "path", F.col("base.rule").alias("rule"), F.coalesce(F.col("base.verdict"), match_rules(F.col("tokens"), mined), F.lit(DEFAULT)).alias("verdict"))
