"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression with a verdict and a rank. Its literal tokens (runs of letters and digits that every match holds
whole) are known, and the index files it under the one fewest rules share. A URL's own tokens fetch the candidate rules, and only
those run their expressions; the best rank wins, and of equal ranks the smaller name. Judging is one Arrow UDF over host and path:
no shuffle, one way for any number of rules, each worker holding the index (its size is the rule list's, not the data's) and
compiling a rule's expression when a URL first fetches it.

The default rules are the site rules, words that block alone, and pairs of words (``PAIRED`` with ``COMPANIONS``, in either order)
that block next to each other. Site rules go before words.

Results for odd input: a null URL or one without ``://`` has empty host and path and fits no rule; letters beyond ASCII are never part
of a token and have no case; repeated rows are judged each; an empty table gives no rows; other columns pass through, and those named
like a result column are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[A-Za-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """The larger rank wins; ties go to the smaller name. tokens: literal tokens that every fitting host and path have whole."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def tokens_of(text: str) -> list[str]:
    return [t.lower() for t in TOKEN.findall(text)]


def site_rule(verdict: str, spec: str) -> Rule:
    """``host/path``: the host and all its subdomains, and paths that start with the rule's path."""
    host, slash, rest = spec.partition("/")
    path = slash + rest
    # the last token of the path may go on in the URL, unless the path ends in another character
    whole = tokens_of(path if not path or not path[-1].isalnum() else re.sub(r"[A-Za-z0-9]+$", "", path))
    return Rule(spec, verdict, rf"^(?:[^/]*\.)?(?-i:{re.escape(host.lower())}{re.escape(path)})", (*tokens_of(host), *whole), len(spec))


def word_rule(verdict: str, word: str) -> Rule:
    """A whole token anywhere in host or path; any site rule goes before it."""
    return Rule(f"word:{word}", verdict, rf"(?:^|[^A-Za-z0-9]){re.escape(word)}(?:[^A-Za-z0-9]|$)", (word,), 0)


def pair_rule(verdict: str, one: str, two: str) -> Rule:
    """Two whole tokens with one of - _ . between them."""
    return Rule(f"pair:{one}-{two}", verdict, rf"(?:^|[^A-Za-z0-9]){re.escape(one)}[-_.]{re.escape(two)}(?:[^A-Za-z0-9]|$)", (one, two), 0)


SITE_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
BLOCKED_WORDS = ("casino", "escort", "gambling", "malware", "phishing", "porn", "warez", "xxx")
PAIRED = ("ads", "adult", "bets", "betting", "cams", "cheap", "coins", "crack", "credit", "dating", "deals", "drugs", "farm", "free", "keygen", "loans", "lottery", "pharmacy", "pills", "poker", "prize", "rolex", "slots", "spam", "torrent", "viagra")
COMPANIONS = (
    "best", "bonus", "buy", "cash", "chat", "click", "club", "deal", "direct", "download", "dump", "easy", "fast", "fun", "games", "girls", "guide", "hot", "hub", "jackpot", "land", "link", "links", "list", "live",
    "lucky", "max", "money", "now", "offer", "online", "party", "plus", "pro", "rich", "sale", "shop", "spin", "star", "store", "top", "track", "vip", "win", "winner", "x", "xl", "zone",
)


def index_rules(rules: list[Rule]) -> dict[str, list[Rule]]:
    """Each rule under its rarest token (the fewest rules have it; then the longest, then the smallest)."""
    often = Counter(t for r in rules for t in set(r.tokens))
    index: dict[str, list[Rule]] = {}
    for r in rules:
        if not r.tokens:
            raise ValueError(f"rule {r.name} has no literal token")
        index.setdefault(min(r.tokens, key=lambda t: (often[t], -len(t), t)), []).append(r)
    return index


class Judge:
    """The index, its expressions compiled when first wanted."""

    def __init__(self, rules: list[Rule]):
        self.index, self.compiled = index_rules(rules), {}

    def __getstate__(self) -> dict:
        return {"index": self.index, "compiled": {}}

    def candidates(self, site: str) -> list[Rule]:
        return [r for t in set(tokens_of(site)) for r in self.index.get(t, ())]

    def best(self, site: str) -> Rule | None:
        won = None
        for r in self.candidates(site):
            if won is not None and (-won.rank, won.name) <= (-r.rank, r.name):
                continue
            found = self.compiled.get(r.name)
            if found is None:
                found = self.compiled[r.name] = re.compile(r.pattern, re.IGNORECASE | re.ASCII)
            if found.search(site):
                won = r
        return won


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (the name of the rule that decides; null: none fits) and verdict."""
    host, path = host_and_path(url)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    own = Judge(rules)

    @F.pandas_udf("name string, verdict string")
    def decide(sites: pd.Series) -> pd.DataFrame:
        won = [own.best(s) for s in sites]
        return pd.DataFrame({"name": [r.name if r else None for r in won], "verdict": [r.verdict if r else default for r in won]}, dtype=object)

    # a host has no slash and a path begins with one, so both together are told apart
    parts = pages.select(*kept, host.alias("host"), path.alias("path"))
    judged = parts.withColumn("_won", decide(F.concat("host", "path")))
    return judged.select(*kept, "host", "path", F.col("_won.name").alias("rule"), F.col("_won.verdict").alias("verdict"))


def default_rules() -> list[Rule]:
    pairs = [(a, b) for a in PAIRED for b in COMPANIONS]
    return [*(site_rule(v, s) for v, s in SITE_RULES), *(word_rule("block", w) for w in BLOCKED_WORDS), *(pair_rule("block", *p) for a, b in pairs for p in ((a, b), (b, a)))]
