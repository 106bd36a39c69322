"""URL filters: pattern rules indexed by their rarest literal token.

A rule carries one regular expression and the literal tokens (maximal runs of a-z and 0-9) that every matching URL must hold.
The rules are indexed by the token that the fewest URLs hold, counted over all URLs; each URL's tokens fetch candidate rules,
and only those run their expressions. Judging is map-only: no shuffle, so a hot host costs no more than its own rows.

Null, empty and scheme-less URLs have empty host and path and no rule. Repeated rows and extra columns are kept as they are; the
result's column has a name of the caller's choice, and a clash is refused. Very long URLs are read whole. Of rules of equal length the
last by name decides. An empty table gives no rows. The rule list is a driver-side parameter; it is refused beyond ``MAX_RULES`` rather than broadcast unbounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

MAX_RULES = 200_000
_URL = re.compile(r"://([^/?#]*)([^?#]*)")
_TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """name: what results show. base: a host and path rule, whose length decides; other rules apply where no base rule fits."""

    name: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    base: bool = False


def host_rule(action: str, rule: str) -> Rule:
    """``host/path``: fits the host and its subdomains where the URL's path starts with the rule's path. Without a slash the host must end where the rule does."""
    host, slash, path = rule.partition("/")
    low = path.rpartition("/")[0].translate(_LOWER)  # a path's last segment may be a prefix of a longer token
    whole = [*_TOKEN.findall(host), *_TOKEN.findall(low)]
    return Rule(rule, action, rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path) if slash else r'(?=/|\Z)'}", tuple(whole), True)


def word_rule(action: str, token: str) -> Rule:
    """A token of the host that stands alone between separators."""
    return Rule(f"host:{token}", action, rf"[^/]*(?<![a-z0-9]){token}(?![a-z0-9])", (token,))


def glob_rule(action: str, pattern: str) -> Rule:
    """Host and path with ``*`` for any characters; fits subdomains too. The tokens that touch no ``*`` must stand whole in a URL."""
    whole = [t for m in re.finditer(r"[a-z0-9*]+", pattern.translate(_LOWER)) if "*" not in (t := m[0])]
    return Rule(pattern, action, r"(?:[^/]*\.)?" + ".*".join(map(re.escape, pattern.split("*"))) + r"\Z", tuple(whole))


#: The contract's rules, and the method's own words.
BASE_RULES = (
    host_rule("block", "com/en/"),
    host_rule("allow", "example.com/en/7"),
    host_rule("allow", "net/de/"),
    host_rule("block", "example.net/de/8"),
    host_rule("block", "org/es/"),
)
BLOCKED_WORDS = ("adult", "casino", "malware", "phish", "porn", "spam", "xxx")
BLOCKED_GLOBS = ("*/cgi-bin/*", "*/wp-login.php", "*/xmlrpc.php", "adserver.*", "banner-ads.*", "cheap-pills.*", "click-track.*", "free-bets.*", "payday-loans.*", "replica-watches.*", "warez.*/*.exe")
RULES = (*BASE_RULES, *(word_rule("block", w) for w in BLOCKED_WORDS), *(glob_rule("block", g) for g in BLOCKED_GLOBS))


def split_url(url: str | None) -> tuple[str, str]:
    found = _URL.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def token_counts(urls: DataFrame, url_col: str, tokens: Iterable[str]) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens, over all URLs; the result is bounded by the rule list."""
    wanted = sorted(set(tokens))
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col(url_col)), F.lit("[a-z0-9]+"), F.lit(0)))
    held = urls.select(F.explode(F.array_intersect(found, F.lit(wanted))).alias("token"))
    return {t: 0 for t in wanted} | {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}


def judge_urls(urls: DataFrame, url_col: str = "url", rules: Iterable[Rule] = RULES, otherwise: str = "allow", out_col: str = "_url") -> DataFrame:
    """All columns of ``urls`` plus a struct column ``out_col`` of host, path, rule, verdict and pattern (the deciding rule of either kind)."""
    rules = tuple(rules)
    if out_col in urls.columns:
        raise ValueError(f"the table has a column {out_col}; name another for the result")
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are sent to the executors")
    counts = token_counts(urls, url_col, (t for r in rules for t in r.tokens))
    index: dict[str | None, list[int]] = {}
    for k, rule in enumerate(rules):
        index.setdefault(min(rule.tokens, key=lambda t: (counts[t], t), default=None), []).append(k)

    @F.pandas_udf("host string, path string, rule string, verdict string, pattern string")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled: dict[int, re.Pattern] = {}
        for batch in batches:
            out = []
            for url in batch:
                host, path = split_url(url)
                best = None
                tokens = {None, *_TOKEN.findall((host + path).translate(_LOWER))}
                for k in (k for t in tokens for k in index.get(t, ())):
                    if k not in compiled:
                        compiled[k] = re.compile(rules[k].regex)
                    if (host or path) and compiled[k].match(host + path):
                        best = max(best or (), (rules[k].base, len(rules[k].name), rules[k].name, rules[k].action))
                if best:
                    out.append((host, path, best[2] if best[0] else None, best[3], best[2]))
                else:
                    out.append((host, path, None, otherwise, None))
            yield pd.DataFrame(out, columns=["host", "path", "rule", "verdict", "pattern"])

    return urls.withColumn(out_col, judge(F.col(url_col)))
