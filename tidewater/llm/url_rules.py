"""URL filters: rules indexed by their rarest literal token, with DataFrame functions only.

A rule is a regular expression over host + path with its literal tokens (runs of
letters and digits that every match must hold as whole tokens). Each rule is filed
under the one of its tokens that is rarest among the URLs. The tokens of a URL fetch
the rules filed under them, and only those rules' expressions run on it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.storage import inline_rows

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """name: as reported; pattern: over host + path; tokens: literal whole tokens of every match; verdict: allow or block; rank: the largest wins."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    rank: int


def prefix_rule(verdict: str, text: str) -> Rule:
    """A host (with its subdomains) and the start of a path, as `example.net/en/`."""
    host, _, path = text.partition("/")
    path = "/" + path
    # The last token of a path that does not end at a separator may be the start of a longer one.
    whole = re.findall(_TOKEN, path.lower()) if not path[-1].isalnum() else re.findall(_TOKEN, path.lower())[:-1]
    return Rule(text, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", (*re.findall(_TOKEN, host), *whole), verdict, len(text))


def host_word_rule(verdict: str, word: str) -> Rule:
    """A hyphen- or dot-separated word (or words) inside the host, as `spam-farm`."""
    return Rule(word, rf"^[^/]*(?<![a-z0-9]){re.escape(word)}(?![a-z0-9])[^/]*/?", tuple(re.findall(_TOKEN, word)), verdict, 0)


#: The contract's rules, and the words that block a host that no rule decides on.
RULES = (prefix_rule("block", "net/"), prefix_rule("allow", "example.net/en/"), prefix_rule("block", "example.com/de/"), prefix_rule("allow", "org/fr/"))
PATTERNS = tuple(host_word_rule("block", w) for w in ("spam", "cheap-pills", "casino", "porn", "xxx", "warez", "malware", "phishing"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rank(rank: Column, verdict: Column, rule: Column, ruled: Column) -> Column:
    """What the best of several fitting rules is the maximum of: rank, then block before allow, then the name."""
    return F.struct(rank.alias("rank"), (verdict == "block").alias("blocks"), rule.alias("rule"), verdict.alias("verdict"), ruled.alias("ruled"))


def _best(urls: DataFrame, rules: Sequence[tuple[Rule, bool]]) -> DataFrame:
    """(host, path, rule, verdict, ruled): the best rule for each of the distinct (host, path) that has one."""
    spark = urls.sparkSession
    filed = [(r.name, r.pattern, sorted(set(r.tokens)), r.verdict, r.rank, ruled) for r, ruled in rules if r.tokens]
    known = inline_rows(spark, filed, "rule string, pattern string, tokens array<string>, verdict string, rank int, ruled boolean")
    line = F.concat("host", F.translate("path", _UPPER, _LOWER))
    tokens = urls.select("host", "path", F.explode(F.array_distinct(F.regexp_extract_all(line, F.lit(_TOKEN), F.lit(0)))).alias("token"))
    wanted = known.withColumn("token", F.explode("tokens"))
    seen = tokens.join(wanted.select("token").distinct(), "token", "left_semi")
    heard = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = wanted.join(heard, "token", "left").groupBy("rule", "pattern", "verdict", "rank", "ruled")
    index = index.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least")).withColumn("token", F.col("least.token"))
    whole = F.concat("host", "path")
    met = seen.join(index, "token").where(F.regexp_like(whole, F.col("pattern")))
    met = met.select("host", "path", _rank(*[F.col(c) for c in ("rank", "verdict", "rule", "ruled")]).alias("r"))
    free = [(r, ruled) for r, ruled in rules if not r.tokens]
    if free:  # a rule without a literal token has to be tried on every URL
        fits = [F.when(F.regexp_like(whole, F.lit(r.pattern)), _rank(*[F.lit(x) for x in (r.rank, r.verdict, r.name, ruled)])) for r, ruled in free]
        met = met.unionByName(urls.select("host", "path", (F.greatest(*fits) if len(fits) > 1 else fits[0]).alias("r")).where("r is not null"))
    return met.groupBy("host", "path").agg(F.max("r").alias("r")).select("host", "path", "r.rule", "r.verdict", "r.ruled")


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, patterns: Sequence[Rule] = PATTERNS) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages.

    rules decide by the longest that fits; where none does, rule is null and the verdict
    is block if one of patterns fits, else allow. Null urls and urls without :// have an
    empty host and path, so no rule fits and they are allowed. Equal URLs are judged once.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    lowest = 1 + max([p.rank for p in patterns], default=0)
    told = [(Rule(r.name, r.pattern, r.tokens, r.verdict, r.rank + lowest), True) for r in rules] + [(p, False) for p in patterns]
    best = _best(rows.select("host", "path").distinct(), told)
    verdict = F.coalesce("verdict", F.lit("allow")).alias("verdict")
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.when(F.col("ruled"), F.col("rule")).alias("rule"), verdict)
