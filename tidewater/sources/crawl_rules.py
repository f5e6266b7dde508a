"""Crawl rules of many hosts: robots.txt bodies parsed on the executors by a table function, and the rules joined with addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.sources.pages import robots_groups

#: The longest delay that is kept, in seconds, and why an address may not be read.
MOST_DELAY = 60
UNPARSEABLE, DISALLOWED = "unparseable url", "disallowed by robots.txt"


@F.udtf(returnType="allow boolean, pattern string, delay_ms long", useArrow=True)
class RobotsRules:
    """The rules of the group that names the agent, else of the * group, a row each; a group without rules has one row for its delay."""

    def eval(self, agent: str, body: str):
        rules, delay = robots_groups(agent or "", body or "")
        ms = None if delay is None else int(min(delay, MOST_DELAY) * 1000)
        for allow, pattern in rules or [(None, None)]:
            yield allow, pattern, ms


def robots_table(bodies: DataFrame, agent: str) -> DataFrame:
    """(host, allow, pattern, delay_ms) of bodies (host, body), parsed in parallel; a null body has no rules."""
    given = bodies.where(F.col("host").isNotNull()).select("host", "body", F.lit(agent).alias("agent"))
    return given.lateralJoin(RobotsRules(F.col("agent").outer(), F.col("body").outer())).select("host", "allow", "pattern", "delay_ms")


def rule_regex(pattern: Column) -> Column:
    """A rule as a regular expression: a prefix, * for anything, $ at its end for the end."""
    escaped = F.regexp_replace(pattern, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(escaped, r"\*", ".*"), r"\\\$$", r"\$"))


def robots_verdicts(urls: DataFrame, bodies: DataFrame, agent: str) -> DataFrame:
    """(url, allowed, reason, delay_ms) for each distinct url of urls: the longest rule of its host that fits path and query decides, allow wins ties.

    Hosts without a body or without a group for the agent allow all. An address without a host
    is not allowed. Rules meet addresses by host, never all with all.
    """
    told = urls.select("url").distinct()
    host = F.lower(F.regexp_extract("url", r"^(?i)https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_extract("url", r"^[^:]+://[^/?#]*([^#]*)", 1)
    told = told.withColumn("host", F.nullif(host, F.lit(""))).withColumn("path", F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))
    rules = robots_table(bodies, agent)
    delays = rules.groupBy("host").agg(F.max("delay_ms").alias("delay_ms"))
    usable = rules.where(F.col("pattern") != "").select("host", "allow", "pattern", rule_regex(F.col("pattern")).alias("regex"))
    best = told.join(usable, "host").where(F.regexp_like("path", F.col("regex"))).groupBy("url").agg(F.max(F.struct(F.length("pattern").alias("n"), "allow"))["allow"].alias("allow"))
    out = told.join(best, "url", "left").join(delays, "host", "left")
    reason = F.when(F.col("host").isNull(), UNPARSEABLE).when(~F.col("allow"), DISALLOWED)
    return out.select("url", (F.col("host").isNotNull() & F.coalesce("allow", F.lit(True))).alias("allowed"), reason.alias("reason"), F.when(F.col("host").isNotNull(), F.col("delay_ms")).alias("delay_ms"))
