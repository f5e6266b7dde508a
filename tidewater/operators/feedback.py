"""Learning from review decisions, access and delivery."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.urls import normal_domain
from tidewater.operators.relational import top_per_group

#: Samples needed, rates and factors of the weights, rates and priorities of domains.
LEAST, HIGH, LOW, UP, DOWN, FLOOR, CEILING = 8, 0.8, 0.4, 1.04, 0.96, 0.5, 1.5
DOMAIN_LOW, DOMAIN_HIGH, LOWERED, RAISED = 0.2, 0.85, 5, 80


def reason_rates(feedback: DataFrame) -> DataFrame:
    """(reason, approved, total, rate) of feedback (decision, reasons); a reason counts once for each decision that carries it."""
    rows = feedback.select("decision", F.explode(F.array_distinct("reasons")).alias("reason"))
    out = rows.groupBy("reason").agg(F.count_if(F.col("decision") == "APPROVED").alias("approved"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("rate", F.col("approved") / F.col("total"))


def nudged_weights(weights: DataFrame, feedback: DataFrame) -> DataFrame:
    """(reason, weight): weights after one learning pass; reasons with few samples keep theirs, new ones begin at 1."""
    rates = reason_rates(feedback).where(F.col("total") >= LEAST)
    factor = F.when(F.col("rate") >= HIGH, UP).when(F.col("rate") <= LOW, DOWN).otherwise(1.0)
    met = weights.join(rates, "reason", "full_outer")
    moved = F.greatest(F.lit(FLOOR), F.least(F.lit(CEILING), F.coalesce("weight", F.lit(1.0)) * F.coalesce(factor, F.lit(1.0))))
    return met.select("reason", F.round(moved, 6).alias("weight"))


def reprioritised(targets: DataFrame, feedback: DataFrame) -> DataFrame:
    """targets (domain, priority) with priorities set by domains' approval; both sides' domains are made alike (www. is dropped), which also reaches hosts with www."""
    tally = feedback.groupBy(normal_domain(F.col("domain")).alias("_d")).agg((F.count_if(F.col("decision") == "APPROVED") / F.count(F.lit(1))).alias("_rate"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= LEAST)
    met = targets.withColumn("_d", normal_domain(F.col("domain"))).join(tally, "_d", "left")
    priority = F.when(F.col("_rate") <= DOMAIN_LOW, LOWERED).when(F.col("_rate") >= DOMAIN_HIGH, RAISED).otherwise(F.col("priority"))
    return met.withColumn("priority", priority).drop("_d", "_rate", "_n")


def entitled(readers: DataFrame, grants: DataFrame, now: datetime) -> DataFrame:
    """readers (reader) with tier PAID if a grant (reader, starts_at, ends_at) covers now, else FREE."""
    live = grants.where((F.col("starts_at") <= F.lit(now)) & (F.col("ends_at") >= F.lit(now))).select("reader").distinct().withColumn("_p", F.lit(True))
    return readers.join(live, "reader", "left").withColumn("tier", F.when(F.col("_p"), "PAID").otherwise("FREE")).drop("_p")


def deliveries(candidates: DataFrame, delivered: DataFrame, newest: int = 30, most: int = 15) -> DataFrame:
    """candidates (subscriber, record, at) to send: each subscriber's newest ones, less what was sent before, then the first of them. The limit comes before the exclusion."""
    order = [F.desc("at"), F.col("record")]
    fresh = top_per_group(candidates, ["subscriber"], order, newest).join(delivered, ["subscriber", "record"], "left_anti")
    return top_per_group(fresh, ["subscriber"], order, most)


def ad_shares(ads: DataFrame, slot: str = "slot") -> DataFrame:
    """ads (slot, ad, weight) with share and the cumulative range [low, high) that a uniform draw falls into."""
    whole = Window.partitionBy(slot)
    share = F.col("weight") / F.sum("weight").over(whole)
    until = F.sum("weight").over(whole.orderBy("ad").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("weight").over(whole)
    return ads.withColumns({"share": share, "high": until, "low": until - share})
