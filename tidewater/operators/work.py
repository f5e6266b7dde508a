"""Leased work queues, run locks, expiries, quotas and pruned projections, as transforms from one version of a table to the next.

Each takes the time as a parameter. A single writer replaces the table by what comes back.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Minutes of a lease, tries of a target, and expiries that one poll handles.
LEASE_MINUTES, TRIES, EXPIRED_PER_POLL = 15, 4, 200


def claimable(queue: DataFrame, now: datetime, tries: int = TRIES) -> DataFrame:
    """Targets (status, next_at, attempts, lease_until) that are due and not leased; a lease that has run out is none."""
    free = F.col("lease_until").isNull() | (F.col("lease_until") < F.lit(now))
    return queue.where(F.col("status").isin("PENDING", "FAILED") & (F.col("next_at") <= F.lit(now)) & (F.col("attempts") < tries) & free)


def claim(queue: DataFrame, now: datetime, most: int, key: str = "id", minutes: int = LEASE_MINUTES, tries: int = TRIES) -> DataFrame:
    """The claimed targets after the claim: the most urgent `most`, by priority, then the longest due, then key; PROCESSING, leased and with one more attempt."""
    first = claimable(queue, now, tries).orderBy(F.desc("priority"), "next_at", key).limit(most)
    return first.withColumns({"status": F.lit("PROCESSING"), "attempts": F.col("attempts") + 1, "lease_until": F.lit(now) + F.expr(f"interval {minutes} minutes")})


def after_claim(queue: DataFrame, claimed: DataFrame, key: str = "id") -> DataFrame:
    """The whole queue with its claimed rows replaced. claimed holds as many rows as one claim takes."""
    return queue.join(claimed.select(key), key, "left_anti").unionByName(claimed)


def reclaimable(queue: DataFrame, now: datetime) -> DataFrame:
    """Targets whose worker was lost: PROCESSING behind a lease that has run out, put back to PENDING."""
    lost = (F.col("status") == "PROCESSING") & (F.col("lease_until") < F.lit(now))
    return queue.where(lost).withColumns({"status": F.lit("PENDING"), "lease_until": F.lit(None).cast("timestamp")})


def locked(locks: DataFrame, wanted: DataFrame, now: datetime, minutes: int, key: str = "id") -> DataFrame:
    """wanted (id, holder, asked_at) with acquired: the first that asks for a lock gets it if nobody holds it (locks: id, locked_until, one row each) and its time has run out or never began."""
    first = F.row_number().over(Window.partitionBy(key).orderBy("asked_at", "holder")) == 1
    held = locks.where(F.col("locked_until") >= F.lit(now)).select(key, F.lit(True).alias("_held"))
    got = F.col("_first") & F.col("_held").isNull()
    met = wanted.withColumn("_first", first).join(held, key, "left")
    return met.select(*wanted.columns, got.alias("acquired"), F.when(got, F.lit(now) + F.expr(f"interval {minutes} minutes")).alias("locked_until"))


def expired(grants: DataFrame, now: datetime, key: str = "id", most: int = EXPIRED_PER_POLL) -> DataFrame:
    """The active grants (status, ends_at) that one poll ends: at most `most`, the longest overdue first, now with status expired; the next poll has the rest."""
    due = grants.where((F.col("status") == "active") & (F.col("ends_at") <= F.lit(now)))
    return due.orderBy("ends_at", key).limit(most).withColumn("status", F.lit("expired"))


def monthly_quota(views: DataFrame, reader: str, item: str, at: str, free: int) -> DataFrame:
    """(reader, month, item, first_at, used, allowed): distinct items of a reader in a month in order of their first view; the first `free` are allowed, and an item that is seen again costs nothing."""
    first = views.groupBy(reader, F.date_format(at, "yyyy-MM").alias("month"), item).agg(F.min(at).alias("first_at"))
    used = F.row_number().over(Window.partitionBy(reader, "month").orderBy("first_at", item))
    return first.withColumn("used", used).withColumn("allowed", F.col("used") <= free)


def pruned(records: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Only the named paths, nested as they were, so a scan reads no others. Paths that the schema lacks are left out, and so is what becomes empty."""

    def inside(kind, inner, names: list[str]):
        if kind.typeName() == "struct":
            fields = of(kind, inner, names)
            return F.struct(*fields) if fields else None
        if kind.typeName() == "array" and kind.elementType.typeName() == "struct":
            known = [n for n in names if n.split(".")[0] in kind.elementType.fieldNames()]
            return F.transform(inner, lambda x: F.struct(*of(kind.elementType, x, known))) if known else None
        return None

    def of(schema, column, names: list[str]):
        out = []
        for head in dict.fromkeys(n.split(".")[0] for n in names):
            if head in schema.fieldNames():
                rest = [n.partition(".")[2] for n in names if n.split(".")[0] == head]
                inner = column[head] if column is not None else F.col(head)
                kept = inner if "" in rest else inside(schema[head].dataType, inner, rest)
                out += [kept.alias(head)] if kept is not None else []
        return out

    return records.select(*of(records.schema, None, list(paths)))
