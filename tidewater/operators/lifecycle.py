"""Status of records, changes between versions, and resolution of copies."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from tidewater.functions.text import fingerprint
from tidewater.operators.relational import first_by

#: The ladder's thresholds.
LEAST_CONFIDENCE, CLOSING_SOON_DAYS, UPCOMING_DAYS, EXPIRY_DAYS, AUTO_APPROVE = 0.45, 14, 365, 120, 0.75
_DAY = 86400.0


def status(kind: Column, deadline: Column, confidence: Column, review: Column, current: Column, now: datetime | Column) -> Column:
    """A record's status at now. A deadline at exactly now is not past; 14 days ahead still close soon, 365 are open, 120 past are closed."""
    at = now if isinstance(now, Column) else F.lit(now)
    ahead = (F.unix_micros(deadline.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 1e6 / _DAY
    approved = review.eqNullSafe("APPROVED")
    return (
        F.when(review.eqNullSafe("REJECTED"), "CLOSED")
        .when(current.eqNullSafe("REPLACED"), "REPLACED")
        .when(confidence < LEAST_CONFIDENCE, F.when(approved, "VERIFIED").otherwise("UNDER_REVIEW"))
        .when(kind.eqNullSafe("ROLLING"), "OPEN")
        .when(deadline.isNull(), F.when(approved, "VERIFIED").otherwise("DISCOVERED"))
        .when(ahead < -EXPIRY_DAYS, "EXPIRED")
        .when(ahead < 0, "CLOSED")
        .when(ahead <= CLOSING_SOON_DAYS, "CLOSING_SOON")
        .when(ahead > UPCOMING_DAYS, "UPCOMING")
        .otherwise("OPEN")
    )


def review_status(confidence: Column) -> Column:
    return F.when(confidence >= AUTO_APPROVE, "AUTO_APPROVED").otherwise("NEEDS_REVIEW")


def status_sweep(records: DataFrame, now: datetime, key: str = "id") -> DataFrame:
    """(key, old_status, new_status): the records whose status has changed."""
    new = status(F.col("deadline.kind"), F.col("deadline.date"), F.col("confidence"), F.col("reviewStatus"), F.col("status"), now)
    return records.select(key, F.col("status").alias("old_status"), new.alias("new_status")).where(~F.col("old_status").eqNullSafe(F.col("new_status")))


def transitions(changed: DataFrame) -> DataFrame:
    """(transition, n): counts of old→new."""
    return changed.groupBy(F.concat_ws("→", F.coalesce("old_status", F.lit("null")), "new_status").alias("transition")).agg(F.count(F.lit(1)).alias("n"))


#: Tracked path, its label, and how much a change matters.
TRACKED = (
    ("title", "title", "MINOR"),
    ("deadline.date", "deadline", "MAJOR"),
    ("deadline.kind", "deadline.kind", "MAJOR"),
    ("funding.primaryType", "funding", "MAJOR"),
    ("funding.tuitionCovered.value", "funding.tuitionCovered", "MAJOR"),
    ("funding.livingStipend.value", "funding.livingStipend", "MAJOR"),
    ("funding.stipendAmount.amount", "funding.stipendAmount", "MAJOR"),
    ("eligibility.scope", "eligibility", "MAJOR"),
    ("eligibility.countries", "eligibility.countries", "MAJOR"),
    ("degreeLevels", "degreeLevels", "MAJOR"),
    ("studyMode", "studyMode", "MINOR"),
    ("attendance", "attendance", "MINOR"),
    ("applicationUrl.value", "applicationUrl", "MAJOR"),
    ("requirements.english.ielts.minScore", "requirements.ielts", "MINOR"),
    ("requirements.minimumGpa.value", "requirements.minimumGpa", "MINOR"),
    ("academicYear", "academicYear", "MINOR"),
)


def _shown(c: Column, kind: str) -> Column:
    """How values are compared: dates by day, arrays sorted and joined, the rest as text."""
    if kind.startswith("array"):
        return F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), ",")
    if kind == "timestamp":
        return F.date_format(c, "yyyy-MM-dd")
    return c.cast("string")


def _kind_of(schema: DataType, path: str) -> str | None:
    """The type of a dotted path; null if the schema does not have it."""
    for name in path.split("."):
        if not isinstance(schema, StructType) or name not in schema.fieldNames():
            return None
        schema = schema[name].dataType
    return schema.simpleString()


def appended_changes(log: DataFrame, found: DataFrame, key: str, now: datetime, source_url: Column | None = None, run: Column | None = None) -> DataFrame:
    """log with the rows of changes() added, as (key, field, old_value, new_value, change_type, significance, detected_at, source_url, crawl_run_id); rows that are there stay as they are."""
    added = found.select(
        key, "field", "old_value", "new_value", F.lit("UPDATED").alias("change_type"), "significance", F.lit(now).alias("detected_at"),
        (source_url if source_url is not None else F.lit(None)).cast("string").alias("source_url"), (run if run is not None else F.lit(None)).cast("string").alias("crawl_run_id"),
    )
    return log.unionByName(added)


def verified_domains(known: DataFrame, candidates: DataFrame, now: datetime, verify: bool = True, fresh: str = "30 days") -> DataFrame:
    """known (domain, name, website, country, status, reason, last_verified_at, discovered_at) after a run over candidates, with outcome: created, updated, rejected, skipped or null where no candidate came.

    candidates: domain (one row each), name, website, country, verified, reason. A domain that
    is ACTIVE and was verified within fresh is skipped. One that fails becomes UNVERIFIED and
    keeps its other columns; one that passes takes the candidate's. New domains are added in
    either case. Without verify all become UNVERIFIED and count as passing.
    """
    a, b = known.alias("a"), candidates.withColumn("_c", F.lit(True)).alias("b")
    old, new = lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")
    there, came = F.col("a._k").isNotNull(), F.coalesce(F.col("b._c"), F.lit(False))
    skipped = came & F.coalesce((old("status") == "ACTIVE") & (old("last_verified_at") > F.lit(now) - F.expr(f"interval {fresh}")), F.lit(False))
    passed = F.lit(True) if not verify else F.coalesce(new("verified"), F.lit(False))
    outcome = F.when(skipped, "skipped").when(came & ~passed, "rejected").when(came & there, "updated").when(came, "created")
    site = F.coalesce(new("website"), F.concat(F.lit("https://"), F.col("domain")))
    takes = F.coalesce(outcome.isin("updated", "created"), F.lit(False))
    fills = lambda own, other: F.when(takes | (~there & came), other).otherwise(own)
    judged = F.coalesce(outcome.isin("updated", "created", "rejected"), F.lit(False))
    return known.withColumn("_k", F.lit(True)).alias("a").join(b, "domain", "full_outer").select(
        "domain", fills(old("name"), new("name")).alias("name"), fills(old("website"), site).alias("website"), fills(old("country"), F.coalesce(new("country"), F.lit("Unknown"))).alias("country"),
        F.when(takes, "ACTIVE" if verify else "UNVERIFIED").when(judged, "UNVERIFIED").otherwise(old("status")).alias("status"), F.when(judged, new("reason")).otherwise(old("reason")).alias("reason"),
        F.when(takes & F.lit(verify), F.lit(now)).otherwise(old("last_verified_at")).alias("last_verified_at"), F.when(there, old("discovered_at")).otherwise(F.lit(now)).alias("discovered_at"), outcome.alias("outcome"),
    )


def changes(old: DataFrame, new: DataFrame, key: str, tracked: Sequence[tuple[str, str, str]] = TRACKED) -> DataFrame:
    """(key, field, old_value, new_value, significance): what differs between two versions of the records in both tables.

    A value that becomes unknown (null, UNKNOWN, an empty list or [UNKNOWN]) is not a
    change of content and is left out. Paths that are not in both schemas are skipped.
    """
    a, b = old.alias("a"), new.alias("b")
    met = a.join(b, key)
    cases = []
    for path, label, weight in tracked:
        kind, other = _kind_of(old.schema, path), _kind_of(new.schema, path)
        if kind is None or other is None:
            continue
        before, after = _shown(F.col(f"a.{path}"), kind), _shown(F.col(f"b.{path}"), other)
        lost = before.isNotNull() & (before != "UNKNOWN") & (after.isNull() | after.isin("UNKNOWN", ""))
        cases.append(F.when(~before.eqNullSafe(after) & ~lost, F.struct(F.lit(label).alias("field"), before.alias("old_value"), after.alias("new_value"), F.lit(weight).alias("significance"))))
    rows = met.select(key, F.explode(F.array_compact(F.array(*cases))).alias("c"))
    return rows.select(key, "c.*")


def record_fingerprint(university: Column, title_key: Column, year: Column, degrees: Column, provider: Column) -> Column:
    """The key under which copies of a record meet; degrees in any order, the year's first 8 digits."""
    digits = F.substring(F.regexp_replace(F.coalesce(year, F.lit("")), "[^0-9]", ""), 1, 8)
    or_else = lambda c, word: F.when(F.coalesce(c, F.lit("")) == "", word).otherwise(c)
    listed = F.array_join(F.array_sort(F.coalesce(degrees, F.array().cast("array<string>"))), ",")
    return fingerprint(or_else(university.cast("string"), "no-university"), title_key, or_else(digits, "no-year"), or_else(listed, "no-degree"), or_else(F.trim(F.lower(provider)), "no-provider"))


def find_copies(drafts: DataFrame, records: DataFrame, sources: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(draft_id, record_id, match_type, similarity): for each draft the surest known record.

    By fingerprint, else by a source's canonical URL, else by a source's content hash, else
    by near (draft_id, record_id, similarity; the best, ties to the smaller record). Smaller
    record ids win ties. drafts: draft_id, fingerprint, canonical_url, content_hash; records:
    record_id, fingerprint; sources: record_id, canonical_url, content_hash.
    """
    def met(other: DataFrame, column: str, rank: int, kind: str) -> DataFrame:
        known = other.where(F.col(column).isNotNull()).groupBy(column).agg(F.min("record_id").alias("record_id"))
        return drafts.join(known, column).select("draft_id", "record_id", F.lit(rank).alias("rank"), F.lit(kind).alias("match_type"), F.lit(1.0).alias("similarity"))

    found = met(records, "fingerprint", 1, "FINGERPRINT").unionByName(met(sources, "canonical_url", 2, "CANONICAL_URL"))
    found = found.unionByName(met(sources, "content_hash", 3, "CONTENT_HASH"))
    if near is not None:
        found = found.unionByName(near.select("draft_id", "record_id", F.lit(4).alias("rank"), F.lit("NEAR_TITLE").alias("match_type"), F.round("similarity", 3).alias("similarity")))
    return first_by(found, ["draft_id"], [F.col("rank"), -F.col("similarity"), F.col("record_id")], ["record_id", "match_type", "similarity"])


def quality_gated(old: DataFrame, new: DataFrame, key: str, quality: str, keep: Sequence[str], slack: float = 0.05) -> DataFrame:
    """old with rows replaced by new ones of the same key whose quality is at most slack lower; keep columns stay, new keys are added."""
    a, b = old.alias("a"), new.alias("b")
    taken = F.col(f"a.{quality}").isNull() | (F.col(f"b.{quality}") >= F.col(f"a.{quality}") - slack)
    out = []
    for c in old.columns:
        if c == key:
            continue
        own, other = F.col(f"a.{c}"), F.col(f"b.{c}")
        out.append((F.coalesce(own, other) if c in keep else F.when(F.coalesce(taken & F.col("b._new"), F.lit(False)), other).otherwise(own)).alias(c))
    return a.join(new.withColumn("_new", F.lit(True)).alias("b"), key, "full_outer").select(key, *out)
