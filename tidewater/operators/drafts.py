"""Drafts of records: rule extraction over a page, scores, merging with a second reading, and the gate before storing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import dates, extract
from tidewater.functions.enums import SOURCE_TYPES
from tidewater.functions.money import authority, clamp
from tidewater.functions.patterns import once_for_copies
from tidewater.functions.text import derived_title, sentences, title_key

#: Rank of each source type, in the order of SOURCE_TYPES.
AUTHORITY = dict(zip(SOURCE_TYPES, (1, 2, 3, 4, 5, 6, 5, 7), strict=True))
#: Weights of confidence and quality, penalties and the number of fields of a full record.
CONFIDENCE = {"authority": 0.28, "classification": 0.20, "funding": 0.16, "eligibility": 0.14, "deadline": 0.12, "degree": 0.10}
QUALITY = {"completeness": 0.30, "authority": 0.25, "confidence": 0.20, "application": 0.15, "deadline": 0.10}
PENALTY, MOST_PENALTY, FIELDS = 0.06, 0.25, 16


def drafts(pages: DataFrame, now: datetime) -> DataFrame:
    """pages (url, title, meta, headings, links, text, country) with the extracted fields, by rules alone; headings count twice. Pages of one content and country are read once, whatever their addresses."""
    return once_for_copies(pages, ["title", "meta", "headings", "links", "text", "country"], lambda d: _each_draft(d, now))


def _each_draft(pages: DataFrame, now: datetime) -> DataFrame:
    heads = F.array_join(F.coalesce("headings", F.array().cast("array<string>")), ". ")
    step = pages.withColumn("_corpus", F.concat_ws("\n", "title", "meta", heads, heads, "text"))
    for add in (extract.with_degree_levels, extract.with_funding, extract.with_eligibility):
        step = add(step, "_corpus")
    step = dates.each_deadline(step, "_corpus", "country", now).withColumn("_s", sentences(F.col("_corpus"), 3, 699))
    corpus = F.col("_corpus")
    title = derived_title(F.col("title"), F.try_element_at("headings", F.lit(1)))
    step = step.withColumn("requirements", extract.requirements(F.col("_s")))
    return step.withColumns({
        "award_title": title, "fieldsOfStudy": F.col("requirements.requiredFields"), "normalizedTitle": title_key(title), "degreeLevels": F.col("degree.levels"), "studyMode": extract.study_mode(corpus), "attendance": extract.attendance(corpus),
        "deliveryMode": extract.delivery_mode(corpus), "provider": extract.provider(corpus, title), "applicationUrl": extract.application_url(F.col("links")),
        "academicYear": dates.academic_year(corpus), "intake": dates.intake(corpus), "duration": dates.duration(corpus),
    }).drop("_corpus", "_s", "degree")


def fields_extracted(d: DataFrame) -> Column:
    """How many of the draft's fields are stated."""
    has = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    known = lambda name: has(F.col(name) != "UNKNOWN")
    parts = [
        has(F.size("degreeLevels") > 0), has(F.col("studyMode")[0] != "UNKNOWN"), has(F.col("attendance")[0] != "UNKNOWN"), known("funding.primaryType"),
        has(F.col("funding.tuitionCovered.value").isNotNull()), has(F.col("funding.livingStipend.value").isNotNull()), has(F.col("funding.stipendAmount.amount").isNotNull()),
        known("eligibility.scope"), has(F.size("eligibility.countries") > 0), has(F.exists(F.array(*[F.col(f"requirements.english.{t}.required") for t in extract.ENGLISH]), lambda r: r.isNotNull())),
        has(F.size("fieldsOfStudy") > 0), has(F.col("requirements.minimumDegree").isNotNull()), has(F.size("requirements.documents") > 0),
        known("deadline.kind"), has(F.col("applicationUrl").isNotNull()), has(F.col("academicYear").isNotNull()),
    ]
    return sum(parts[1:], parts[0])


def scored(d: DataFrame, source_type: Column, classification: Column, disagreements: Column) -> DataFrame:
    """Adds confidence (does the draft say what the page says) and qualityScore (how useful it is), with three digits."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in AUTHORITY.items() for x in pair]), source_type), F.lit(7))
    step = d.withColumns({"_a": authority(rank), "_n": fields_extracted(d)})
    funding = F.when(F.col("funding.primaryType") == "UNKNOWN", 0.0).otherwise(F.greatest("funding.tuitionCovered.confidence", "funding.livingStipend.confidence", F.lit(0.4)))
    scope = F.when(F.col("eligibility.scope") == "UNKNOWN", 0.0).when(F.col("eligibility.scopeCertainty") == "CONFIRMED", 0.9).otherwise(0.6)
    due = F.when(F.col("deadline.kind") == "UNKNOWN", 0.0).otherwise(F.col("deadline.confidence"))
    parts = {"authority": F.col("_a"), "classification": classification, "funding": funding, "eligibility": scope, "deadline": due, "degree": F.when(F.size("degreeLevels") > 0, 0.85).otherwise(0.0)}
    raw = sum((CONFIDENCE[k] * v for k, v in parts.items()), F.lit(0.0)) - F.least(F.lit(MOST_PENALTY), disagreements * PENALTY)
    step = step.withColumn("_raw", raw)
    useful = {
        "completeness": F.least(F.lit(1.0), F.col("_n") / FIELDS), "authority": F.col("_a"), "confidence": F.greatest(F.lit(0.0), F.col("_raw")),
        "application": F.col("applicationUrl").isNotNull().cast("int"), "deadline": (F.col("deadline.kind") != "UNKNOWN").cast("int"),
    }
    quality = sum((QUALITY[k] * v for k, v in useful.items()), F.lit(0.0))
    return step.withColumns({"confidence": F.round(clamp(F.col("_raw")), 3), "qualityScore": F.round(clamp(quality), 3), "fieldsExtracted": F.col("_n")}).drop("_a", "_n", "_raw")


def merged_flag(rule: Column, other: Column) -> Column:
    """struct(value, certainty, confidence, disagrees) of a rule's and a second reading's flag (value, certainty, confidence).

    The second reading fills gaps and raises confidence where both agree; where they
    disagree the rule's value stays, is only probable, and the disagreement is told.
    """
    a, b = rule["value"], other["value"]
    told = lambda value, certainty, confidence, no: F.struct(value.alias("value"), certainty.alias("certainty"), confidence.cast("double").alias("confidence"), F.lit(no).alias("disagrees"))
    return (
        F.when(a.isNull() & b.isNotNull(), told(b, other["certainty"], other["confidence"], False)).when(b.isNull(), told(a, rule["certainty"], rule["confidence"], False))
        .when(a == b, told(a, rule["certainty"], F.greatest(rule["confidence"], other["confidence"]), False))
        .otherwise(told(a, F.lit("PROBABLE"), F.least(rule["confidence"], F.lit(0.5)), True))
    )


def merged_list(rule: Column, other: Column) -> Column:
    """The union of both lists; a stated value is never replaced, UNKNOWN is."""
    known = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x != "UNKNOWN")
    return F.array_union(known(rule), known(other))


def vetoed(confidence: Column, is_award: Column, certainty: Column) -> Column:
    """A confident second reading that it is no award caps the confidence."""
    return F.when(~is_award & (certainty > 0.7), F.least(confidence, F.lit(0.25))).otherwise(confidence)


def gated(d: DataFrame, now: datetime) -> DataFrame:
    """Adds outcome and reason: FAILED past the deadline, NOT_SCHOLARSHIP with fewer than two kinds of evidence, else OK."""
    past = F.coalesce(F.col("deadline.date") < F.lit(now), F.lit(False))
    kinds = [F.col("funding.primaryType") != "UNKNOWN", F.col("eligibility.scope") != "UNKNOWN", F.col("deadline.kind") != "UNKNOWN", F.col("applicationUrl").isNotNull()]
    n = sum((F.coalesce(k, F.lit(False)).cast("int") for k in kinds), F.lit(0))
    outcome = F.when(past, "FAILED").when(n < 2, "NOT_SCHOLARSHIP").otherwise("OK")
    reason = F.when(past, "deadline has passed").when(n < 2, F.concat(F.lit("insufficient extracted evidence ("), n.cast("string"), F.lit("/4 classes)")))
    return d.withColumns({"outcome": outcome, "reason": reason})


def merged_away(sources: DataFrame, records: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sources and records after merges (loser, winner): sources move to the winner, losers become REPLACED and say by which."""
    moved = sources.join(merges, sources["record_id"] == merges["loser"], "left").withColumn("record_id", F.coalesce("winner", "record_id")).drop("loser", "winner")
    kept = records.join(merges, records["record_id"] == merges["loser"], "left")
    kept = kept.withColumns({"status": F.when(F.col("loser").isNotNull(), "REPLACED").otherwise(F.col("status")), "replacedBy": F.col("winner")}).drop("loser", "winner")
    return moved, kept
