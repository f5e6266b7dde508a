"""Explainable matching of records with an applicant's profile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.places import nationality_verdict

#: What outcomes are worth, and how hard failures and confidence shade a score.
WORTH = {"PASS": 1.0, "WARN": 0.45, "FAIL": 0.0}
HARD_CAP, BASE, SHADE, NO_CONFIDENCE = 0.2, 0.7, 0.3, 0.7


@dataclass(frozen=True)
class Profile:
    """What an applicant has said; None is not said, and adds no criterion."""

    nationality: str | None = None
    degree_level: str | None = None
    field_of_study: str | None = None
    gpa: float | None = None
    gpa_scale: float = 4.0
    english_test: tuple[str, float] | None = None
    work_experience_years: float | None = None
    preferred_countries: tuple[str, ...] = ()
    study_mode: str | None = None
    attendance: str | None = None
    fully_funded_only: bool = False


def _criterion(key: str, outcome: Column, weight: Column | int, hard: bool = False, when: Column | None = None) -> Column:
    weight = weight if isinstance(weight, Column) else F.lit(weight)
    made = F.struct(F.lit(key).alias("key"), outcome.alias("outcome"), F.lit(hard).alias("hard"), weight.cast("int").alias("weight"))
    return made if when is None else F.when(when, made)


def _pick(unknown: Column, ok: Column) -> Column:
    return F.when(unknown, "WARN").when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL")


def criteria(p: Profile) -> Column:
    """An array of struct(key, outcome, hard, weight), one for each criterion that applies to the record."""
    out = []
    listed = lambda name: F.coalesce(F.col(name), F.array().cast("array<string>"))
    if p.nationality:
        e = "eligibility."
        verdict = nationality_verdict(F.coalesce(F.col(e + "scope"), F.lit("UNKNOWN")), F.col(e + "countries"), F.col(e + "excludedCountries"), F.col(e + "regions"), F.lit(p.nationality), F.col("countryCode"))
        out.append(_criterion("nationality", F.when(verdict == "ELIGIBLE", "PASS").when(verdict == "NOT_ELIGIBLE", "FAIL").otherwise("WARN"), 3, True))
    if p.degree_level:
        out.append(_criterion("degree", _pick(F.size(listed("degreeLevels")) == 0, F.array_contains(listed("degreeLevels"), p.degree_level)), 3, True))
    if p.field_of_study:
        want = p.field_of_study.lower()
        hit = F.exists(listed("fieldsOfStudy"), lambda f: F.lower(f).contains(want) | F.lit(want).contains(F.lower(f)))
        out.append(_criterion("field", _pick(F.size(listed("fieldsOfStudy")) == 0, hit), 2))
    if p.fully_funded_only:
        kind = F.coalesce(F.col("funding.primaryType"), F.lit("UNKNOWN"))
        out.append(_criterion("funding", _pick(kind == "UNKNOWN", kind == "FULLY_FUNDED"), 2))
    for key, want, also in (("attendance", p.attendance, ["BOTH"]), ("studyMode", p.study_mode, [])):
        if want:
            modes = listed(key)
            unknown = F.coalesce(F.try_element_at(modes, F.lit(1)), F.lit("UNKNOWN")) == "UNKNOWN"
            out.append(_criterion(key, _pick(unknown, F.arrays_overlap(modes, F.array(*[F.lit(w) for w in [want, *also]]))), 1))
    if p.english_test:
        test = F.col(f"requirements.english.{p.english_test[0].lower()}")
        outcome = F.when(test["required"].isNull(), "WARN").when(~test["required"], "PASS").when(test["minScore"].isNull(), "WARN").when(test["minScore"] <= p.english_test[1], "PASS").otherwise("FAIL")
        out.append(_criterion("english", outcome, F.when(F.coalesce(test["required"] & test["minScore"].isNotNull(), F.lit(False)), 2).otherwise(1)))
    if p.gpa is not None:
        least, scale = F.col("requirements.minimumGpa.value"), F.coalesce(F.col("requirements.gpaScale.value"), F.lit(4.0))
        same = F.abs(scale - p.gpa_scale) < 0.01
        out.append(_criterion("gpa", F.when(~same, "WARN").when(least <= p.gpa, "PASS").otherwise("FAIL"), F.when(same, 2).otherwise(1), when=least.isNotNull()))
    if p.work_experience_years is not None:
        years = F.col("requirements.workExperienceYears.value")
        out.append(_criterion("experience", F.when(years <= p.work_experience_years, "PASS").otherwise("FAIL"), 1, when=years.isNotNull()))
    if p.preferred_countries:
        out.append(_criterion("destination", F.when(F.col("countryCode").isin(*p.preferred_countries), "PASS").otherwise("FAIL"), 1, when=F.col("countryCode").isNotNull()))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<struct<key:string,outcome:string,hard:boolean,weight:int>>")


def score_of(found: Column, confidence: Column) -> dict[str, Column]:
    """score (3 digits), percentage, eligible and uncertain from criteria. Without criteria the score is 0."""
    worth = lambda c: F.when(c["outcome"] == "PASS", WORTH["PASS"]).when(c["outcome"] == "WARN", WORTH["WARN"]).otherwise(WORTH["FAIL"])
    earned = F.aggregate(found, F.lit(0.0), lambda a, c: a + c["weight"] * worth(c))
    total = F.aggregate(found, F.lit(0), lambda a, c: a + c["weight"])
    barred = F.exists(found, lambda c: c["hard"] & (c["outcome"] == "FAIL"))
    plain = earned / F.greatest(total, F.lit(1))
    score = F.when(barred, F.least(plain, F.lit(HARD_CAP))).otherwise(plain) * (BASE + SHADE * F.coalesce(confidence, F.lit(NO_CONFIDENCE)))
    return {"score": F.round(score, 3), "percentage": F.round(score * 100).cast("int"), "eligible": ~barred, "uncertain": F.exists(found, lambda c: c["hard"] & (c["outcome"] == "WARN"))}


def match(records: DataFrame, profile: Profile) -> DataFrame:
    """records with criteria, score, percentage, eligible and uncertain."""
    found = records.withColumn("criteria", criteria(profile))
    return found.withColumns(score_of(F.col("criteria"), F.col("confidence")))


def rank(records: DataFrame, profile: Profile, key: str, quality: str = "qualityScore", candidates: int = 400, k: int = 20, least: float = 0.0, ineligible: bool = False) -> DataFrame:
    """The k best matches among the candidates of the highest quality, best first, ties by key."""
    best = records.orderBy(F.desc_nulls_last(quality), key).limit(candidates)
    scored = match(best, profile).where(F.col("score") >= least)
    return (scored if ineligible else scored.where("eligible")).orderBy(F.desc("score"), key).limit(k)


