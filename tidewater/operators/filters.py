"""Predicates that treat null and missing alike and never give null, and the search filter made of them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.enums import ATTENDANCE_MODES, DEGREE_LEVELS, FUNDING_TYPES, STATUSES, STUDY_MODES


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def equal(c: Column, value) -> Column:
    return c.eqNullSafe(F.lit(value))


def differs(c: Column, value) -> Column:
    """Not equal; null differs from every value."""
    return ~c.eqNullSafe(F.lit(value))


def one_of(c: Column, values: Iterable) -> Column:
    return _true(c.isin(*values))


def none_of(c: Column, values: Iterable) -> Column:
    """In none of the values; null is in none."""
    return ~_true(c.isin(*values))


def overlaps(array: Column, values: Sequence) -> Column:
    """The array holds any of the values; a null array holds none."""
    return _true(F.arrays_overlap(array, F.array(*[F.lit(v) for v in values])))


def has(array: Column, value) -> Column:
    return _true(F.array_contains(array, value))


def lacks(array: Column, value) -> Column:
    """The array does not hold the value; a null array passes."""
    return ~has(array, value)


def between(c: Column, low=None, high=None) -> Column:
    """low <= c <= high, either open; null is outside if there is a bound."""
    bounds = ([c >= F.lit(low)] if low is not None else []) + ([c <= F.lit(high)] if high is not None else [])
    return reduce(lambda a, b: a & b, [_true(b) for b in bounds], F.lit(True))


def defaulted(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def not_empty(array: Column) -> Column:
    """The array is not []; null passes, as only the empty list is excluded."""
    return F.coalesce(F.size(array) != 0, F.lit(True)) | array.isNull()


def matches(columns: Sequence[Column], pattern: str) -> Column:
    """Any of the columns holds a match of the pattern, whatever its case."""
    return reduce(lambda a, b: a | b, [_true(c.rlike(f"(?i){pattern}")) for c in columns])


def wanted_by(subscriber: str, record: str) -> Column:
    """Whether a record is open and fits a subscriber's preferences, as the condition of a join of the two aliases.

    An empty or null list of countries or degree levels, and no wish for full funding, exclude nothing.
    """
    s, r = lambda c: F.col(f"{subscriber}.{c}"), lambda c: F.col(f"{record}.{c}")
    all_of = lambda array: array.isNull() | (F.size(array) == 0)
    place = all_of(s("countries")) | _true(F.array_contains(s("countries"), r("countryCode")))
    level = all_of(s("degreeLevels")) | _true(F.arrays_overlap(s("degreeLevels"), r("degreeLevels")))
    return r("status").isin("OPEN", "CLOSING_SOON") & place & level & (~_true(s("fundingOnly")) | equal(r("funding.primaryType"), "FULLY_FUNDED"))


def open_to(targets: Column, context: str | None) -> Column:
    """Targeting: an empty or null list is everywhere, and an unknown context excludes nothing."""
    if context is None:
        return F.lit(True)
    return _true(F.size(targets) <= 0) | targets.isNull() | has(targets, context)


#: English words that a text search leaves out.
SEARCH_STOPWORDS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


def _stem(word: str) -> str:
    return re.sub(r"(?:ing|ed|es|s)$", "", word) if len(word) > 4 else word


def text_search(columns: Sequence[Column], query: str) -> Column:
    """Any word of the query in any column; "quoted phrases" must all be there, -words must not. Endings are cut (-s, -es, -ed, -ing) in place of stemming."""
    phrases = re.findall(r'"([^"]+)"', query)
    rest = re.sub(r'"[^"]*"', " ", query).lower().split()
    line = F.lower(F.concat_ws(" ", *columns))
    # documents are cut like queries: tokens of letters and digits, without their endings
    tokens = F.transform(F.split(line, "[^a-z0-9]+"), lambda w: F.when(F.length(w) > 4, F.regexp_replace(w, "(?:ing|ed|es|s)$", "")).otherwise(w))
    wanted = [_stem(w) for t in rest if not t.startswith("-") for w in re.findall("[a-z0-9]+", t) if w not in SEARCH_STOPWORDS]
    banned = [_stem(w) for t in rest if t.startswith("-") for w in re.findall("[a-z0-9]+", t)]
    found = overlaps(tokens, wanted) if wanted else F.lit(bool(phrases))
    for phrase in phrases:
        found = (found if wanted else F.lit(True)) & line.contains(phrase.lower())
    return found & ~overlaps(tokens, banned) if banned else found


def comma_list(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def truthy(text: str | None) -> bool:
    return (text or "").lower() in ("1", "true", "yes")


def _date(text: str | None) -> datetime | None:
    try:
        return datetime.fromisoformat(text) if text else None
    except ValueError:
        return None


@dataclass(frozen=True)
class Search:
    """A search request: comma lists as they come in; what is not in an enumeration is left out, invalid dates are ignored."""

    degree: str | None = None
    country: str | None = None
    university: str | None = None
    field: str | None = None
    funding: str | None = None
    fully_funded: str | None = None
    study_mode: str | None = None
    attendance: str | None = None
    nationality: str | None = None
    status: str | None = None
    deadline_after: str | None = None
    deadline_before: str | None = None
    min_confidence: float | None = None
    q: str | None = None
    text_columns: tuple[str, ...] = ("title", "description")

    def condition(self) -> Column:
        """The request as one predicate over records; every facet is an OR of its values, and all facets are ANDed."""
        upper = lambda text, known: [x.upper() for x in comma_list(text) if not known or x.upper() in known]
        parts = [differs(F.col("reviewStatus"), "REJECTED")]
        statuses = upper(self.status, STATUSES)
        parts.append(one_of(F.col("status"), statuses) if statuses else differs(F.col("status"), "REPLACED"))
        if degrees := upper(self.degree, DEGREE_LEVELS):
            parts.append(overlaps(F.col("degreeLevels"), degrees))
        if countries := upper(self.country, ()):
            parts.append(one_of(F.col("countryCode"), countries))
        if self.university:
            parts.append(equal(F.col("universityId"), self.university))
        if fields := [x.lower() for x in comma_list(self.field)]:
            parts.append(overlaps(F.col("fieldsOfStudy"), fields))
        if truthy(self.fully_funded):
            parts.append(equal(F.col("funding.primaryType"), "FULLY_FUNDED"))
        elif types := upper(self.funding, FUNDING_TYPES):
            parts.append(overlaps(F.col("funding.types"), types))
        if modes := upper(self.study_mode, STUDY_MODES):
            parts.append(overlaps(F.col("studyMode"), modes))
        if attendance := upper(self.attendance, ATTENDANCE_MODES):
            parts.append(overlaps(F.col("attendance"), [*attendance, "BOTH"]))
        if self.nationality:
            named = has(F.col("eligibility.countries"), self.nationality)
            wide = one_of(F.col("eligibility.scope"), ["INTERNATIONAL", "BOTH", "SPECIFIC_REGIONS"])
            parts.append((named | wide) & lacks(F.col("eligibility.excludedCountries"), self.nationality))
        parts.append(between(F.col("deadline.date"), _date(self.deadline_after), _date(self.deadline_before)))
        if self.min_confidence is not None:
            parts.append(between(F.col("confidence"), self.min_confidence))
        if self.q:
            parts.append(text_search([F.col(c) for c in self.text_columns], self.q))
        return reduce(lambda a, b: a & b, parts)


def nationality_match(countries: Column, scope: Column, nationality: str) -> Column:
    """How a record matched a nationality."""
    return (
        F.when(has(countries, nationality), "EXPLICIT").when(equal(scope, "BOTH"), "OPEN_TO_ALL")
        .when(equal(scope, "INTERNATIONAL"), "INTERNATIONAL_UNCONFIRMED").otherwise("REGION_OR_UNCONFIRMED")
    )


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20, most: int = 50, last: int = 500) -> DataFrame:
    """One page of the ordered rows: at most `most` rows, pages 1 to `last`. order must be total."""
    size = max(1, min(size, most))
    return df.orderBy(*order).offset((max(1, min(number, last)) - 1) * size).limit(size)


def capped_count(df: DataFrame, most: int) -> int:
    """min(count, most); Spark stops reading once it has most rows."""
    return df.limit(most).count()
