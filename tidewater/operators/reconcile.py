"""Merging two drafts of one record: the rules' reading stays, a second reading fills its gaps, and what they disagree on is told.

A spec is a tree of field rules, like the drafts' own schema. The merge walks the left draft's
schema: a field with a rule is merged, a nested spec is walked in turn, all other fields stay
as they are, and rules whose field the reading lacks do nothing. Everything is one projection
over one join; disagreements and downgrades come out of the same pass.

A rule is called with a path and both sides of a field and returns the merged column and notes
(null where there is nothing to tell). A group rule is called with both sides of the record
around it and returns several of its fields.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.text import title_key

#: Names of one thing on both sides.
_SAME = ({"source_text", "sourceText", "evidence"}, {"original_text", "originalText"}, {"timezone_stated", "timezoneStated"}, {"additional_dates", "additionalDates"})
#: What a struct says first; its other fields tell how sure that is.
_MAIN = ("value", "amount", "required")
#: Confidence after a disagreement, of a date, and of an address that only the second reading gives; sizes of texts and lists.
DOUBTED, DOUBTED_DATE, SECOND_HAND = 0.5, 0.55, 0.7
TITLE_LENGTHS, SHORT_DESCRIPTION, MOST_EVIDENCE, MOST_COUNTRIES = (4, 300), 80, 10, 60


@dataclass(frozen=True)
class Side:
    """A column with its type."""

    column: Column
    kind: T.DataType

    def names(self) -> list[str]:
        return self.kind.names if isinstance(self.kind, T.StructType) else []

    def at(self, name: str) -> Side | None:
        """A field, also under its other names."""
        known = next((same for same in _SAME if name in same), {name})
        found = next((n for n in self.names() if n == name), None) or next((n for n in self.names() if n in known), None)
        return Side(self.column[found], self.kind[found].dataType) if found else None

    def main(self) -> Side:
        """What a struct says, or the column itself."""
        return next((self.at(n) for n in _MAIN if n in self.names()), self)

    def as_(self, kind: T.DataType) -> Column:
        """The column in another type: fields by name, a struct's main value for a plain type, and a plain value as a struct's."""
        if isinstance(kind, T.StructType):
            own = [(f, self.at(f.name) or (self if not self.names() and f.name in _MAIN else None)) for f in kind.fields]
            return F.struct(*((side.as_(f.dataType) if side else F.lit(None).cast(f.dataType)).alias(f.name) for f, side in own))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and isinstance(self.kind, T.ArrayType):
            return F.transform(self.column, lambda x: Side(x, self.kind.elementType).as_(kind.elementType))
        return self.main().column.try_cast(kind)

    def changed(self, **values: Column) -> Column:
        """The struct with other values in those of these fields that it has; anything else unchanged."""
        out = self.column
        for name, value in values.items():
            if name in self.names():
                out = out.withField(name, value)
        return out


Notes = list[Column]
Rule = Callable[[str, Side, Side], tuple[Column, Notes]]
GroupRule = Callable[[str, Side, Side], tuple[dict[str, Column], Notes]]


@dataclass(frozen=True)
class Spec:
    """fields: rules and nested specs by name; groups: rules over several fields of this record."""

    fields: Mapping[str, Rule | Spec] = field(default_factory=dict)
    groups: Sequence[GroupRule] = ()


def _stated(side: Side) -> Column:
    """What is said, null for an empty text."""
    main = side.main()
    return F.nullif(main.column, F.lit("")) if isinstance(main.kind, T.StringType) else main.column


def _differ(path: str, a: Column, b: Column) -> Column:
    told = F.concat(F.lit(f"{path}: rules="), a.cast("string"), F.lit(" ai="), b.cast("string"))
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), told)


def fill(path: str, a: Side, b: Side) -> tuple[Column, Notes]:
    """What is missing comes from the reading, with all that goes with it."""
    return F.when(_stated(a).isNull() & _stated(b).isNotNull(), b.as_(a.kind)).otherwise(a.column), []


def flag(path: str, a: Side, b: Side) -> tuple[Column, Notes]:
    """Filled; on agreement the higher confidence; on disagreement the rules' value, only probable, and a note."""
    x, y = a.main().column, b.main().column
    sure, other = a.at("confidence"), b.at("confidence")
    higher = a.changed(confidence=F.greatest(sure.column, other.column)) if sure and other else a.column
    doubted = a.changed(certainty=F.lit("PROBABLE"), confidence=F.least(sure.column, F.lit(DOUBTED)) if sure else F.lit(DOUBTED))
    merged = F.when(x.isNull() & y.isNotNull(), b.as_(a.kind)).when(y.isNull(), a.column).when(x == y, higher).otherwise(doubted)
    return merged, [_differ(path, x, y)]


def test_score(path: str, a: Side, b: Side) -> tuple[Column, Notes]:
    """An admission test: filled as a whole; a missing score is filled where both agree that it is required; on disagreement less confidence and a note."""
    x, y, least = a.at("required").column, b.at("required").column, b.at("minScore")
    merged = F.when(x.isNull() & y.isNotNull(), b.as_(a.kind))
    if sure := a.at("confidence"):
        merged = merged.when(x != y, a.changed(confidence=F.least(sure.column, F.lit(DOUBTED))))
    if least is not None and (own := a.at("minScore")):
        merged = merged.when(x.eqNullSafe(y) & own.column.isNull(), a.changed(minScore=least.column.try_cast(own.kind)))
    return merged.otherwise(a.column), [_differ(f"{path}.required", x, y)]


def union(path: str, a: Side, b: Side, lower: bool = False) -> tuple[Column, Notes]:
    """Both lists without repeats, where the reading has any; lower: the reading's in lower case."""
    second = F.transform(b.column, F.lower) if lower else b.column
    return F.when(F.size(b.column) > 0, F.array_union(F.coalesce(a.column, F.array().cast(a.kind)), second.cast(a.kind))).otherwise(a.column), []


def union_lower(path: str, a: Side, b: Side) -> tuple[Column, Notes]:
    return union(path, a, b, lower=True)


def if_none(path: str, a: Side, b: Side) -> tuple[Column, Notes]:
    """The reading's list where the rules' is empty."""
    return F.when((F.coalesce(F.size(a.column), F.lit(0)) <= 0) & (F.size(b.column) > 0), b.as_(a.kind)).otherwise(a.column), []


def if_unknown(path: str, a: Side, b: Side) -> tuple[Column, Notes]:
    """A list that begins with UNKNOWN gives way to a reading that does not; a stated value is never replaced."""
    first = F.try_element_at(b.column, F.lit(1))
    return F.when((F.try_element_at(a.column, F.lit(1)) == "UNKNOWN") & first.isNotNull() & (first != "UNKNOWN"), b.as_(a.kind)).otherwise(a.column), []


def more_text(path: str, a: Side, b: Side) -> tuple[Column, Notes]:
    """The reading's text where the rules' is missing or short."""
    return F.when(F.nullif(b.column, F.lit("")).isNotNull() & (F.length(F.coalesce(a.column, F.lit(""))) < SHORT_DESCRIPTION), b.column).otherwise(a.column), []


def by_code(path: str, a: Side, b: Side) -> tuple[Column, Notes]:
    """A list of structs with a code: the reading's new codes come after the rules'."""
    mine = F.coalesce(a.column, F.array().cast(a.kind))
    codes = F.transform(mine, lambda x: x["code"])
    return F.when(F.size(b.column) > 0, F.concat(mine, F.filter(b.as_(a.kind), lambda x: ~F.array_contains(codes, x["code"])))).otherwise(a.column), []


def second_hand(path: str, a: Side, b: Side) -> tuple[Column, Notes]:
    """Filled, with bounded confidence."""
    told = b.as_(a.kind)
    if "confidence" in a.names() and b.at("confidence"):
        told = told.withField("confidence", F.least(b.at("confidence").column, F.lit(SECOND_HAND)))
    return F.when(_stated(a).isNull() & _stated(b).isNotNull(), told).otherwise(a.column), []


def due_date(path: str, a: Side, b: Side) -> tuple[Column, Notes]:
    """An unknown deadline is filled; of two different dates the rules' stays, only probable, with a note."""
    x, y = a.at("date").column, b.at("date").column
    parsed = y.try_cast("timestamp")
    told = b.as_(a.kind).withField("date", parsed.cast(a.at("date").kind))
    for more in ("additional_dates", "additionalDates"):
        if more in a.names():
            told = told.withField(more, F.array().cast(a.kind[more].dataType))
    filled = F.coalesce((a.at("kind").column == "UNKNOWN") & (b.at("kind").column != "UNKNOWN"), F.lit(False))
    differ = ~filled & x.isNotNull() & F.nullif(y.cast("string"), F.lit("")).isNotNull() & F.coalesce(parsed != x, F.lit(True))
    doubted = a.changed(certainty=F.lit("PROBABLE"), confidence=F.least(a.at("confidence").column, F.lit(DOUBTED_DATE)))
    note = F.when(differ, F.concat(F.lit(f"{path}.date: rules="), F.date_format(x, "yyyy-MM-dd"), F.lit(" ai="), y.cast("string")))
    return F.when(filled, told).when(differ, doubted).otherwise(a.column), [note]


def titles(path: str, a: Side, b: Side) -> tuple[dict[str, Column], Notes]:
    """A reading's title of a plausible length is better than the rules', which may hold the site's name."""
    better = F.when(F.length(b.at("title").column).between(*TITLE_LENGTHS), b.at("title").column)
    return {"award_title": F.coalesce(better, a.at("award_title").column), "normalizedTitle": F.when(better.isNotNull(), title_key(better)).otherwise(a.at("normalizedTitle").column)}, []


def levels(path: str, a: Side, b: Side) -> tuple[dict[str, Column], Notes]:
    """Levels are united, since a missing one is worse than one too many; their evidence is joined and bounded."""
    any_ = F.size(b.at("degreeLevels").column) > 0
    out = {"degreeLevels": union(path, a.at("degreeLevels"), b.at("degreeLevels"))[0]}
    if a.at("degreeEvidence") and b.at("degreeEvidence"):
        mine = a.at("degreeEvidence")
        out["degreeEvidence"] = F.when(any_, F.slice(F.concat(mine.column, b.at("degreeEvidence").as_(mine.kind)), 1, MOST_EVIDENCE)).otherwise(mine.column)
    return out, []


def primary_type(path: str, a: Side, b: Side) -> tuple[dict[str, Column], Notes]:
    """An unknown main kind of funding is filled, as probable, and joins the list of kinds."""
    told, mine, kinds = F.upper(b.at("primaryType").column), a.at("primaryType").column, a.at("types").column
    new = (mine == "UNKNOWN") & F.coalesce(told.rlike("^[A-Z_]+$"), F.lit(False))
    return {
        "primaryType": F.when(new, told).otherwise(mine), "primaryTypeCertainty": F.when(new, "PROBABLE").otherwise(a.at("primaryTypeCertainty").column),
        "types": F.when(new & ~F.array_contains(kinds, told), F.array_append(kinds, told)).otherwise(kinds),
    }, []


def scopes(path: str, a: Side, b: Side) -> tuple[dict[str, Column], Notes]:
    """Who may apply: an unknown scope is filled as probable, different ones are told; countries are taken only where the rules found none, so that no list grows."""
    mine, told, countries, others = a.at("scope").column, b.at("scope").column, a.at("countries").column, b.at("countries").column
    unknown, says = mine == "UNKNOWN", F.coalesce(told != "UNKNOWN", F.lit(False))
    take = (F.size(countries) == 0) & F.coalesce(F.size(others).between(1, MOST_COUNTRIES), F.lit(False))
    scope = F.when(unknown & says, told).when(unknown & take, "SPECIFIC_COUNTRIES").otherwise(mine)
    out = {"scope": scope, "scopeCertainty": F.when(says & (mine != told), "PROBABLE").otherwise(a.at("scopeCertainty").column), "countries": F.when(take, others).otherwise(countries)}
    for name in ("scopeSourceText", "scope_source_text"):
        if name in a.names() and b.at("scopeEvidence"):
            out[name] = F.when(unknown & says, b.at("scopeEvidence").column).otherwise(a.column[name])
    return out, [F.when(~unknown & says, _differ(f"{path}.scope", mine, told))]


FUNDING_FLAGS = "tuitionCovered livingStipend travelCovered airfareCovered accommodationCovered healthInsurance researchAllowance booksAllowance equipmentAllowance applicationFeeWaiver visaSupport".split()
AWARD = Spec(
    {
        "provider": fill, "description": more_text, "fieldsOfStudy": union_lower, "studyMode": if_unknown, "attendance": if_unknown, "deliveryMode": if_unknown,
        "funding": Spec({**{name: flag for name in FUNDING_FLAGS}, "stipendAmount": fill, "awardCount": fill}, [primary_type]),
        "eligibility": Spec({"excludedCountries": if_none, "regions": union, "categories": union}, [scopes]),
        "requirements": Spec({
            "minimumDegree": fill, "minimumGpa": fill, "minimumGrade": fill, "documents": by_code, "workExperienceRequired": flag, "supervisorRequired": flag, "admissionOfferRequired": flag,
            "english": Spec({"ielts": test_score, "toefl": test_score, "pte": test_score, "duolingo": test_score, "anyTestRequired": fill}),
        }),
        "deadline": due_date, "applicationUrl": second_hand, "academicYear": fill, "intake": fill, "duration": fill,
    },
    [titles, levels],
)
_GROUPS_READ = {titles: ("title",), levels: ("degreeLevels",), primary_type: ("primaryType",), scopes: ("scope", "countries")}


def merge(path: str, a: Side, b: Side, spec: Spec) -> tuple[dict[str, Column], Notes]:
    """All fields of a merged by the spec, and the notes."""
    out, notes = {n: a.column[n] for n in a.names()}, []
    for name, rule in spec.fields.items():
        mine, other = (a.at(name) if name in a.names() else None), b.at(name)
        if mine is None or other is None:
            continue
        own = f"{path}.{name}" if path else name
        if isinstance(rule, Spec):
            inner, told = merge(own, mine, other, rule)
            out[name] = F.struct(*(c.alias(n) for n, c in inner.items()))
        else:
            out[name], told = rule(own, mine, other)
        notes += told
    for rule in spec.groups:
        if all(b.at(n) for n in _GROUPS_READ.get(rule, ())):
            inner, told = rule(path, a, b)
            out |= {n: c for n, c in inner.items() if n in a.names()}
            notes += told
    return out, notes


def reconciled(rules: DataFrame, readings: DataFrame, key: str, spec: Spec = AWARD) -> DataFrame:
    """rules with its columns merged with those of readings, and method (HYBRID or RULES) and disagreements.

    Drafts without a reading, or with a null key, stay as they are. readings holds a key once;
    a key that repeats there gives a merged draft for each. Rows of readings without a draft are not used.
    """
    left = rules.select(F.struct(*rules.columns).alias("a"))
    right = readings.select(F.struct(*readings.columns).alias("b"))
    both = left.join(right, F.col("a")[key] == F.col("b")[key], "left")
    out, notes = merge("", Side(F.col("a"), left.schema["a"].dataType), Side(F.col("b"), right.schema["b"].dataType), spec)
    read = F.col("b").isNotNull()
    kept = [F.when(read, c).otherwise(F.col("a")[n]).alias(n) if n != key else F.col("a")[n].alias(n) for n, c in out.items()]
    told = F.when(read, F.array_compact(F.array(*notes))).otherwise(F.array().cast("array<string>"))
    return both.select(*kept, F.when(read, "HYBRID").otherwise("RULES").alias("method"), told.alias("disagreements"))
