"""Validation of JSON answers against a declared contract, compiled to columns over VARIANT.

A contract is a tree of Text, Number, Boolean, Choice, List and Record nodes. Compiled, it gives
one array of "path: what is wrong" for each row: wrong and missing types, lengths, ranges, unknown
values, and keys that a record does not declare. Null and missing are different things, as in the
answers. Rules between fields run on answers that satisfy the contract. All of it is one SQL
expression of built-ins on one parsed value; a record is opened once, into a map.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import enums

MOST_ERRORS = 20
#: JSON's names of the types that Spark tells of a value; all others are numbers.
_KINDS = {"VOID": "null", "BOOLEAN": "boolean", "STRING": "string"}
_NONE = "cast(array() as array<string>)"


@dataclass(frozen=True)
class Var:
    """A lambda variable inside a path."""

    name: str


Path = tuple[str | Var, ...]


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _told(path: Path, *what: str | Var) -> str:
    """An array of one error, as SQL."""
    parts = ["answer" if not path else "", *(x for p in path for x in (".", p))][0 if not path else 2 :] + [": ", *what]
    return f"array(concat({', '.join(x.name if isinstance(x, Var) else _quoted(x) for x in parts)}))"


def _let(value: str, name: str, use: str) -> str:
    """use, in which name stands for value, which is worked out once."""
    return f"transform(array({value}), {name} -> {use})[0]"


def _kind(told: str) -> str:
    """JSON's name of a type that schema_of_variant tells."""
    cases = " ".join(f"when {told} = '{k}' then '{name}'" for k, name in _KINDS.items())
    return f"case {cases} when {told} like 'OBJECT%' then 'object' when {told} like 'ARRAY%' then 'array' else 'number' end"


@dataclass(frozen=True)
class Node:
    """null: whether null is allowed. sql() gives the array of errors of value, an SQL expression of a VARIANT; depth keeps names of nested variables apart."""

    null: bool = False

    def sql(self, value: str, path: Path, depth: int = 0) -> str:
        raise NotImplementedError

    def _absent(self, told: str, path: Path) -> str:
        """The cases of a missing and of a null value."""
        return f"when {told} is null then {_told(path, 'missing')} when {told} = 'VOID' then {_NONE if self.null else _told(path, 'must not be null')}"

    def _plain(self, value: str, path: Path, depth: int, kind: str, *checks: tuple[str, str]) -> str:
        """Of a plain value: its type, else the first check that holds; a check reads the variable in braces."""
        v = f"p{depth}"
        own = _kind(f"{v}.told")
        cases = " ".join(f"when {check.format(f'{v}.v')} then {_told(path, what)}" for check, what in checks)
        use = f"case {self._absent(f'{v}.told', path)} when {own} <> '{kind}' then {_told(path, f'expected {kind}, got ', Var(own))} {cases} else {_NONE} end"
        return _let(f"named_struct('v', {value}, 'told', schema_of_variant({value}))", v, use)

    def _nested(self, value: str, path: Path, kind: str, type_: str, name: str, use: str) -> str:
        told = f"schema_of_variant({value})"
        odd = f"case {self._absent(told, path)} else {_told(path, f'expected {kind}, got ', Var(_kind(told)))} end"
        return _let(f"try_variant_get({value}, '$', '{type_}')", name, f"case when {name} is null then {odd} else {use} end")


@dataclass(frozen=True)
class Text(Node):
    most: int | None = None
    least: int = 0
    length: int | None = None

    def sql(self, value, path, depth=0):
        size = "length(try_variant_get({0}, '$', 'string'))"
        checks = [(f"{size} < {self.least}", f"shorter than {self.least}")] if self.least else []
        checks += [(f"{size} > {self.most}", f"longer than {self.most}")] if self.most is not None else []
        checks += [(f"{size} <> {self.length}", f"not {self.length} long")] if self.length is not None else []
        return self._plain(value, path, depth, "string", *checks)


@dataclass(frozen=True)
class Number(Node):
    low: float | None = None
    high: float | None = None

    def sql(self, value, path, depth=0):
        n = "try_variant_get({0}, '$', 'double')"
        checks = [(f"{n} < {self.low}", f"less than {self.low:g}")] if self.low is not None else []
        checks += [(f"{n} > {self.high}", f"more than {self.high:g}")] if self.high is not None else []
        return self._plain(value, path, depth, "number", *checks)


@dataclass(frozen=True)
class Boolean(Node):
    def sql(self, value, path, depth=0):
        return self._plain(value, path, depth, "boolean")


@dataclass(frozen=True)
class Choice(Node):
    of: Sequence[str] = ()

    def sql(self, value, path, depth=0):
        known = ", ".join(map(_quoted, self.of))
        return self._plain(value, path, depth, "string", (f"try_variant_get({{0}}, '$', 'string') not in ({known})", "not one of the known values"))


@dataclass(frozen=True)
class List(Node):
    item: Node = field(default_factory=Text)
    most: int | None = None

    def sql(self, value, path, depth=0):
        items, x, i = f"l{depth}", f"x{depth}", f"i{depth}"
        each = f"flatten(transform({items}, ({x}, {i}) -> {self.item.sql(x, (*path, Var(i)), depth + 1)}))"
        if self.most is not None:
            each = f"concat(case when size({items}) > {self.most} then {_told(path, f'more than {self.most} items')} else {_NONE} end, {each})"
        return self._nested(value, path, "array", "array<variant>", items, each)


@dataclass(frozen=True)
class Record(Node):
    """An object with these keys and no others."""

    of: Mapping[str, Node] = field(default_factory=dict)

    def sql(self, value, path, depth=0):
        m, extra = f"m{depth}", f"e{depth}"
        inside = [node.sql(f"try_element_at({m}, {_quoted(name)})", (*path, name), depth + 1) for name, node in self.of.items()]
        names = ", ".join(map(_quoted, self.of))
        more = _let(f"array_sort(array_except(map_keys({m}), array({names})))", extra, f"case when size({extra}) > 0 then {_told(path, 'unknown keys ', Var(f'array_join({extra}, {_quoted(', ')})'))} else {_NONE} end")
        return self._nested(value, path, "object", "map<string,variant>", m, f"concat({', '.join([*inside, more])})")


def json_body(raw: Column) -> Column:
    """The JSON object in an answer: inside a Markdown fence if there is one, without what stands before the first { and after the last }; null if there is none."""
    text = F.trim(raw)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    inner = F.when(text.rlike(r"(?s)```(?:json)?\s*.*?```"), fenced).otherwise(text)
    return F.nullif(F.regexp_extract(inner, r"(?s)(\{.*\})", 1), F.lit(""))


Check = Callable[[Column], Column]


def validated(df: DataFrame, column: str, contract: Record, checks: Sequence[Check] = ()) -> DataFrame:
    """df with answer (variant; null unless it is valid) and errors (array<string>, at most MOST_ERRORS of the contract; empty for a valid answer).

    Null and blank answers, answers without an object and broken JSON have one error each.
    checks map the parsed answer to an array of errors (nulls are left out); they run only
    on answers that satisfy the contract.
    """
    raw = F.col(column).cast("string")
    step = df.withColumn("_body", json_body(raw))
    # in brackets, so that a second value after the first is an error too
    step = step.withColumn("_list", F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), "_body", F.lit("]"))), "$", "array<variant>"))
    step = step.withColumn("answer", F.when(F.size("_list") == 1, F.try_element_at("_list", F.lit(1))))
    step = step.withColumn("_own", F.slice(F.expr(contract.sql("answer", ())), 1, MOST_ERRORS))
    between = F.concat(*(F.array_compact(check(F.col("answer"))) for check in checks)) if checks else F.expr(_NONE)
    found = (
        F.when(F.coalesce(F.trim(raw), F.lit("")) == "", F.array(F.lit("empty response"))).when(F.col("_body").isNull(), F.array(F.lit("no JSON object found")))
        .when(F.col("answer").isNull(), F.array(F.lit("JSON parse failed"))).when(F.size("_own") > 0, F.col("_own")).otherwise(between)
    )
    return step.withColumn("errors", found).withColumn("answer", F.when(F.size("errors") == 0, F.col("answer"))).drop("_body", "_list", "_own")


def real_date(path: str, first: int = 2000, last: int = 2100) -> Check:
    """A date text is a date, of a year from first to last."""

    def check(v: Column) -> Column:
        told = F.nullif(F.try_variant_get(v, f"$.{path}", "string"), F.lit(""))
        at = told.try_cast("timestamp")
        wrong = F.when(told.isNotNull() & at.isNull(), F.lit(f"{path} is not a valid ISO date")).when(~F.year(at).between(first, last), F.concat(F.lit(f"{path} year out of range: "), F.year(at).cast("string")))
        return F.array(wrong)

    return check


def upper_codes(prefix: str, *paths: str) -> Check:
    """Country codes are two letters A-Z."""

    def check(v: Column) -> Column:
        codes = F.concat(*(F.coalesce(F.try_variant_get(v, f"$.{p}", "array<string>"), F.expr(_NONE)) for p in paths))
        return F.transform(F.filter(codes, lambda x: ~x.rlike("^[A-Z]{2}$")), lambda x: F.concat(F.lit(f'{prefix}: "'), x, F.lit('" is not an ISO-3166 alpha-2 code')))

    return check


def no_list_with(scope: str, value: str, countries: str, most: int = 40) -> Check:
    """A scope for all is not told as a list of countries."""

    def check(v: Column) -> Column:
        n = F.size(F.coalesce(F.try_variant_get(v, f"$.{countries}", "array<string>"), F.expr(_NONE)))
        return F.array(F.when((F.try_variant_get(v, f"$.{scope}", "string") == value) & (n > most), F.lit(f"{scope}: {value} scope must not enumerate a country list")))

    return check


def told_with_evidence(record: str, flags: Sequence[str]) -> Check:
    """A flag that is true quotes its evidence."""

    def check(v: Column) -> Column:
        bare = F.array_compact(F.array(*(F.when(
            F.try_variant_get(v, f"$.{record}.{f}.value", "boolean") & (F.coalesce(F.try_variant_get(v, f"$.{record}.{f}.evidence", "string"), F.lit("")) == ""), F.lit(f"{record}.{f}")) for f in flags)))
        return F.array(F.when(F.size(bare) > 0, F.concat(F.lit("asserted without evidence: "), F.array_join(bare, ", "))))

    return check


#: How sure a field is, who may apply and kinds of deadlines; then the contract of a second reading with its bounds.
CERTAINTIES = ("CONFIRMED", "PROBABLE", "UNKNOWN", "NEGATIVE")
SCOPES = ("INTERNATIONAL", "DOMESTIC", "BOTH", "SPECIFIC_COUNTRIES", "SPECIFIC_REGIONS", "UNKNOWN")
DEADLINES = ("FIXED", "ROLLING", "MULTIPLE_ROUNDS", "UNKNOWN")
FUNDING_FLAGS = "tuitionCovered livingStipend travelCovered airfareCovered accommodationCovered healthInsurance researchAllowance booksAllowance equipmentAllowance applicationFeeWaiver visaSupport".split()


def _text(most: int) -> Text:
    return Text(null=True, most=most)


def _sure(value: Node, evidence: int = 1000) -> Record:
    return Record(of={"value": value, "confidence": Number(low=0, high=1), "certainty": Choice(of=CERTAINTIES), "evidence": _text(evidence)})


def _choices(values: Sequence[str], most: int) -> List:
    return List(item=Choice(of=values), most=most)


_FLAG, _NUMBER = _sure(Boolean(null=True)), _sure(Number(null=True))
_TEST = Record(of={"required": Boolean(null=True), "minScore": Number(null=True), "detail": _text(400), "waiverAvailable": Boolean(null=True), "confidence": Number(low=0, high=1), "evidence": _text(600)})
READING = Record(of={
    "isScholarship": Boolean(), "classificationConfidence": Number(low=0, high=1), "classificationReasons": List(item=Text(most=200), most=12),
    "title": Text(null=True, least=2, most=400), "provider": _text(200), "description": _text(2000),
    "degreeLevels": _choices(enums.DEGREE_LEVELS, 7), "degreeEvidence": List(item=Text(most=600), most=7), "fieldsOfStudy": List(item=Text(most=120), most=30),
    "studyMode": _choices(enums.STUDY_MODES, 5), "attendance": _choices(enums.ATTENDANCE_MODES, 4), "deliveryMode": _choices(enums.DELIVERY_MODES, 4), "modeEvidence": List(item=Text(most=600), most=6),
    "funding": Record(of={
        "primaryType": _text(40), **{f: _FLAG for f in FUNDING_FLAGS}, "tuitionPercentage": _NUMBER, "awardCount": _NUMBER,
        "stipendAmount": Record(of={"amount": Number(null=True), "currency": _text(8), "period": _text(60), "originalText": _text(600), "confidence": Number(low=0, high=1), "certainty": Choice(of=CERTAINTIES)}),
    }),
    "eligibility": Record(of={
        "scope": Choice(of=SCOPES), "scopeEvidence": _text(1000), "countries": List(item=Text(length=2), most=200), "excludedCountries": List(item=Text(length=2), most=200),
        "regions": List(item=Text(most=60), most=20), "categories": List(item=Text(most=80), most=20), "ageMin": _NUMBER, "ageMax": _NUMBER,
    }),
    "requirements": Record(of={
        "minimumDegree": _sure(Choice(null=True, of=enums.DEGREE_LEVELS)), "minimumGpa": _NUMBER, "gpaScale": _NUMBER, "minimumGrade": _sure(_text(1000)),
        "english": Record(of={**{t: _TEST for t in ("ielts", "toefl", "pte", "duolingo")}, "anyTestRequired": Boolean(null=True)}),
        "documents": List(item=Record(of={"code": Text(most=60), "label": Text(most=200), "count": Number(null=True), "mandatory": Boolean(null=True), "evidence": _text(600)}), most=30),
        "workExperienceRequired": _FLAG, "workExperienceYears": _NUMBER, "supervisorRequired": _FLAG, "admissionOfferRequired": _FLAG,
    }),
    "deadline": Record(of={"kind": Choice(of=DEADLINES), "date": _text(40), "originalText": _text(600), "timezoneStated": _text(20), "confidence": Number(low=0, high=1), "certainty": Choice(of=CERTAINTIES)}),
    "applicationUrl": _sure(_text(1000)), "academicYear": _text(40), "intake": _text(120), "duration": _text(120),
})
READING_CHECKS = (
    real_date("deadline.date"), no_list_with("eligibility.scope", "INTERNATIONAL", "eligibility.countries"), upper_codes("eligibility", "eligibility.countries", "eligibility.excludedCountries"), told_with_evidence("funding", FUNDING_FLAGS),
)
