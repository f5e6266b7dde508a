"""Merged drafts and validated answers, on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from tidewater.operators import contracts as V
from tidewater.operators import reconcile as R

FLAG = "struct<value:boolean,certainty:string,confidence:double,{}:string>"
LEFT = f"key long, description string, degreeLevels array<string>, funding struct<tuitionCovered:{FLAG.format('source_text')},primaryType:string,primaryTypeCertainty:string,types array<string>>, own string".replace("types array", "types:array")
RIGHT = f"key long, description string, degreeLevels array<string>, funding struct<tuitionCovered:{FLAG.format('evidence')},primaryType:string>, extra int"


def merged(spark, left, right):
    found = R.reconciled(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "key")
    assert found.columns == ["key", "description", "degreeLevels", "funding", "own", "method", "disagreements"]
    return {r["key"]: r for r in found.collect()}


def test_a_flag_is_filled_kept_or_doubted(spark):
    told = lambda value, by=0.9: (value, "CONFIRMED", by, "t")
    left = [(i, None, [], (told(v), "UNKNOWN", None, []), "o") for i, v in enumerate([None, True, True, False])]
    right = [(0, None, None, (told(True, 0.4), None), 1), (1, "", [], (told(True, 0.95), "sports"), 1), (2, "d", ["PHD"], (told(None), "two words"), 1), (3, "d", ["PHD"], (told(True), "GOVERNMENT"), 1)]
    got = merged(spark, left, right)
    flags = {i: tuple(r["funding"]["tuitionCovered"]) for i, r in got.items()}
    assert flags == {0: (True, "CONFIRMED", 0.4, "t"), 1: (True, "CONFIRMED", 0.95, "t"), 2: (True, "CONFIRMED", 0.9, "t"), 3: (False, "PROBABLE", 0.5, "t")}
    assert got[3]["disagreements"] == ["funding.tuitionCovered: rules=false ai=true"] and not any(got[i]["disagreements"] for i in (0, 1, 2))
    assert [got[i]["funding"]["primaryType"] for i in range(4)] == ["UNKNOWN", "SPORTS", "UNKNOWN", "GOVERNMENT"] and got[1]["funding"]["types"] == ["SPORTS"]
    assert got[2]["degreeLevels"] == ["PHD"] and got[1]["description"] is None and got[2]["description"] == "d"


def test_odd_drafts(spark):
    """No reading, null keys, null records, repeated keys, no rows."""
    flag = (None, None, None, None)
    left = [(1, "x", None, None, "o"), (None, "x", ["PHD"], (flag, "UNKNOWN", None, []), "o"), (2, None, None, (flag, "FULL", None, []), "o")]
    right = [(1, "y" * 90, ["PHD"], ((True, "PROBABLE", 0.3, "e"), "A"), 1), (None, "z", [], None, 1), (9, "z", [], None, 1)]
    got = merged(spark, left, right)
    assert (got[1]["method"], got[2]["method"], got[None]["method"]) == ("HYBRID", "RULES", "RULES")
    assert got[1]["funding"]["tuitionCovered"]["value"] is True and got[1]["degreeLevels"] == ["PHD"] and got[2]["funding"]["primaryType"] == "FULL" and got[2]["disagreements"] == []
    both = R.reconciled(spark.createDataFrame(left, LEFT), spark.createDataFrame(right + right[:1], RIGHT), "key")
    assert both.where("key = 1").count() == 2 and both.count() == 4
    assert R.reconciled(spark.createDataFrame([], LEFT), spark.createDataFrame(right, RIGHT), "key").count() == 0


def test_dates_and_documents(spark):
    left = "key long, deadline struct<kind:string,date:timestamp,additional_dates:array<timestamp>,certainty:string,confidence:double>, requirements struct<documents:array<struct<code:string,label:string,count:int>>>"
    right = "key long, deadline struct<kind:string,date:string,certainty:string,confidence:double>, requirements struct<documents:array<struct<code:string,label:string>>>"
    rows = spark.sql("select 1L as key, named_struct('kind', 'FIXED', 'date', timestamp'2026-05-01', 'additional_dates', array(), 'certainty', 'CONFIRMED', 'confidence', 0.9D) as deadline, named_struct('documents', array(named_struct('code', 'CV', 'label', 'a', 'count', 1))) as requirements").select(*(F.col(p.split(" ")[0]) for p in ("key", "deadline", "requirements")))
    a = spark.createDataFrame(rows.collect() + spark.sql("select 2L, named_struct('kind', 'UNKNOWN', 'date', null, 'additional_dates', null, 'certainty', 'UNKNOWN', 'confidence', 0.0D), null").collect(), left)
    b = spark.createDataFrame([(1, ("FIXED", "2026-05-02", "PROBABLE", 0.4), ([("CV", "b"), ("ID", "c")],)), (2, ("ROLLING", "no date", "PROBABLE", 0.4), ([("ID", "c")],))], right)
    got = {r["key"]: r for r in R.reconciled(a, b, "key").collect()}
    assert got[1]["disagreements"] == ["deadline.date: rules=2026-05-01 ai=2026-05-02"] and (got[1]["deadline"]["confidence"], got[1]["deadline"]["certainty"]) == (0.55, "PROBABLE")
    assert [tuple(d) for d in got[1]["requirements"]["documents"]] == [("CV", "a", 1), ("ID", "c", None)]
    assert (got[2]["deadline"]["kind"], got[2]["deadline"]["date"], got[2]["deadline"]["additional_dates"], got[2]["disagreements"]) == ("ROLLING", None, [], []) and got[2]["requirements"]["documents"][0]["code"] == "ID"


def reading():
    flag = lambda v=None: {"value": v, "confidence": 0.5, "certainty": "UNKNOWN", "evidence": None}
    test = {"required": None, "minScore": None, "detail": None, "waiverAvailable": None, "confidence": 0, "evidence": None}
    return {
        "isScholarship": True, "classificationConfidence": 1, "classificationReasons": ["a"], "title": None, "provider": None, "description": None, "degreeLevels": ["PHD"], "degreeEvidence": [], "fieldsOfStudy": [],
        "studyMode": ["UNKNOWN"], "attendance": [], "deliveryMode": [], "modeEvidence": [],
        "funding": {**{f: flag() for f in V.FUNDING_FLAGS}, "primaryType": None, "tuitionPercentage": flag(), "awardCount": flag(3), "stipendAmount": {"amount": 1.5, "currency": "EUR", "period": None, "originalText": None, "confidence": 0.2, "certainty": "PROBABLE"}},
        "eligibility": {"scope": "INTERNATIONAL", "scopeEvidence": None, "countries": ["KE"], "excludedCountries": [], "regions": [], "categories": [], "ageMin": flag(), "ageMax": flag()},
        "requirements": {
            "minimumDegree": flag("PHD"), "minimumGpa": flag(3.1), "gpaScale": flag(), "minimumGrade": flag("B"), "english": {**{t: test for t in ("ielts", "toefl", "pte", "duolingo")}, "anyTestRequired": None},
            "documents": [{"code": "CV", "label": "CV", "count": 1, "mandatory": None, "evidence": None}], "workExperienceRequired": flag(), "workExperienceYears": flag(), "supervisorRequired": flag(), "admissionOfferRequired": flag(),
        },
        "deadline": {"kind": "FIXED", "date": "2026-05-01", "originalText": None, "timezoneStated": None, "confidence": 0.5, "certainty": "CONFIRMED"},
        "applicationUrl": flag("https://a.org"), "academicYear": None, "intake": None, "duration": None,
    }


def test_the_contract_of_a_reading(spark):
    """A valid reading, and one change each."""
    cases = {(): []}
    odd = {
        ("deadline", "date"): ("1999-01-01", ["deadline.date year out of range: 1999"]), ("eligibility", "countries"): (["ke", "KEN"], ["eligibility.countries.1: not 2 long"]),
        ("eligibility", "excludedCountries"): (["k1"], ['eligibility: "k1" is not an ISO-3166 alpha-2 code']), ("funding", "visaSupport", "value"): (True, ["asserted without evidence: funding.visaSupport"]),
        ("requirements", "english", "ielts"): ({"required": 1}, [f"requirements.english.ielts.{m}: missing" if m != "required" else "requirements.english.ielts.required: expected boolean, got number" for m in ("required", "minScore", "detail", "waiverAvailable", "confidence", "evidence")]),
        ("requirements", "documents"): ([{"code": "CV", "label": 5, "count": None, "mandatory": True, "evidence": None, "x": 1}], ["requirements.documents.0.label: expected string, got number", "requirements.documents.0: unknown keys x"]),
        ("degreeLevels",): (None, ["degreeLevels: must not be null"]), ("funding",): ([1], ["funding: expected object, got array"]), ("isScholarship",): ({"a": "b"}, ["isScholarship: expected boolean, got object"]),
        ("classificationConfidence",): (-0.5, ["classificationConfidence: less than 0"]), ("title",): ("x", ["title: shorter than 2"]), ("studyMode",): (["ON_CAMPUS", "MOON"], ["studyMode.1: not one of the known values"]),
    }
    rows = [(json.dumps(reading()), [])]
    for path, (value, want) in odd.items():
        changed = reading()
        at = changed
        for p in path[:-1]:
            at = at[p]
        at[path[-1]] = value
        rows.append((json.dumps(changed), want))
    rows.append((json.dumps({}), [f"{k}: missing" for k in list(V.READING.of)][:20]))
    frame = spark.createDataFrame(rows, "raw string, want array<string>")
    got = V.validated(frame, "raw", V.READING, V.READING_CHECKS).collect()
    assert len(cases) == 1 and [r["errors"] for r in got] == [r["want"] for r in got]


@pytest.mark.parametrize(("raw", "want"), [
    (None, "empty response"), ("  ", "empty response"), ("none", "no JSON object found"), ("} {", "no JSON object found"), ("{x}", "JSON parse failed"), ('{"a":1} {"a":2}', "JSON parse failed"), ('{"a":1},{"a":2}', "JSON parse failed"),
    ('see ```json\n{"a": 1}\n``` or {"a": "b"}', ""), ("```\n{\"a\": 2}\n```", ""), ('ok: {"a": 1e2} .', ""), ('{"a": "\\u007d"}', "a: expected number, got string"), ('{"a": true, "it\'s": {}}', "a: expected number, got boolean; answer: unknown keys it's"),
])
def test_answers(spark, raw, want):
    row = V.validated(spark.createDataFrame([(raw, 1)], "raw string, errors int"), "raw", V.Record(of={"a": V.Number()})).first()
    assert "; ".join(row["errors"]) == want and (row["answer"] is None) == bool(want)
