"""Literal cases of the column functions, with values of our own."""

import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewater.functions import classify, dates, extract, money, places, text, urls
from tidewater.operators import lifecycle, relational
from tidewater.operators.matching import Profile, match
from tidewater.sources import pages, sheets
from tidewater.streaming.state import penalty_ms


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (_, t) in values.items()) or "x int"
    frame = spark.createDataFrame([tuple(v for v, _ in values.values()) or (1,)], schema)
    return frame.select(column.alias("r")).first()["r"]


def said(spark, function, value):
    return one(spark, function(F.col("t")), t=(value, "string"))


@pytest.mark.parametrize(
    "raw, key",
    [
        ("http://WWW.Uni.edu/Awards/?utm_source=a&id=2&b=1#top", "https://uni.edu/Awards?b=1&id=2"),
        ("https://uni.edu/", "https://uni.edu/"),
        ("https://uni.edu/a/?ref=x", "https://uni.edu/a"),
        (" no url ", "no url"),
        (None, ""),
    ],
)
def test_canonical_url(spark, raw, key):
    assert said(spark, urls.canonical_url, raw) == key
    assert said(spark, urls.canonical_url, key) == key


@pytest.mark.parametrize(
    "href, url",
    [
        ("../b?x=1", "https://a.org/d/b?x=1"), ("/r", "https://a.org/r"), ("?q", "https://a.org/d/e/f?q"), ("g", "https://a.org/d/e/g"), ("//h/x", "https://h/x"),
        ("mailto:a@b", None), ("#x", None), ("ftp://x/y", None), ("", None),
    ],
)
def test_resolve_url(spark, href, url):
    assert one(spark, urls.resolve_url(F.col("h"), F.lit("https://a.org/d/e/f")), h=(href, "string")) == url


def test_title_key(spark):
    assert said(spark, text.title_key, "The Harbour Scholarships (2027/28) — Master's") == said(spark, text.title_key, "Harbour Scholarship 2027-2028 Masters")
    assert said(spark, text.title_key, "Campus Business Studies") == "campus business study"
    assert said(spark, text.title_key, None) == ""


def test_content_hash_ignores_case_and_space(spark):
    assert said(spark, text.content_hash, "A  b\nC") == said(spark, text.content_hash, " a b c ")


def test_accents_do_not_hide_ascii_edges(spark):
    assert said(spark, lambda c: c.rlike(classify.STRONG), "éscholarshipé") is True


@pytest.mark.parametrize(
    "value, country, day, confidence",
    [
        ("15th of March, 2027", None, datetime(2027, 3, 15), 0.95), ("Jun 3 2026", None, datetime(2026, 6, 3), 0.95), ("2026-02-28", None, datetime(2026, 2, 28), 0.95),
        ("31 February 2027", None, None, None), ("25/12/26", None, datetime(2026, 12, 25), 0.9), ("05/01/2027", "US", datetime(2027, 5, 1), 0.55),
        ("05/01/2027", "KE", datetime(2027, 1, 5), 0.55), ("1 May 1985", None, None, None), (None, None, None, None),
    ],
)
def test_parse_date(spark, value, country, day, confidence):
    got = one(spark, dates.parse_date(F.col("t"), F.col("c")), t=(value, "string"), c=(country, "string"))
    assert (got and got["date"].date()) == (day and day.date())
    assert (got and got["confidence"]) == confidence


@pytest.mark.parametrize(
    "value, kind, date",
    [
        ("Apply by 3 May 2027 at 5:30 pm EAT.", "FIXED", datetime(2027, 5, 3, 17, 30)), ("Applications are accepted all year.", "ROLLING", None),
        ("Round 1 deadline: 1 March 2026. Round 2 deadline: 30 June 2026.", "MULTIPLE_ROUNDS", datetime(2026, 6, 30, 23, 59, 59, 999000)),
        ("Term starts on 1 June 2026.", "FIXED", datetime(2026, 6, 1, 23, 59, 59, 999000)), ("", "UNKNOWN", None), (None, "UNKNOWN", None),
    ],
)
def test_deadline(spark, value, kind, date):
    frame = spark.createDataFrame([(value, None)], "t string, c string")
    got = dates.with_deadline(frame, "t", "c", datetime(2026, 4, 1)).first()["deadline"]
    assert (got["kind"], got["date"]) == (kind, date)


@pytest.mark.parametrize(
    "value, amount, currency, period",
    [
        ("about £18,622 per year", 18622.0, "GBP", "per year"), ("USD 5k monthly", 5000.0, "USD", "monthly"), ("2.5 million", 2500000.0, None, None),
        ("since 1987 EUR", 1987.0, "EUR", None), ("for 1500 CHF", 1500.0, None, None), ("ten", None, None, None),
    ],
)
def test_money(spark, value, amount, currency, period):
    got = said(spark, money.parse_money, value)
    assert (got and (got["amount"], got["currency"], got["period"])) == ((amount, currency, period) if amount else None)


STATUS = [
    ("FIXED", 0, 0.9, None, "CLOSING_SOON"), ("FIXED", 14, 0.9, None, "CLOSING_SOON"), ("FIXED", 15, 0.9, None, "OPEN"), ("FIXED", 365, 0.9, None, "OPEN"), ("FIXED", 366, 0.9, None, "UPCOMING"),
    ("FIXED", -1, 0.9, None, "CLOSED"), ("FIXED", -120, 0.9, None, "CLOSED"), ("FIXED", -121, 0.9, None, "EXPIRED"), ("ROLLING", None, 0.9, None, "OPEN"), ("UNKNOWN", None, 0.9, "APPROVED", "VERIFIED"),
    ("UNKNOWN", None, 0.9, None, "DISCOVERED"), ("FIXED", 30, 0.3, None, "UNDER_REVIEW"), ("FIXED", 30, 0.3, "APPROVED", "VERIFIED"), ("FIXED", 30, 0.9, "REJECTED", "CLOSED"),
]


@pytest.mark.parametrize("kind, days, confidence, review, want", STATUS)
def test_status(spark, kind, days, confidence, review, want):
    now = datetime(2026, 1, 10, 12)
    due = F.lit(now) + F.make_dt_interval(F.lit(days)) if days is not None else F.lit(None).cast("timestamp")
    got = one(spark, lifecycle.status(F.lit(kind), due, F.lit(confidence), F.lit(review).cast("string"), F.lit(None).cast("string"), now))
    assert got == want


def test_changes_leave_out_losses_and_equal_days(spark):
    schema = "id int, title string, deadline struct<date: timestamp, kind: string>, degreeLevels array<string>"
    old = spark.createDataFrame([(1, "A", (datetime(2027, 1, 15, 23, 59), "FIXED"), ["MASTERS", "PHD"])], schema)
    assert lifecycle.changes(old, old, "id").count() == 0
    new = spark.createDataFrame([(1, "B", (datetime(2027, 1, 15, 12), "UNKNOWN"), ["PHD", "MASTERS"])], schema)
    assert [(r["field"], r["significance"]) for r in lifecycle.changes(old, new, "id").collect()] == [("title", "MINOR")]


def test_fingerprint_ignores_order_of_degrees(spark):
    key = lambda *d: one(spark, lifecycle.record_fingerprint(F.lit("u"), F.lit("k"), F.lit("2027/28"), F.array(*map(F.lit, d)), F.lit(None).cast("string")))
    assert key("PHD", "MASTERS") == key("MASTERS", "PHD") != key("PHD")


def test_extraction(spark):
    page = "The Masters Scholarship is open to citizens of Kenya. Applicants must hold a Bachelor degree. Tuition fees are covered; a stipend may be paid. Accommodation is not included."
    frame = spark.createDataFrame([(page,), (None,)], "t string")
    rows = extract.with_eligibility(extract.with_funding(extract.with_degree_levels(frame, "t"), "t"), "t").collect()
    got, none = rows
    assert (got["degree"]["levels"], got["degree"]["prerequisite_levels"]) == (["MASTERS"], ["BACHELORS"])
    assert got["funding"]["tuitionCovered"]["value"] is True and got["funding"]["livingStipend"]["certainty"] == "PROBABLE"
    assert got["funding"]["accommodationCovered"]["value"] is False and got["funding"]["travelCovered"]["value"] is None
    assert got["eligibility"]["countries"] == ["KE"] and got["eligibility"]["scope"] == "SPECIFIC_COUNTRIES"
    assert none["funding"]["primaryType"] == "UNKNOWN" and none["eligibility"]["scope"] == "UNKNOWN" and none["degree"]["levels"] == []


def test_countries(spark):
    assert said(spark, places.countries_in, "South African or Kenyan citizens, not Chineseness") == ["ZA", "KE"]
    assert said(spark, places.country_code, "nationals of Ghana") == "GH"
    assert said(spark, places.country_code, "Atlantis") is None


def test_links(spark):
    kind = lambda t, h, c="": one(spark, classify.award_link(F.lit(t), F.lit(h), F.lit(c)))["type"]
    assert kind("Harbour Scholarship 2027", "/scholarships/harbour") == "scholarship"
    assert kind("Scholarships and funding", "/funding/") == "landing"
    assert kind("Donate to scholarships", "/x") == kind("Scholarship winners", "/news/x") == kind("", "/x") == "reject"


def test_match_caps_hard_failures(spark):
    frame = spark.createDataFrame([(["PHD"], 1.0), (["MASTERS"], 1.0), ([], 1.0)], "degreeLevels array<string>, confidence double")
    got = [(r["score"], r["eligible"], r["uncertain"]) for r in match(frame, Profile(degree_level="MASTERS")).collect()]
    assert got == [(0.0, False, False), (1.0, True, False), (0.45, True, True)]
    assert match(frame, Profile()).first()["score"] == 0.0


def test_stacked_periods_follow_the_sequential_rule(spark):
    import random

    random.seed(4)
    rows = sorted((u, random.randint(0, 60), random.randint(1, 9), i) for i, u in enumerate(random.choices("abc", k=60)))
    frame = spark.createDataFrame(rows, "u string, at long, days long, i long")
    got = {r["i"]: r["ends_at"] for r in relational.stacked_periods(frame, "u", "at", "days", ["at", "days", "i"]).collect()}
    end: dict[str, int] = {}
    for u, at, days, i in rows:
        end[u] = (end[u] if end.get(u, -1) > at else at) + days
        assert got[i] == end[u]


def test_csv_and_xlsx(spark):
    frame = spark.createDataFrame([(1, "=1+1", None), (2, 'a,"b"', datetime(2027, 1, 15))], "n int, s string, d timestamp")
    raw = sheets.csv_bytes(frame, [F.col("n")], ["N", "S", "D"])
    assert raw.decode("utf-8") == "﻿N,S,D\r\n1,'=1+1,\r\n2,\"a,\"\"b\"\"\",2027-01-15\r\n"
    book = zipfile.ZipFile(io.BytesIO(sheets.xlsx_bytes("Awards", ["N", "U", "D"], [(1, "https://a.org/?x=1&y=2", datetime(2027, 1, 15))], ["U"])))
    assert book.testzip() is None and b"<v>46402</v>" in book.read("xl/worksheets/sheet1.xml") and b"hyperlink" in book.read("xl/worksheets/_rels/sheet1.xml.rels")


def test_parse_html():
    got = pages.parse_html('<title>T</title><script>x</script><nav>menu</nav><h1>Head &amp; x</h1><p>Read <a href="/a">more</a> by May</p>')
    assert got["title"] == "T" and got["headings"] == ["Head & x"] and got["links"] == [{"text": "more", "href": "/a", "context": "Read more by May"}]
    assert "menu" not in got["text"] and "x" not in got["text"].split()[:1]
    assert pages.parse_html(None)["text"] == ""


def test_robots():
    rules = pages.robots_rules("bot/1", "User-agent: *\nDisallow: /\nUser-agent: bot\nAllow: /a\nDisallow:\n")
    assert rules == [(True, "/a")]


def test_penalty(spark):
    got = lambda *codes: one(spark, penalty_ms(F.array(*map(F.lit, codes))))
    assert (got(429, 503), got(500, 500), got(429, 200, 200), got(*[429] * 9), got(404)) == (10000.0, 3000.0, 1250.0, 300000.0, 0.0)


def test_packed_messages(spark):
    assert one(spark, sheets.packed_messages(F.array(*map(F.lit, ["aaa", "bb", "ccccccc"])), 8)) == ["aaa\n\nbb", "ccccccc"]


def test_every_country_name_leads_back_to_its_code(spark):
    from tidewater.functions import places as P

    names = [(code, term) for code, name, others, _ in P.COUNTRIES for term in (code, name, *others) if term.isascii()]
    rows = spark.createDataFrame(names, "code string, term string")
    got = rows.select("code", "term", P.country_code(F.col("term")).alias("direct"), P.countries_in(F.concat(F.lit("open to "), "term", F.lit(" applicants"))).alias("found")).collect()
    assert all(r["direct"] == r["code"] for r in got) and all(r["found"] == ([r["code"]] if len(r["term"]) >= 4 else []) for r in got if r["term"][-1].isalpha())
    assert "republic of" not in P.LOOKUP
