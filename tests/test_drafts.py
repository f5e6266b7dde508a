"""Literal cases of link classifiers, institutions and drafts."""

from datetime import datetime

from pyspark.sql import functions as F

from tidewater.functions import notices
from tidewater.operators import drafts, feedback
from tidewater.operators.filters import Search, text_search
from tidewater.sources.pages import needs_render


def kind(spark, function, text, href, context=""):
    return spark.range(1).select(function(F.lit(text), F.lit(href), F.lit(context)).alias("v")).first()["v"]["type"]


def test_jobs(spark):
    assert kind(spark, notices.job_link, "Loans Officer", "https://b.org/careers/1") == "posting"
    assert kind(spark, notices.job_link, "Personal Loans", "https://b.org/careers/1") == "reject"
    assert kind(spark, notices.job_link, "Internet Banking Officer", "https://b.org/careers/1") == "reject"
    assert kind(spark, notices.job_link, "Vacancies", "https://b.org/x") == "careers_page"
    assert kind(spark, notices.job_link, "Data Analyst", "https://ib.b.org/careers/") == "reject"


def test_tenders(spark):
    assert kind(spark, notices.tender_link, "Tender No. ABC/12/2026 closing 1 May", "https://a.org/x.pdf") == "posting"
    assert kind(spark, notices.tender_link, "Current Tenders", "https://a.org/tenders/") == "careers_page"
    assert kind(spark, notices.tender_link, "Contract award for tenders", "https://a.org/tenders/") == "reject"


def test_gate(spark):
    rows = spark.createDataFrame([("A studentship. Tuition fees are covered. The deadline is 1 March 2026.",), ("A studentship. Tuition fees are covered. The deadline is 1 May 2026.",), ("Nothing.",)], "text string")
    pages = rows.select(F.lit("u").alias("url"), F.lit("T").alias("title"), F.lit("").alias("meta"), F.array().cast("array<string>").alias("headings"), F.array().cast("array<struct<text:string,href:string,context:string>>").alias("links"), "text", F.lit(None).cast("string").alias("country"))
    now = datetime(2026, 4, 1)
    assert [r["outcome"] for r in drafts.gated(drafts.drafts(pages, now), now).collect()] == ["FAILED", "OK", "NOT_SCHOLARSHIP"]


def test_search_and_text(spark):
    rows = spark.createDataFrame([(1, "Grants for climate policy studies"), (2, "Policies of banks"), (3, None)], "id int, title string")
    found = lambda q: [r["id"] for r in rows.where(text_search([F.col("title")], q)).collect()]
    assert found('"climate policy"') == [1] and found("bank -policies") == [] and found("the of") == []
    assert Search(status="REPLACED").condition() is not None


def test_learning(spark):
    rows = [("APPROVED", ["a", "b"])] * 8 + [("REJECTED", ["c"])] * 8 + [("APPROVED", ["d"])] * 7
    got = {r["reason"]: r["weight"] for r in feedback.nudged_weights(spark.createDataFrame([("a", 1.49), ("e", 1.2)], "reason string, weight double"), spark.createDataFrame(rows, "decision string, reasons array<string>")).collect()}
    assert got == {"a": 1.5, "b": 1.04, "c": 0.96, "e": 1.2}


def test_render(spark):
    ask = lambda html, text: spark.range(1).select(needs_render(F.lit(html), F.lit(text)).alias("r")).first()["r"]
    assert ask("", "") and ask('<div id="root"></div>', "x" * 300) and not ask("<p>", "x" * 901) and ask("<p>", "x" * 10) and not ask("<p>", "x" * 300)
