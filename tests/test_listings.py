"""Listings on literal pages."""

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewater.functions import notices
from tidewater.functions.patterns import dealt
from tidewater.sources import listings as L
from tidewater.sources.pages import parse_html

NOW = datetime(2026, 4, 1)


def test_phases(spark):
    pages = spark.createDataFrame([
        ("https://a.org/careers", '<a href="/careers/1">Credit Officer</a><a href="/careers/1?ref=x">credit officer</a><a href="#top">Officer</a><a href="mailto:x">Officer</a><a href="/jobs/hub">Vacancies</a>'),
        ("https://a.org/jobs/hub", '<a href="/careers/1">Credit Officer</a><li>Kisumu <a href="/careers/2">11/05/2026 Risk Analyst Apply Now</a></li>'),
        ("https://b.org/jobs", '<script>[{"title":"Head of IT","jobType":"a","status":true,"id":77,"createdAt":1},{"title":"HEAD  OF it","jobType":"a"},{"title":"Clerk","page":1},{"title":"Old Clerk","deadline":"2025-01-01","jobType":1}]</script>'),
        ("https://c.org/careers", '<div><b>Branch Manager</b> Deadline: Jul 8, 2026<p>x <a href="apply">go</a></p></div><div><h2>Past Manager</h2>Closes on 1st Feb 2026 <a href="b">b</a></div><h3>Our Manager</h3><td>Senior Teller</td><img alt="Data Engineer">'),
        ("https://d.org/", None),
    ], "url string, html string")
    sources = spark.createDataFrame([("a", "https://a.org/careers/", None), ("b", "https://b.org/jobs?x=1#y", None), ("b", None, None), ("c", "https://c.org/careers", None), ("d", "https://d.org", None), ("e", "https://e.org", None), ("f", "https://a.org/careers", "careers/2$")], "source string, url string, url_filter string")
    pages = pages.withColumn("url", F.when(F.col("url") == "https://b.org/jobs", "https://b.org/jobs?x=1").otherwise(F.col("url"))).repartition(3)
    got = [tuple(r) for r in L.scraped(sources, pages, NOW).orderBy("source", "rank").collect()]
    assert got == [
        ("a", 1, "Credit Officer", "https://a.org/careers/1", None, "anchor"), ("a", 2, "Risk Analyst", "https://a.org/careers/2", "Kisumu", "anchor"),
        ("b", 1, "Head of IT", "https://b.org/jobs/77", None, "embedded"),
        ("c", 1, "Branch Manager", "https://c.org/careers", None, "heading"),
        ("c", 2, "Data Engineer", "https://c.org/careers", None, "heading"), ("c", 3, "Senior Teller", "https://c.org/careers", None, "heading"),
        ("f", 1, "Risk Analyst", "https://a.org/careers/2", "Kisumu", "anchor"),
    ]
    assert L.scraped(sources.limit(0), pages, NOW).count() == 0 and L.scraped(sources, pages.limit(0), NOW).count() == 0


def test_tenders_past_their_row_date_go(spark):
    html = '<ul><li><a href="/tenders/1">Supply of desks</a> 13/01/2026 at 11</li><li><a href="/tenders/2">Supply of chairs</a> 13/05/2026</li><li><a href="/tenders/3">Supply of lamps</a></li></ul>'
    pages = spark.createDataFrame([("https://a.org/t", html)], "url string, html string")
    got = L.scraped(spark.createDataFrame([("a", "https://a.org/t")], "source string, url string"), pages, NOW, "tenders").collect()
    assert sorted(r["title"] for r in got) == ["Supply of chairs", "Supply of lamps"]


def test_hubs_and_rows_are_limited(spark):
    main = "".join(f'<a href="/vacancies/{i}">Vacancies</a>' for i in range(12))
    pages = [("https://a.org/careers", main)] + [(f"https://a.org/vacancies/{i}", "".join(f'<a href="/careers/{i}-{j}">Clerk {j}</a>' for j in range(9))) for i in range(12)]
    got = L.scraped(spark.createDataFrame([("a", "https://a.org/careers")], "source string, url string"), spark.createDataFrame(pages, "url string, html string"), NOW).orderBy("rank").collect()
    assert [r["url"] for r in got] == [f"https://a.org/careers/{i}-{j}" for i in range(8) for j in range(9)][:60]


@pytest.mark.parametrize("page", ["<div><a href=x>t" * 60_000, "<div><a href=x>" * 60_000, "<li><div> " * 60_000 + "<a href=x>t</a>", "<div><h2>x</h2><a href=x>" + "y" * 900_000])
def test_time_grows_with_the_page(page):
    begin = time.perf_counter()
    parser = L._Listing()
    parser.feed(page)
    parser.close()
    parser.parts()
    parse_html(page)
    assert time.perf_counter() - begin < 20


def test_a_page_is_a_row_for_each_part_and_dealt(spark):
    """So that judging a large page's anchors is the work of many tasks."""
    html = "".join(f'<li><a href="/careers/{i}">Clerk {i}</a> in Thika</li>' for i in range(25_000)) + "<h2>Open posts</h2>"
    parts = dealt(L.listing_parts(spark.createDataFrame([("a", "https://a.org/careers", html), ("b", "https://b.org", None)], "source string, url string, html string")))
    assert parts.columns == ["source", "url", *L.PARTS]
    assert parts.withColumn("task", F.spark_partition_id()).where(F.col("kind") == L.ANCHOR).agg(F.count("*"), F.count_distinct("pos"), F.count_distinct("task")).collect() == [(25_000, 25_000, 16)]
    assert [tuple(r) for r in parts.where(F.col("kind") != L.ANCHOR).collect()] == [("a", "https://a.org/careers", 0, 50_000, "Open posts", None, "", "")]


def test_pages_are_read_twice_and_links_judged_once(spark):
    """Once for the sources' pages and once for their hubs, whatever comes after; and each rule once a link."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def html(url):
        read.add(1)
        return '<a href="/jobs/hub">Vacancies</a>' if url.endswith("careers") else '<a href="/careers/2">Risk Analyst</a>'

    pages = spark.createDataFrame([("https://a.org/careers",), ("https://a.org/jobs/hub",)], "url string").withColumn("html", html("url"))
    sources = spark.createDataFrame([("a", "https://a.org/careers")], "source string, url string")
    assert [r["title"] for r in L.scraped(sources, pages, NOW).collect()] == ["Risk Analyst"]
    assert read.value <= 4
    plan = sources.where(notices.job_link(F.col("source"), F.col("url"), F.lit(""))["type"] == "posting")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("underwriters") == 1


def test_addresses_that_are_no_jobs(spark):
    rows = [("https://b.co.ke/careers/insurance/relationship-manager", "reject"), ("https://b.co.ke/careers/employee-stories/relationship-manager", "reject"), ("https://b.co.ke/jobs/awards/senior-officer", "reject"), ("https://b.co.ke:8443/jobs/x", "posting"), ("https://b.co.ke/careers/insurances", "posting"), (None, "reject")]
    frame = spark.createDataFrame(rows, "href string, want string")
    got = frame.select("want", notices.job_link(F.lit("Relationship Manager"), F.col("href"), F.lit(None).cast("string"))["type"].alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
