"""Types in JSON-LD and crawl rules, on literal rows."""

import pytest
from pyspark.sql import functions as F

from tidewater.sources import crawl_rules as R
from tidewater.sources import pages as S


@pytest.mark.parametrize(("body", "want"), [
    ('{"@type": "A"}', ["A"]), ('[[[{"x": [{"y": {"@type": ["B", "A", "B"]}}]}]]]', ["A", "B"]), ('{"name": "\\"@type\\": \\"No\\"", "@type": "It\'s \\"q\\" [x]"}', ['It\'s "q" [x]']),
    ('{"@type": {"@type": "In"}, "b": {"@type": []}, "c": {"@type": ""}, "d": {"@type": null}}', ["In"]), ('{"@type": "A"', []), ("", []), (None, []), ("7", []), ('"@type"', []), ('{"\\u0040type": "U", "é": "x"}', ["U"]), ('{"a": "@type", "b": ":"}', []),
    ('{"a":' * 300 + '{"@type": "Deep"}' + "}" * 300, ["Deep"]), ('{"@type" : [ "X" , "Y" ] , "z" : 1e3}', ["X", "Y"]),
])
def test_types(spark, body, want):
    assert spark.createDataFrame([(body,)], "b string").select(S.json_types(F.col("b")).alias("t")).first()["t"] == want


def test_types_of_a_page(spark):
    html = '<script>{"@type":"No"}</script><script id=x type="application/ld+json" >{"@type":"B"}</script><script type="application/ld+json">{bad</script><SCRIPT TYPE=\'application/ld+json\'>\n[{"@type":"A"}]\n</SCRIPT >'
    rows = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(S.page_types(F.col("h")).alias("t")).collect()
    assert [r["t"] for r in rows] == [["A", "B"], [], []]


def test_rules_of_hosts(spark):
    bodies = [
        ("a.org", "User-agent: *\nDisallow: /\n\nUser-agent: bot\nUser-agent: other\nAllow: /x\nDisallow: /x\nDisallow: /y*z$\nDisallow: /p$q\nCrawl-delay: 1.5"), ("b.org", None), ("c.org", "User-agent: nobody\nDisallow: /"), ("d.org", "User-agent: *\nCrawl-delay: 100\nDisallow:"), (None, "User-agent: *\nDisallow: /"), ("e.org", "nonsense\nDisallow: /\nUSER-AGENT: *\ndisallow: /a.b?c"),
    ]
    want = {
        "https://a.org/x": True, "http://A.org:80/y1z": False, "https://a.org/y1z2": True, "https://a.org/p$q": False, "https://a.org/pq": True, "https://u:p@a.org/yz?a=z": False, "https://b.org/": True, "https://c.org/": True, "https://d.org/q": True, "https://e.org/a.b?c=1": False, "https://e.org/axb?c": True, "https://e.org": True,
        "https://none.org/": True, "no address": False, None: False,
    }
    urls = spark.createDataFrame([(u,) for u in want] * 2, "url string").repartition(3)
    got = R.robots_verdicts(urls, spark.createDataFrame(bodies, "host string, body string"), "Bot/2.0").collect()
    assert len(got) == len(want) and {r["url"]: r["allowed"] for r in got} == want
    delays = {r["url"]: r["delay_ms"] for r in got}
    assert delays["https://a.org/x"] == 1500 and delays["https://d.org/q"] == 60_000 and delays["https://b.org/"] is None
    assert {r["reason"] for r in got if not r["allowed"]} == {R.DISALLOWED, R.UNPARSEABLE}
    assert R.robots_verdicts(urls.limit(0), spark.createDataFrame(bodies, "host string, body string"), "Bot").count() == 0


def test_pages_are_held_in_slices(spark):
    import pandas as pd

    frame = pd.DataFrame({"page_id": range(1000)})
    parts = list(S.sliced(iter([frame, frame[:0], frame[:1]]), S.PAGES))
    assert max(map(len, parts)) == S.PAGES and [i for p in parts for i in p["page_id"]] == [*range(1000), 0]
    pages = spark.range(150).selectExpr("id as page_id", "'http://h/' as url", "concat('<a href=x', id, '>t</a>') as html").coalesce(1)
    assert {r["page_id"]: r["links"][0]["href"] for r in S.parsed_pages(pages).collect()} == {i: f"http://h/x{i}" for i in range(150)}


def test_first_h1_as_written(spark):
    pages = [(1, 'u', '<h2>no</h2>\n<h1>Le &quot;x&quot; <b>&amp;amp;</b> &amp</h1><h1>y</h1>'), (2, "u", "<p>none"), (3, "u", "<h1>open &lt"), (4, "u", None)]
    got = {r["page_id"]: r for r in S.parsed_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), written=True).collect()}
    assert [got[i]["h1"] for i in (1, 2, 3, 4)] == ["Le &quot;x&quot; <b>&amp;amp;</b> &amp", "", "open &lt", None]
    assert got[1]["headings"] == ["no", 'Le "x" &amp; &', "y"]


def test_heading_of_the_query_is_its_sql(spark, tmp_path):
    import duckdb

    from tidewater.plans import catalog

    pages = [(1, 'u', '<h1>token = &quot;77</h1><a href="/x">x</a>'), (2, "u", "<h1>a &amp; b &amp</h1>"), (3, "u", "<h1> &lt;c&gt; </h1>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = {tuple(r) for r in catalog.queries()["src2_parsed_pages"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(catalog.oracle_sql()["src2_parsed_pages"]).fetchall())
