"""Rows of equal inputs are worked on once."""

from datetime import datetime

from pyspark.sql import functions as F

from tidewater.functions import dates
from tidewater.functions.patterns import let, once_for_copies
from tidewater.operators import drafts


def test_once_for_copies(spark):
    worked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def heavy(text, more):
        worked.add(1)
        return f"{text}{more}"

    rows = [(i, [None, "", "a", "b"][i % 4], ["x", None] if i % 8 < 4 else []) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, text string, more array<string>").repartition(5)
    got = once_for_copies(df, ["text", "more"], lambda d: d.withColumn("made", heavy("text", "more"))).collect()
    assert sorted((r["id"], r["text"], r["more"], r["made"]) for r in got) == sorted(((i, t, m, f"{t}{m}") for i, t, m in rows), key=lambda r: r[0])
    assert worked.value == 8


def test_let(spark):
    assert spark.range(3).select(let(F.col("id") + 1, lambda x: x * x).alias("x")).collect() == [(1,), (4,), (9,)]


def test_deadlines_and_drafts_are_read_once_a_text(spark):
    """Heavy work stands behind an aggregate over the distinct texts."""
    now = datetime(2026, 4, 1)
    pages = spark.range(8).selectExpr("id", "'u' || id as url", "'Award' as title", "'' as meta", "array('Award') as headings", "cast(array() as array<struct<text:string,href:string,context:string>>) as links",
                                      "'Apply by ' || (id % 2 + 1) || ' May 2026. Tuition fees are covered.' as text", "'GB' as country")
    for made in (dates.with_deadline(pages, "text", "country", now), drafts.drafts(pages, now)):
        assert "Aggregate [" in made._jdf.queryExecution().optimizedPlan().toString()
        assert [(r["id"], r["deadline"]["date"].day) for r in made.orderBy("id").collect()] == [(i, i % 2 + 1) for i in range(8)]
