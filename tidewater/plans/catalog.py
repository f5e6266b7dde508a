"""The registered queries of the reference's operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans.session import prepare

FLAGSHIP = "agg1_facet_counts"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, by name, as tables or as streams of their files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        return self.spark.readStream.schema(self(name).schema).parquet(f"{self.sf_dir}/{name}.parquet*")  # a pattern, since a stream's path itself has to be a folder


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(Tables(spark, sf_dir))

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        _QUERIES[f.__name__] = run
        if sql is not None:
            _SQL[f.__name__] = sql
        return run

    return add


@query("select p_brand, count(*) as n from part where p_brand is not null group by 1 order by n desc, p_brand limit 60")
def agg1_facet_counts(t):
    """Counts of a facet without nulls, the 60 largest."""
    return t("part").where(F.col("p_brand").isNotNull()).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand").limit(60)


def _load() -> None:
    from tidewater.plans import draft_queries, listing_queries, record_queries, relational_queries, service_queries, stream_queries, text_queries  # noqa: F401  register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
