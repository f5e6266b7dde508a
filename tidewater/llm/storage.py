"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset on a local master (tests).

    On a cluster each machine would write to its own disk, so there an error asks for the setting.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    It cuts the lineage: a lost executor costs its running tasks only, and later
    steps neither repeat Python work nor see rows in another partition order.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place_of(df: DataFrame, name: str) -> int:
    """The position of a column, found by Spark's rule for upper and lower case; an error if there is none or several."""
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    places = [i for i, c in enumerate(df.columns) if c == name or not exact and c.lower() == name.lower()]
    if len(places) != 1:
        raise ValueError(f"{len(places)} columns are called {name}")
    return places[0]


def inline_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table out of a literal, without a Python worker or an RDD."""
    names = [part.split()[0] for part in schema.split(", ")]
    told = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    fields = ",".join(f"`{n}`:{part.split(' ', 1)[1]}" for n, part in zip(names, schema.split(", "), strict=True))
    return spark.range(1).select(F.inline(F.from_json(F.lit(told), f"array<struct<{fields}>>")))
