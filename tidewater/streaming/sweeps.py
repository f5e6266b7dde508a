"""The scheduled status sweep as a stream that writes each batch's transitions once, also if the batch is run again."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import lifecycle

LOG = "id long, old_status string, new_status string, at timestamp"


def write_once(path: str, make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: what make gives for a batch replaces the folder of the batch's id.

    After a failure Spark runs the last batch again with the same id and rows; its folder is
    then written anew, so the log holds every batch once. A folder that was left half-written
    is replaced as well.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest(records: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The newest version of each record of a batch; of equal ones any, they are the same."""
    newest = Window.partitionBy(key).orderBy(F.desc(version))
    return records.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def sweep_stream(records: DataFrame, path: str, now: Callable[[], datetime], checkpoint: str, every: str | None = None):
    """Sweeps versions of records (id, version, deadline, confidence, reviewStatus, status) as they arrive and writes (id, old_status, new_status, at) for each change of status.

    now() is asked once a batch. every: the time between sweeps, such as "1 hour"; without it
    what is there is swept once. The log is a folder for each batch under path.
    """

    def make(batch: DataFrame) -> DataFrame:
        at = now()
        changed = lifecycle.status_sweep(latest(batch), at)
        return changed.select(F.col("id").cast("long"), "old_status", "new_status", F.lit(at).cast("timestamp").alias("at"))

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return records.writeStream.foreachBatch(write_once(path, make)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def sweep_log(spark: SparkSession, path: str) -> DataFrame:
    """All transitions that were written, with the id of their batch."""
    return spark.read.schema(LOG + ", batch long").option("basePath", path).parquet(path)
