"""Streaming forms of the stateful operators. Each takes a streaming (or static) DataFrame and returns one; the caller writes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_arrivals(events: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Drops repeats of a key; state is kept as long as events may be late."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def rate_windows(events: DataFrame, key: str, at: str, width: str = "10 seconds", most: int = 30, late: str = "1 minute") -> DataFrame:
    """(window start, key, n, limited): hits in tumbling windows and whether they exceed the limit."""
    marked = events.withWatermark(at, late) if events.isStreaming else events
    out = marked.groupBy(F.window(at, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), key, "n", (F.col("n") > most).alias("limited"))


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): conversations that end after a gap."""
    marked = events.withWatermark(at, late) if events.isStreaming else events
    out = marked.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def penalty_ms(statuses: Column) -> Column:
    """A host's wait after its responses in order: doubled from 5 s to 300 s on 429 and 503, by half from 2 s to 60 s on other 5xx, halved on success, 0 below half a second."""
    def step(p: Column, status: Column) -> Column:
        limited = F.when(p == 0, 5000.0).otherwise(F.least(p * 2, F.lit(300_000.0)))
        failed = F.when(p == 0, 2000.0).otherwise(F.least(p * 1.5, F.lit(60_000.0)))
        eased = F.when(F.floor(p / 2) < 500, 0.0).otherwise(F.floor(p / 2).cast("double"))
        return F.when(status.isin(429, 503), limited).when(status >= 500, failed).when(status < 400, eased).otherwise(p)

    return F.aggregate(statuses, F.lit(0.0), step)


def sweep(records: DataFrame, write, trigger: dict | None = None):
    """Run write(batch, id) on every micro-batch of a stream, once over what is there by default."""
    return records.writeStream.foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()
