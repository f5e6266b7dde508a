"""The stateful operators on streams that are read from files."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewater.operators import work
from tidewater.streaming import state as T

BEGIN = datetime(2024, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    """events(rows): a stream of (key, at) rows, a file for each batch."""

    def events(*batches):
        folder = str(tmp_path / "in")
        for i, rows in enumerate(batches):
            spark.createDataFrame([(k, BEGIN + timedelta(seconds=s)) for k, s in rows], "key string, at timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
        return spark.readStream.schema("key string, at timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)

    return events


def drained(df, tmp_path, mode="append"):
    out = []
    query = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda batch, _: out.extend(batch.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def test_first_arrivals(spark, stream, tmp_path):
    got = drained(T.first_arrivals(stream([("a", 0), ("b", 1)], [("a", 5), ("c", 6)], [("b", 7), ("c", 8)]), ["key"], "at"), tmp_path)
    assert sorted(r["key"] for r in got) == ["a", "b", "c"]


def test_rate_windows(spark, stream, tmp_path):
    hits = [("x", i % 10) for i in range(31)] + [("y", 1)]
    got = drained(T.rate_windows(stream(hits, [("z", 10_000)]), "key", "at"), tmp_path)
    assert {(r["key"], r["n"], r["limited"]) for r in got if r["key"] != "z"} == {("x", 31, True), ("y", 1, False)}


def test_sessions(spark, stream, tmp_path):
    got = drained(T.sessions(stream([("x", 0), ("x", 600)], [("x", 1200)], [("x", 9000), ("y", 90_000)]), "key", "at"), tmp_path)
    assert [(r["n"], r["end"] - r["start"]) for r in sorted(got, key=lambda r: r["start"]) if r["key"] == "x"] == [(3, timedelta(seconds=3000)), (1, timedelta(minutes=30))]


def test_sweep_runs_over_what_is_there(spark, stream):
    seen = []
    T.sweep(stream([("a", 0)], [("b", 1)]), lambda batch, _: seen.extend(r["key"] for r in batch.collect())).awaitTermination()
    assert sorted(seen) == ["a", "b"]


def test_claims_are_disjoint_until_a_lease_runs_out(spark):
    now = BEGIN
    rows = [(i, "PENDING", i % 3, now, 0, None) for i in range(10)] + [(10, "COMPLETED", 9, now, 0, None), (11, "PENDING", 9, now + timedelta(days=1), 0, None), (12, "FAILED", 9, now, 4, None)]
    queue = spark.createDataFrame(rows, "id long, status string, priority int, next_at timestamp, attempts int, lease_until timestamp")
    first = work.claim(queue, now, 4)
    assert [r["id"] for r in first.collect()] == [2, 5, 8, 1]
    after = work.after_claim(queue, first)
    second = work.claim(after, now + timedelta(minutes=1), 4)
    assert not {r["id"] for r in second.collect()} & {2, 5, 8, 1} and after.count() == queue.count()
    late = now + timedelta(minutes=16)
    assert {r["id"] for r in work.reclaimable(after, late).collect()} == {2, 5, 8, 1} and work.reclaimable(after, now).count() == 0


def test_quota_and_pruning(spark):
    views = spark.createDataFrame([("r", "a", BEGIN), ("r", "a", BEGIN), ("r", "b", BEGIN + timedelta(1)), ("r", "c", BEGIN + timedelta(2)), ("r", "c", BEGIN + timedelta(40))], "reader string, item string, at timestamp")
    got = {(r["month"], r["item"]): r["allowed"] for r in work.monthly_quota(views, "reader", "item", "at", 2).collect()}
    assert got == {("2024-01", "a"): True, ("2024-01", "b"): True, ("2024-01", "c"): False, ("2024-02", "c"): True}
    nested = views.select(F.struct("reader", F.struct("item", "at").alias("deep")).alias("s"), "item")
    kept = work.pruned(nested, ["s.deep.item", "s.none", "gone"])
    assert kept.schema.simpleString() == "struct<s:struct<deep:struct<item:string>>>"
