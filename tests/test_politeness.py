"""Hosts' waits in batch and as a stream, and the sweep's log under replays."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewater.plans.stream_queries import ROCKS
from tidewater.streaming import politeness as P
from tidewater.streaming import sweeps as W

BEGIN = datetime(2024, 1, 1)
SCHEMA = "host string, at timestamp, status int, tie long"


@pytest.fixture
def rocks(spark):
    spark.conf.set(*ROCKS)
    yield
    spark.conf.unset(ROCKS[0])


def plain(rows, ease=None):
    out = {}
    for host, at, status, _ in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[3])):
        p, last, n = out.get(host, (0.0, None, 0))
        if ease and last:
            for _ in range((at - last) // ease):
                p = p // 2 if p // 2 >= 500 else 0.0
        if status in (429, 503):
            p = min(p * 2, 300_000.0) if p else 5000.0
        elif status is not None and status >= 500:
            p = min(p * 1.5, 60_000.0) if p else 2000.0
        elif status is not None and status < 400:
            p = p // 2 if p // 2 >= 500 else 0.0
        out[host] = (p, at, n + 1)
    return out


def responses(seed, n=400):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", "busy", "busy", "busy"]), BEGIN + timedelta(seconds=i * rng.choice([1, 3])), rng.choice([429, 429, 503, 500, 502, 404, 200, 200, 301, None]), i) for i in range(n)]
    return rows + [(None, BEGIN, 429, 1), ("a", None, 429, 1), ("alone", BEGIN, None, 1)]


@pytest.mark.parametrize("ease", [None, timedelta(seconds=2)])
def test_batch_is_a_fold_in_time(spark, ease):
    rows = responses(1)
    shuffled = random.Random(2).sample(rows, len(rows))
    got = {r["host"]: (r["penalty_ms"], r["at"], r["n"]) for r in P.penalties(spark.createDataFrame(shuffled, SCHEMA).repartition(5), ease).collect()}
    assert got == plain(rows, ease)
    assert P.penalties(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocked_until(spark):
    rows = [("a", BEGIN, 429, 1), ("a", BEGIN, 429, 2), ("a", BEGIN + timedelta(seconds=1), 200, 3)]
    got = P.penalties(spark.createDataFrame(rows, SCHEMA)).first()
    assert (got["penalty_ms"], got["blocked_until"]) == (5000.0, BEGIN + timedelta(seconds=10))


@pytest.mark.parametrize("ease", [None, timedelta(seconds=30)])
def test_a_stream_of_batches_equals_the_batch(spark, rocks, tmp_path, ease):
    rows = sorted((r for r in responses(3) if r[1] is not None), key=lambda r: (r[1], r[3]))
    for i in range(4):
        spark.createDataFrame(rows[i * 101 : (i + 1) * 101], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = {}

    def keep(batch, _):
        out.update({r["host"]: (r["penalty_ms"], r["at"], r["n"]) for r in batch.collect()})

    P.penalty_stream(stream, ease).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert {h: v[0] for h, v in out.items()} == {h: v[0] for h, v in plain(rows, ease).items()}
    if ease is None:
        assert out == plain(rows)


def records(spark, ids, version):
    return spark.createDataFrame([(i,) for i in ids], "id long").select(
        "id", F.lit(version).alias("version"), F.struct(F.lit("FIXED").alias("kind"), F.lit(datetime(2026, 1, 1)).alias("date")).alias("deadline"), F.lit(0.9).alias("confidence"), F.lit("APPROVED").alias("reviewStatus"), F.lit("OPEN").alias("status"))


def test_a_batch_that_runs_again_is_written_once(spark, tmp_path):
    """The job is lost after it wrote a batch and before the batch was committed."""
    for version, ids in ((1, [1, 2, 2]), (2, [2, 3])):
        records(spark, ids, version).coalesce(1).write.parquet(f"{tmp_path}/in/{version}")
    schema = records(spark, [1], 1).schema
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    now, log = (lambda: datetime(2026, 2, 1)), f"{tmp_path}/log"
    write = W.write_once(log, lambda batch: W.latest(batch).select("id", "status"))

    def dies(batch, batch_id):
        write(batch, batch_id)
        raise RuntimeError("lost")

    query = stream().writeStream.foreachBatch(dies).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    W.sweep_stream(stream(), log, now, f"{tmp_path}/state").awaitTermination()
    found = [(r["batch"], r["id"], r["old_status"], r["new_status"]) for r in W.sweep_log(spark, log).orderBy("batch", "id").collect()]
    assert found == [(0, 1, "OPEN", "CLOSED"), (0, 2, "OPEN", "CLOSED"), (1, 2, "OPEN", "CLOSED"), (1, 3, "OPEN", "CLOSED")]
    W.sweep_stream(stream(), log, now, f"{tmp_path}/state").awaitTermination()
    assert W.sweep_log(spark, log).count() == 4


def test_the_stream_folds_plain_rows():
    """No frame a host: rows of any order, without ties or statuses, go through a stubbed state."""
    from pyspark.sql import Row

    class State:
        known = None

        def get(self):
            return self.known

        def update(self, value):
            self.known = value

    class Handle:
        def __init__(self):
            self.state = State()

        def getValueState(self, name, kind):
            return self.state

    processor, handle = P._processor(None), Handle()
    processor.init(handle)
    batches = [[(3_000_000, 2, 200), (1_000_000, None, 429), (2_000_000, 1, None)], [(4_000_000, 5, 503)]]
    got = [next(iter(processor.handleInputRows(("h",), iter([Row(us=u, tie=t, status=s) for u, t, s in b]), None))) for b in batches]
    assert [(r["penalty_ms"], r["blocked"], r["at"], r["n"]) for r in got] == [(2500.0, 6_000_000, 3_000_000, 3), (5000.0, 9_000_000, 4_000_000, 4)]
