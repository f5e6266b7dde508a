"""Queries of the stateful and scheduled operators: hosts' waits in batch and as a stream, and the log of the status sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.plans.catalog import query
from tidewater.plans.session import scratch
from tidewater.plans.text_queries import _STATUS, _STATUS_FROM, NOW, _records
from tidewater.streaming import politeness as P
from tidewater.streaming import sweeps as W

c = F.col
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_ANSWERED = "case (event_id * 7 + user_id) % 9 when 0 then 429 when 1 then 503 when 2 then 500 when 3 then 404 when 4 then 429 when 5 then null else 200 end"
_PENALTY = f"""with e as (select user_id, ts, event_id, {_ANSWERED} as status from events),
  o as (select user_id, list(coalesce(status, 404)::double order by ts, event_id) as s, max(ts) as "at", count(*) as n from e group by 1)
select user_id::varchar as host, list_reduce(list_prepend(0.0::double, s), lambda p, x: case when x in (429, 503) then case when p = 0 then 5000 else least(p * 2, 300000) end
  when x >= 500 then case when p = 0 then 2000 else least(p * 1.5, 60000) end when x < 400 then case when floor(p / 2) < 500 then 0 else floor(p / 2) end else p end)::double as penalty_ms, o."at", n from o"""


def _responses(events):
    return events.select(c("user_id").cast("string").alias("host"), c("ts").cast("timestamp").alias("at"), F.expr(_ANSWERED).cast("int").alias("status"), c("event_id").alias("tie"))


@query(_PENALTY)
def str8_host_penalties(t):
    """429, 503, other 5xx, 4xx and successes of each host, folded in order of time."""
    return P.penalties(_responses(t("events"))).select("host", "penalty_ms", "at", "n")


def _drained(spark, stream, mode: str, path: str):
    """Write all that a stream gives now, a folder a batch."""
    write = W.write_once(f"{path}/out", lambda batch: batch)
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out")


@query(_PENALTY)
def str8_penalty_stream(t):
    """The same as a stream with a state for each host; the last batch of a host has its wait."""
    before = t.spark.conf.get(ROCKS[0], None)
    t.spark.conf.set(*ROCKS)
    try:
        told = _drained(t.spark, P.penalty_stream(_responses(t.stream("events"))), "update", scratch(t.spark, "penalties"))
    finally:
        t.spark.conf.set(ROCKS[0], before) if before else t.spark.conf.unset(ROCKS[0])
    last = told.groupBy("host").agg(F.max(F.struct("batch", "penalty_ms", "at", "n")).alias("m"))
    return last.select("host", "m.penalty_ms", "m.at", "m.n")


@query(f"select o_orderkey as id, 'OPEN' as old_status, {_STATUS} as new_status from {_STATUS_FROM} where {_STATUS} <> 'OPEN'")
def str2_sweep_log(t):
    """What the scheduled sweep has written to its log over a stream of records."""
    path = scratch(t.spark, "sweep")
    records = _records(t.stream).withColumn("version", F.lit(1))
    W.sweep_stream(records, f"{path}/log", lambda: NOW, f"{path}/state").awaitTermination()
    return W.sweep_log(t.spark, f"{path}/log").select("id", "old_status", "new_status")
