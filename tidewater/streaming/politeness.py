"""Hosts' waits after their responses, as a fold over time: in batch over sorted partitions, and as a stream with a state for each host.

Both use one step: doubled from 5 s to 300 s on 429 and 503, by half from 2 s to 60 s on other
5xx, halved on success (below half a second: none); anything else changes nothing. With ease,
each such time without a response halves the wait too, so that a host that is left alone comes
back by itself; in the stream a timer drops its state then.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:  # the state client needs protobuf; without it the stream keeps its state by applyInPandasWithState
    import google.protobuf  # noqa: F401

    HAS_PROCESSORS = True
except ModuleNotFoundError:
    HAS_PROCESSORS = False

#: First and longest wait in ms and growth, for limited and for failed answers; the least wait.
LIMITED, FAILED, LEAST = (5000.0, 2.0, 300_000.0), (2000.0, 1.5, 60_000.0), 500.0
OUT = "host string, penalty_ms double, blocked_until timestamp, at timestamp, n long"


def eased(penalty: float) -> float:
    half = penalty // 2
    return half if half >= LEAST else 0.0


def step(penalty: float, status: int | None) -> float:
    """The wait after one more response; a response without a status changes nothing."""
    if status is None:
        return penalty
    if status in (429, 503) or status >= 500:
        first, growth, most = LIMITED if status in (429, 503) else FAILED
        return min(penalty * growth, most) if penalty else first
    return eased(penalty) if status < 400 else penalty


def after(penalty: float, silence: timedelta, ease: timedelta | None) -> float:
    """The wait after a silence."""
    if ease is not None and penalty:
        for _ in range(min(silence // ease, 64)):  # nothing is left after far fewer
            penalty = eased(penalty)
    return penalty


class Fold:
    """One host's wait so far."""

    def __init__(self, penalty: float = 0.0, blocked=None, at=None, n: int = 0, ease: timedelta | None = None):
        self.penalty, self.blocked, self.at, self.n, self.ease = penalty, blocked, at, n, ease

    def add(self, at, status) -> None:
        if self.at is not None and at > self.at:
            self.penalty = after(self.penalty, at - self.at, self.ease)
        self.penalty = step(self.penalty, None if pd.isna(status) else int(status))
        if not pd.isna(status) and int(status) in (429, 503):
            self.blocked = at + timedelta(milliseconds=self.penalty)
        self.at, self.n = at if self.at is None else max(at, self.at), self.n + 1

    def row(self, host) -> tuple:
        return host, self.penalty, self.blocked, self.at, self.n


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["host", "penalty_ms", "blocked_until", "at", "n"])
    return frame.astype({"penalty_ms": float, "blocked_until": "datetime64[us]", "at": "datetime64[us]", "n": "int64"})


def penalties(responses: DataFrame, ease: timedelta | None = None) -> DataFrame:
    """responses (host, at, status, tie) folded by host in order of at and tie: (host, penalty_ms, blocked_until, at, n).

    Rows are sorted inside hash partitions and stream past a state of one host, so that a busy
    host needs no more memory than others. Rows without a host or a time are left out.
    """
    rows = responses.where(F.col("host").isNotNull() & F.col("at").isNotNull()).select("host", "at", "status", "tie").repartition("host").sortWithinPartitions("host", "at", "tie")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, fold = None, None
        for frame in frames:
            done = []
            for own, at, status in zip(frame["host"], frame["at"], frame["status"], strict=True):
                if own != host:
                    if fold is not None:
                        done.append(fold.row(host))
                    host, fold = own, Fold(ease=ease)
                fold.add(at, status)
            yield _frame(done)
        if fold is not None:
            yield _frame([fold.row(host)])

    return rows.mapInPandas(run, OUT)


def penalty_stream(responses: DataFrame, ease: timedelta | None = None, late: str = "10 minutes") -> DataFrame:
    """The same as a stream: for each host of a batch its wait after that batch (update mode).

    A batch's rows of one host are put in order of time; rows of later batches are taken as
    later. With ease the state of a host goes once its wait has come to nothing.
    """
    marked = responses.where(F.col("host").isNotNull() & F.col("at").isNotNull()).select("host", "at", "status", "tie").withWatermark("at", late)
    if HAS_PROCESSORS:
        told = marked.withColumn("us", F.unix_micros("at")).groupBy("host").transformWithState(_processor(ease), "host string, penalty_ms double, blocked long, at long, n long", "Update", "EventTime")
        return told.select("host", "penalty_ms", F.timestamp_micros("blocked").alias("blocked_until"), F.timestamp_micros("at").alias("at"), "n")
    from pyspark.sql.streaming.state import GroupStateTimeout

    def fold(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        own = Fold(*_known(state.getOption), ease=ease)
        _add(own, frames)
        state.update((own.penalty, own.blocked, own.at, own.n))
        if ease is not None:
            state.setTimeoutTimestamp(max(int((own.at + _rest(own.penalty, ease)).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield _frame([own.row(key[0])])

    return marked.groupBy("host").applyInPandasWithState(fold, OUT, "penalty double, blocked timestamp, at timestamp, n long", "update", GroupStateTimeout.EventTimeTimeout if ease is not None else GroupStateTimeout.NoTimeout)


def _known(told) -> tuple:
    penalty, blocked, at, n = told or (0.0, None, None, 0)
    return penalty, None if pd.isna(blocked) else pd.Timestamp(blocked), None if pd.isna(at) else pd.Timestamp(at), n


def _add(fold: Fold, frames: Iterator[pd.DataFrame]) -> None:
    rows = pd.concat(list(frames)).sort_values(["at", "tie"], kind="stable")  # one host's rows of one batch
    for at, status in zip(rows["at"], rows["status"], strict=True):
        fold.add(at, status)


def _rest(penalty: float, ease: timedelta) -> timedelta:
    """How long until nothing is left of a wait."""
    n = 1
    while penalty := eased(penalty):
        n += 1
    return n * ease


_EPOCH = datetime(1970, 1, 1)


def _when(us: int | None) -> datetime | None:
    return None if us is None else _EPOCH + timedelta(microseconds=us)


def _us(at: datetime | None) -> int | None:
    return None if at is None else (at - _EPOCH) // timedelta(microseconds=1)


def _processor(ease: timedelta | None):
    """The processor of plain rows, whose times are microseconds (us); one frame a host would cost more than its rows."""
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    kind = StructType([StructField("penalty", DoubleType()), StructField("blocked", LongType()), StructField("at", LongType()), StructField("n", LongType())])

    class HostPenalty(StatefulProcessor):
        """A value state for each host, and with ease a timer that drops it."""

        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("wait", kind)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            known = self.state.get()
            own = Fold(known[0], _when(known[1]), _when(known[2]), known[3], ease) if known else Fold(ease=ease)
            told = [(r["us"], r["tie"], r["status"]) for r in rows]  # one host's rows of one batch
            for us, _, status in sorted(told, key=lambda r: (r[0], r[1] is None, 0 if r[1] is None else r[1])):
                own.add(_when(us), status)
            after_all = (own.penalty, _us(own.blocked), _us(own.at), own.n)
            self.state.update(after_all)
            if ease is not None:
                for timer in self.handle.listTimers():
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(_us(own.at + _rest(own.penalty, ease)) // 1000)
            yield Row(host=key[0], penalty_ms=after_all[0], blocked=after_all[1], at=after_all[2], n=after_all[3])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            self.state.clear()
            yield from ()

        def close(self) -> None:
            pass

    return HostPenalty()
