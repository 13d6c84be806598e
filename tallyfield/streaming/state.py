"""State that expires: requests that nobody answered, and tallies of hours that are over.

Both need Spark's state store on RocksDB, which `expiring_state` sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyfield import config as C
from tallyfield.functions.rates import pacific_hour
from tallyfield.package import ship

_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: By the clock, state may always expire in one more batch without data: a run over what is there now would never end.
_DATA_ONLY = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def expiring_state(spark: SparkSession, by_clock: bool = False) -> Iterator[None]:
    """Settings of the streams that are started inside; `by_clock` for those whose state expires by processing time."""
    wanted = _STORE | (_DATA_ONLY if by_clock else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


OUTCOMES = "id bigint, key bigint, outcome string, seconds double"


class Unanswered(StatefulProcessor):
    """What became of each request of a key: answered, superseded by a newer one, or lost once `grace` microseconds have
    passed without either.

    Rows wait in the state until the watermark has passed them, and are then gone through in the order of time, so neither
    the order in which they come, within the watermark's delay, nor the cut of micro-batches changes what is found. A key
    has one timer at a time: its first row that waits, or the end of the open request's grace.
    """

    def __init__(self, grace: int) -> None:
        self.grace = grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, id bigint, request boolean")
        self.open = handle.getValueState("open", "at bigint, id bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            if len(frame):
                self.waiting.appendList(list(zip(frame["at"].tolist(), frame["id"].tolist(), frame["request"].tolist())))
                first = min(frame["at"].min(), first) if first is not None else frame["at"].min()
        if first is not None:
            self._wake_at(int(first) // 1000)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in waiting if r[0] < passed]
        rest = waiting[len(due) :]
        open_ = tuple(self.open.get()) if self.open.exists() else None
        found = []
        for at, id_, request in [*due, (passed - 1, None, None)]:
            if open_ and at - open_[0] > self.grace or open_ and id_ is None and passed > open_[0] + self.grace:
                found.append((open_[1], "lost", None))
                open_ = None
            if id_ is None:
                break
            if open_:
                found.append((open_[1], "superseded" if request else "answered", (at - open_[0]) / 1e6))
            open_ = (at, id_) if request else None
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
        self.open.update(open_) if open_ else self.open.clear()
        wake = [r[0] for r in rest[:1]] + ([open_[0] + self.grace] if open_ else [])
        if wake:
            self._wake_at(min(wake) // 1000, expiredTimerInfo.getExpiryTimeInMs())
        if found:
            ids, outcomes, seconds = zip(*found)
            yield pd.DataFrame({"id": ids, "key": key[0], "outcome": outcomes, "seconds": pd.Series(seconds, dtype="float64")})

    def _wake_at(self, ms: int, fired: int | None = None) -> None:
        """A timer fires once the watermark is beyond its millisecond, and is listed until its handler has ended; of the
        others only the first one is kept."""
        set_ = [t for t in self.handle.listTimers() if t != fired]
        if set_ and min(set_) <= ms:
            return
        for t in set_:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


def unanswered(log: DataFrame, request: str, delay: str = "10 minutes", grace_seconds: int = C.DISPATCH_GRACE_SECONDS) -> DataFrame:
    """id, key, outcome, seconds of the requests of a stream (id, ts, key, ledger): rows for which `request` holds open one
    for their key, all others answer it. What the watermark hasn't passed yet has no row."""
    ship(log.sparkSession)
    rows = log.withWatermark("ts", delay).select("key", "id", "ts", F.unix_micros("ts").alias("at"), F.expr(request).alias("request"))
    return rows.groupBy("key").transformWithStateInPandas(Unanswered(grace_seconds * 1_000_000), OUTCOMES, "append", "EventTime")


ADMITTED = "id bigint, key bigint, hour string, used int, allowed boolean"


class HourTally(StatefulProcessor):
    """How many requests each hour of a key has allowed so far. A micro-batch appends one row, the tallies of the
    hours that it changed, and the highest one of an hour holds. The state store drops a row when it is `keep` milliseconds old, so an hour
    that hasn't changed for so long is forgotten, and a key that never comes back leaves nothing behind. The group is the key
    and not its hour: most hours of a key hold a request or two, and every group costs calls to the state store."""

    def __init__(self, limit: int, keep: int) -> None:
        self.limit, self.keep = limit, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getListState("used", "hours array<string>, used array<int>", self.keep)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        used: dict[str, int] = {}
        for hours, tallies in self.used.get():
            for hour, n in zip(hours, tallies):
                used[hour] = max(n, used.get(hour, 0))
        found = sorted(x for frame in rows for x in zip(frame["at"].tolist(), frame["id"].tolist(), frame["hour"].tolist()))
        before = []
        for _, _, hour in found:
            before.append(used.get(hour, 0))
            used[hour] = min(before[-1] + 1, self.limit)
        changed = list(dict.fromkeys(x[2] for x in found))
        self.used.appendValue((changed, [used[hour] for hour in changed]))
        yield pd.DataFrame({"id": [x[1] for x in found], "key": key[0], "hour": [x[2] for x in found], "used": before, "allowed": [n < self.limit for n in before]})

    def close(self) -> None:
        pass


def hour_admission(log: DataFrame, limit: int = C.HOURLY_PER_IP, keep_seconds: int = 7200) -> DataFrame:
    """id, key, hour (Pacific), used, allowed of each request of a stream: an hour allows `limit` of a key, in the order of
    time within a micro-batch."""
    ship(log.sparkSession)
    rows = log.select("key", pacific_hour(F.col("ts")).alias("hour"), "id", F.unix_micros("ts").alias("at"))
    return rows.groupBy("key").transformWithStateInPandas(HourTally(limit, keep_seconds * 1000), ADMITTED, "append", "ProcessingTime")
