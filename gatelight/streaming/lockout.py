"""Login lockout: five failures in a row lock a user for a minute."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

LIMIT = 5
LOCK_SECONDS = 60.0
# Attempts of a stream are settled in slots of so much event time.
SLOT_MICROS = 60_000_000
_OUT = "username string, event_id bigint, outcome string"


class _Attempts:
    """Failures in a row and the time of the last one."""

    def __init__(self, failures: int = 0, last: float = 0.0):
        self.failures, self.last = failures, last

    def take(self, at: float, failed: bool) -> str:
        if self.failures >= LIMIT:
            if at - self.last < LOCK_SECONDS:
                return "locked"  # rejected unseen: neither counts nor prolongs
            self.failures = 0
        if not failed:
            self.failures = 0
            return "ok"
        self.failures, self.last = self.failures + 1, at
        return "failed"


def _seconds(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64") / 1e6


def lockout(attempts: DataFrame) -> DataFrame:
    """Outcome of every attempt of a table: username, event_id, ts, failed.

    Users are spread over tasks and sorted by time there; a task walks its rows in
    Arrow batches and holds one user's two numbers, never a user's whole history.
    """
    placed = attempts.select("username", "event_id", "ts", "failed").repartition("username").sortWithinPartitions(
        "username", "ts", "event_id"
    )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state = None, _Attempts()
        for batch in batches:
            outcomes = []
            for name, at, failed in zip(batch["username"], _seconds(batch["ts"]), batch["failed"]):
                if name != user:
                    user, state = name, _Attempts()
                outcomes.append(state.take(at, failed))
            yield batch[["username", "event_id"]].assign(outcome=outcomes)

    return placed.mapInPandas(walk, _OUT)


class _Lockout(StatefulProcessor):
    """A user's attempts wait in slots of event time; a slot is settled, in order, once no earlier attempt can come.

    State: ``waiting`` (slot -> packed attempts) and ``count`` (failures in a row, time of the last one). A success
    removes the count, and so does a timer when a lock has run out, so users who are not failing leave nothing behind.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long", "attempts binary")
        self.count = handle.getValueState("count", "failures int, last double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            at = batch["ts"].astype("datetime64[us]").astype("int64").to_numpy()
            packed = np.stack([at, batch["event_id"].to_numpy(np.int64), batch["failed"].to_numpy(np.int64)], axis=1)
            slots = at // SLOT_MICROS
            for slot in np.unique(slots).tolist():
                before = self.waiting.getValue((slot,)) if self.waiting.containsKey((slot,)) else (b"",)
                self.waiting.updateValue((slot,), (bytes(before[0]) + packed[slots == slot].tobytes(),))
                self.handle.registerTimer((slot + 1) * SLOT_MICROS // 1000)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        slot = now * 1000 // SLOT_MICROS - 1
        state = _Attempts(*self.count.get()) if self.count.exists() else _Attempts()
        outcomes = []
        if (slot + 1) * SLOT_MICROS == now * 1000 and self.waiting.containsKey((slot,)):
            rows = np.frombuffer(bytes(self.waiting.getValue((slot,))[0]), np.int64).reshape(-1, 3)
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            outcomes = [(key[0], event, state.take(at / 1e6, bool(failed))) for at, event, failed in rows.tolist()]
            self.waiting.removeKey((slot,))
        ends = int((state.last + LOCK_SECONDS) * 1000) + 1
        if state.failures >= LIMIT and ends <= now:
            state.failures = 0
        if not state.failures:
            self.count.clear()
        else:
            self.count.update((state.failures, state.last))
            if state.failures >= LIMIT:
                self.handle.registerTimer(ends)
        if outcomes:
            names, events, told = zip(*outcomes)
            yield pd.DataFrame({"username": pd.Series(names, dtype=object), "event_id": events, "outcome": pd.Series(told, dtype=object)})


def lockout_stream(attempts: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """The same over a stream, in order of event time however attempts arrive.

    An attempt's outcome is told once the watermark has passed its slot of a minute; attempts
    that come later than ``lateness`` are dropped by Spark. A task holds the attempts of one
    user in one slot. Sets the state store that timers need on the session.
    """
    attempts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    given = attempts.select("username", "event_id", "ts", "failed").withWatermark("ts", lateness)
    return given.groupBy("username").transformWithStateInPandas(_Lockout(), _OUT, "Append", "EventTime")
