"""Health of sources and cached answers as state of a stream, with timers and expiry: transformWithState.

These need the RocksDB state store: spark.sql.streaming.stateStore.providerClass, see STORE.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.health import COOL_DOWN_S, FAILURES, NEW, OLD

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
HEALTH = "source string, at timestamp, state string, failures int, trips int, latency double"
_KEPT = "state string, failures int, opened double, trips int, latency double, last double"


def step(kept: tuple, at: float, ok: bool, value: float | None) -> tuple:
    """(state, failures, opened, trips, latency, last) after a request. A success always moves the latency; while the breaker is open and cools down, nothing else changes."""
    state, failures, opened, trips, latency, _ = kept
    if ok and value is not None:
        latency = value if latency is None else OLD * latency + NEW * value
    if state == "OPEN" and at - opened < COOL_DOWN_S:
        return state, failures, opened, trips, latency, at
    if ok:
        return "CLOSED", 0, -1.0, trips, latency, at
    failures += 1
    if state != "CLOSED" or failures >= FAILURES:
        return "OPEN", failures, at, trips + 1, latency, at
    return state, failures, opened, trips, latency, at


class SourceHealth(StatefulProcessor):
    """A breaker and a moving latency a source; a timer at the end of the cool-down tells HALF_OPEN without a request."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("health", _KEPT)

    def _said(self, key: tuple, kept: tuple, at: float, state: str) -> pd.DataFrame:
        _, failures, _, trips, latency, _ = kept
        return pd.DataFrame({"source": [key[0]], "at": [pd.Timestamp(at, unit="s")], "state": [state], "failures": [failures], "trips": [trips], "latency": [latency]}).astype({"latency": "float64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = tuple(self.kept.get()) if self.kept.exists() else ("CLOSED", 0, -1.0, 0, None, 0.0)
        kept = before
        for r in pd.concat(list(rows)).sort_values(["ts", "id"]).itertuples():
            kept = step(kept, r.ts.timestamp(), bool(r.ok), None if pd.isna(r.value) else float(r.value))
        if kept[2] != before[2]:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            if kept[0] == "OPEN":
                self.handle.registerTimer(int((kept[2] + COOL_DOWN_S) * 1000))
        self.kept.update(kept)
        yield self._said(key, kept, kept[5], kept[0])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = tuple(self.kept.get())
        if kept[0] == "OPEN":
            yield self._said(key, kept, expiredTimerInfo.getExpiryTimeInMs() / 1000, "HALF_OPEN")

    def close(self) -> None:
        pass


def source_health(log: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Rows of HEALTH, in update mode: one per source and micro-batch that has requests of it, and HALF_OPEN once event time passes the end of a cool-down.

    log: source, ts timestamp, id, ok, value; rows of a micro-batch are taken in order of ts and id, so batches must come
    in order of time. A source's micro-batch is one task's work. Null ok is a failure, null value leaves the latency.
    """
    rows = log.selectExpr("CAST(source AS STRING) AS source", "ts", "id", "COALESCE(ok, false) AS ok", "CAST(value AS DOUBLE) AS value").where("ts IS NOT NULL").withWatermark("ts", late)
    return rows.groupBy("source").transformWithStateInPandas(SourceHealth(), HEALTH, "Update", "EventTime")


ANSWER = "key string, id long, answer string, hit boolean"


class CachedAnswers(StatefulProcessor):
    """Answers by key that expire: a request without an answer gets the one that is kept, if it isn't too old."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answer = handle.getValueState("answer", "answer string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = self.answer.get()[0] if self.answer.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("id").itertuples():
            if r.answer is not None:
                kept = r.answer
                self.answer.update((kept,))
            out.append((key[0], r.id, kept, r.answer is None and kept is not None))
        yield pd.DataFrame(out, columns=["key", "id", "answer", "hit"])

    def close(self) -> None:
        pass


def cached_answers(requests: DataFrame, ttl_ms: int) -> DataFrame:
    """Rows of ANSWER for requests (key, id, answer: null asks, else tells): hit tells that the answer came from the cache. Keys expire ttl_ms after they were last told, by processing time; so under an availableNow trigger a query goes on without end, and takes a processing-time or once trigger."""
    rows = requests.selectExpr("key", "CAST(id AS BIGINT) AS id", "answer")
    return rows.groupBy("key").transformWithStateInPandas(CachedAnswers(ttl_ms), ANSWER, "Append", "ProcessingTime")
