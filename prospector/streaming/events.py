"""Streams of events: windows with watermarks, sessions, repeats, and the health of sources as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.health import COOL_DOWN_S, FAILURES, NEW, OLD


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_batch: int = 8) -> DataFrame:
    """The events files of a folder as a stream; ts becomes a timestamp with a zone, as watermarks need."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window")["start"].alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w, "user_id").agg(F.count("*").alias("n")).select(F.col("session_window")["start"].alias("start"), F.col("session_window")["end"].alias("end"), "user_id", "n")


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


HEALTH = "source long, state string, failures int, trips int, latency double"


def _health(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    name, failures, opened, trips, latency = state.get if state.exists else ("CLOSED", 0, -1.0, 0, None)
    for r in pd.concat(list(batches)).sort_values(["ts", "id"]).itertuples():
        at = r.ts.timestamp()
        if name == "OPEN" and at - opened < COOL_DOWN_S:
            continue
        if r.ok:
            latency = r.value if latency is None else OLD * latency + NEW * r.value
            name, failures, opened = "CLOSED", 0, -1.0
            continue
        failures += 1
        if name == "OPEN" or failures >= FAILURES:
            name, opened, trips = "OPEN", at, trips + 1
    state.update((name, failures, opened, trips, latency))
    yield pd.DataFrame({"source": [key[0]], "state": [name], "failures": [failures], "trips": [trips], "latency": [latency]})


def source_health(log: DataFrame) -> DataFrame:
    """A circuit breaker and a moving latency per source, as state that micro-batches carry on. log: source, ts, id, ok, value."""
    return log.groupBy("source").applyInPandasWithState(_health, HEALTH, "state string, failures int, opened double, trips int, latency double", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All that is there now, through a memory table: for tests and small results."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
