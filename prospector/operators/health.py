"""Health of sources from their request logs: moving latency, recent success, circuit breaker, status."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import stored

FAILURES, COOL_DOWN_S, LAST, OLD, NEW = 3, 120, 20, 0.7, 0.3


#: Rows of a source that one window orders at most, besides LAST - 1 of overlap.
WINDOW_ROWS = 100_000


def _numbered(log: DataFrame) -> DataFrame:
    """log with _pos, its place in its source's log in order of ts and id, from 1, without a window over a source.

    Rows are dealt by ranges of (source, ts, id); only sources that lie in several parts need the rows before a part
    counted, and those are at most two a part.
    """
    dealt = stored(log.repartitionByRange("source", "ts", "id").withColumn("_part", F.spark_partition_id()))
    own = F.row_number().over(W.partitionBy("source", "_part").orderBy("ts", "id"))
    sizes = dealt.groupBy("source", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    later = stored(sizes.withColumn("_before", before).where("_before > 0").select(F.col("source").alias("_source"), F.col("_part").alias("_at"), "_before"))  # a row a part at most
    rows = dealt.withColumn("_own", own)
    joined = rows.join(F.broadcast(later), rows["source"].eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_at")), "left")
    return joined.withColumn("_pos", F.col("_own") + F.coalesce("_before", F.lit(0))).drop("_own", "_before", "_source", "_at", "_part")


def recent_success(log: DataFrame, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """log (source, ts, id, ok) with the share of successes among the last 20 requests and the failures in a row so far.

    A source's log is cut into windows of window_rows rows, each with the 19 rows before it, so no task orders a source as a whole;
    the last success of earlier windows is carried on, a row a window. Null ok is a failure; rows alike in source, ts
    and id are in no order of their own. Empty log: no rows.
    """
    rows = _numbered(log).withColumn("_ok", F.coalesce("ok", F.lit(False)))
    here = F.floor((F.col("_pos") - 1) / window_rows)
    at_end = (F.col("_pos") - 1) % window_rows >= window_rows - (LAST - 1)
    spread = rows.withColumn("_window", here).withColumn("_in", F.explode(F.when(at_end, F.array(F.col("_window"), F.col("_window") + 1)).otherwise(F.array("_window"))))
    w = W.partitionBy("source", "_in").orderBy("_pos")
    rate = F.avg(F.when(F.col("_ok"), 1.0).otherwise(0.0)).over(w.rowsBetween(1 - LAST, 0))
    near = F.max(F.when(F.col("_ok"), F.col("_pos"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    local = spread.withColumns({"success_rate": rate, "_near": near}).where("_in = _window")
    ends = rows.groupBy("source", here.alias("_w")).agg(F.max(F.when(F.col("_ok"), F.col("_pos"))).alias("_last"))
    carried = F.max("_last").over(W.partitionBy("source").orderBy("_w").rowsBetween(W.unboundedPreceding, -1))
    known = ends.withColumn("_carried", carried).where("_carried IS NOT NULL").select(F.col("source").alias("_source"), "_w", "_carried")
    out = local.join(known, local["source"].eqNullSafe(F.col("_source")) & (F.col("_window") == F.col("_w")), "left")
    failures = F.col("_pos") - F.coalesce("_near", "_carried", F.lit(0))
    return out.select(*log.columns, "success_rate", failures.cast("long").alias("failures"))


def moving_latency(values: Column) -> Column:
    """0.7 of the past and 0.3 of the new, folded over an ordered array; the first value stands for itself."""
    step = lambda acc, v: F.when(acc.isNull(), v).otherwise(acc * OLD + v * NEW)
    return F.aggregate(values, F.lit(None).cast("double"), step)


def moving_latencies(log: DataFrame) -> DataFrame:
    """(source, latency) of log (source, ts, id, ok, value): moving_latency over the successes in order of ts and id, without gathering them.

    Failures leave the latency as it is; a source without a success has none. Without a column ok all are
    successes. Steps are not rounded.

    An hour's rows are weighted among themselves; its sum then counts by OLD to the power of the number of later rows. So a
    source with many rows is spread by hour, and only one row an hour is ordered per source.
    """
    hour = F.date_trunc("hour", F.col("ts"))
    late = F.row_number().over(W.partitionBy("source", "_hour").orderBy(F.desc("ts"), F.desc("id"))) - 1
    parts = (log.where("ok") if "ok" in log.columns else log).withColumn("_hour", hour).withColumn("_late", late).groupBy("source", "_hour").agg(F.sum(F.lit(NEW) * F.col("value") * F.pow(F.lit(OLD), "_late")).alias("_sum"), F.count("*").alias("_n"), F.max_by("value", "_late").alias("_first"))
    by_hour = W.partitionBy("source").orderBy(F.desc("_hour"))
    after = F.coalesce(F.sum("_n").over(by_hour.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_after", after)
    # The first value of all stands for itself: it lacks the share that OLD would give to a past.
    first = F.min_by("_first", "_hour") * OLD * F.pow(F.lit(OLD), F.sum("_n") - 1)
    return parts.groupBy("source").agg((F.sum(F.col("_sum") * F.pow(F.lit(OLD), "_after")) + first).alias("latency"))


def breaker(events: Column) -> Column:
    """struct(state, failures, opened_at, trips) after an ordered array of (ts long seconds, ok): three failures open it, after the cool-down one trial closes or reopens it. Requests while it is open are not counted."""
    start = F.struct(F.lit("CLOSED").alias("state"), F.lit(0).alias("failures"), F.lit(None).cast("long").alias("opened_at"), F.lit(0).alias("trips"))

    def step(s: Column, e: Column) -> Column:
        waiting = (s["state"] == "OPEN") & (e["ts"] - s["opened_at"] < COOL_DOWN_S)
        trial = (s["state"] == "OPEN") & ~waiting
        failed = s["failures"] + 1
        opens = ~e["ok"] & (trial | (failed >= FAILURES))
        state = F.when(waiting, s["state"]).when(e["ok"], "CLOSED").when(opens, "OPEN").otherwise(s["state"])
        return F.struct(
            state.alias("state"),
            F.when(waiting, s["failures"]).when(e["ok"], 0).otherwise(failed).alias("failures"),
            F.when(waiting, s["opened_at"]).when(e["ok"], F.lit(None).cast("long")).when(opens, e["ts"]).otherwise(s["opened_at"]).alias("opened_at"),
            F.when(~waiting & opens, s["trips"] + 1).otherwise(s["trips"]).alias("trips"),
        )

    return F.aggregate(events, start, step)


END = "open boolean, failures long, carried boolean, opened_at long, trips long"
CHUNK = f"source {{kind}}, ts timestamp, id long, first long, ends array<struct<{END.replace(' ', ':').replace(',:', ',')}>>"


def _next(lane: tuple, ts: int, ok: bool) -> tuple[tuple, bool]:
    """breaker's step for a lane (opened_at or None if closed, failures, whether these add to the start's): the lane after it, and if it tripped."""
    opened_at, failures, carried = lane
    if opened_at is not None and ts - opened_at < COOL_DOWN_S:
        return lane, False
    if ok:
        return (None, 0, False), False
    opens = opened_at is not None or failures + 1 >= FAILURES
    return (ts if opens else opened_at, failures + 1, carried), opens


def _chunk_maps(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per source of a sorted partition: where its events lead from each state that the breaker may be in before them.

    Starts are FAILURES closed states, then open ones by the seconds left of the cool-down (0: a trial is due). Starts
    that have come to the same state go on as one, so memory and time hardly depend on their number.
    """
    starts = FAILURES + COOL_DOWN_S + 1
    source = head = lanes = None
    trips: list[int] = []

    def ended() -> pa.RecordBatch:
        ends: list = [None] * starts
        for (opened_at, failures, carried), members in lanes.items():
            for m in members:
                ends[m] = {"open": opened_at is not None, "failures": failures, "carried": carried, "opened_at": opened_at, "trips": trips[m]}
        return pa.RecordBatch.from_pylist([{"source": source, "ts": head[0], "id": head[1], "first": head[2], "ends": ends}], schema)

    for batch in batches:
        for key, at, i, ts, ok in zip(*(batch.column(c).to_pylist() for c in ("source", "ts", "id", "s", "ok")), strict=True):
            if lanes is None or key != source:
                if lanes is not None:
                    yield ended()
                source, head, trips = key, (at, i, ts), [0] * starts
                lanes = {(None, f, False): [f] for f in range(FAILURES)} | {(ts - COOL_DOWN_S + left, 0, True): [FAILURES + left] for left in range(COOL_DOWN_S + 1)}
            after: dict = {}
            for lane, members in lanes.items():
                new, opened = _next(lane, ts, ok)
                if opened:
                    for m in members:
                        trips[m] += 1
                if new in after:
                    after[new] += members
                else:
                    after[new] = members
            lanes = after
    if lanes is not None:
        yield ended()


def breakers(log: DataFrame) -> DataFrame:
    """(source, state, failures, trips): breaker over each source's rows of log (source, ts, id, ok) in order of ts and id, without gathering them.

    Rows are dealt by ranges of (source, ts, id), so a source with many rows is spread over many tasks. Each task reads its
    rows as a stream and gives, per source, one row of 124 states: where they lead from each state before them. A source has
    one such row per partition at most; these are folded in order. Rows without ok count as failures, rows without ts are left
    out; rows alike in source, ts and id lie in one task and failures come first. Empty log: no rows.
    """
    rows = log.where("ts is not null").select("source", F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), F.coalesce("ok", F.lit(False)).alias("ok"))
    dealt = rows.repartitionByRange("source", "ts", "id").sortWithinPartitions("source", "ts", "id", "ok")
    kind = CHUNK.format(kind=log.schema["source"].dataType.simpleString())
    schema = log.sparkSession.createDataFrame([], kind)
    chunks = dealt.mapInArrow(_mapper(pa.schema(schema.toArrow().schema)), kind)
    start = F.expr("struct(false AS open, 0L AS failures, CAST(NULL AS BIGINT) AS opened_at, 0L AS trips)")

    def step(s: Column, c: Column) -> Column:
        left = F.greatest(F.lit(0), s["opened_at"] + COOL_DOWN_S - c["first"])
        at = F.when(s["open"], left + FAILURES).otherwise(s["failures"]).cast("int")
        named = F.transform(F.array(F.get(c["ends"], at)), lambda e: F.struct(e["open"].alias("open"), (e["failures"] + F.when(e["carried"], s["failures"]).otherwise(0)).alias("failures"), e["opened_at"].alias("opened_at"), (s["trips"] + e["trips"]).alias("trips")))
        return named[0]

    folded = chunks.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "first", "ends"))).alias("c")).select("source", F.aggregate("c", start, step).alias("b"))
    return folded.select("source", F.when(F.col("b.open"), "OPEN").otherwise("CLOSED").alias("state"), F.col("b.failures").cast("int").alias("failures"), F.col("b.trips").cast("int").alias("trips"))


def _mapper(schema: pa.Schema):
    return lambda batches: _chunk_maps(batches, schema)


# The status of a run that gave part of its results, and the share of successes below which a source is weak.
PARTIAL, WEAK = "SOURCE_PARTIAL_RESULTS", 0.8


def half_open(state: Column, open_s: Column, cool_down_s: float = COOL_DOWN_S) -> Column:
    """The state as it is now: open_s seconds after it opened, an OPEN breaker lets one trial through once the cool-down is over."""
    return F.when((state == "OPEN") & (open_s >= cool_down_s), "HALF_OPEN").otherwise(state)


def status(enabled: Column, configured: Column, runs: Column, state: Column, open_s: Column, success_rate: Column, failures: Column, last_status: Column, cool_down_s: float = COOL_DOWN_S) -> Column:
    """NOT_CONFIGURED, DISABLED, HEALTHY, DOWN or DEGRADED of a source from its switches, breaker and last runs; null runs are none, null rates and statuses say nothing."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    now = half_open(state, open_s, cool_down_s)
    weak = yes(now != "CLOSED") | yes(success_rate < WEAK) | yes(failures > 0) | yes(last_status == PARTIAL)
    return F.when(~yes(configured), "NOT_CONFIGURED").when(~yes(enabled), "DISABLED").when(F.coalesce(runs, F.lit(0)) == 0, "HEALTHY").when(now == "OPEN", "DOWN").when(weak, "DEGRADED").otherwise("HEALTHY")
