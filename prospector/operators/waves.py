"""Sources run in waves: each isolated, counted in the pass that writes it, and followed by its fallbacks where it fails or yields little."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .search import FAILED

# Fixed value: fewer results than this are a low yield.
LOW_YIELD = 20
RUN = "source string, status string, returned long, invalid long, fallback boolean, message string, seconds double, path string"


@dataclass(frozen=True)
class Source:
    """read makes the source's rows; fallbacks are names of further sources. configured False, or a breaker that is open, is told by its status."""

    name: str
    read: Callable[[], DataFrame]
    fallbacks: list[str] = field(default_factory=list)
    configured: bool = True
    open: bool = False


def _run(source: Source, path: str, valid: Column, fallback: bool) -> tuple:
    began = time.monotonic()
    row = lambda status, returned=0, invalid=0, message=None, at=None: (source.name, status, returned, invalid, fallback, message, round(time.monotonic() - began, 3), at)
    if not source.configured:
        return row("SOURCE_NOT_CONFIGURED")
    if source.open:
        return row("SOURCE_CIRCUIT_OPEN")
    seen, at = Observation(f"{source.name}-{uuid.uuid4().hex}"), f"{path}/source={source.name}"
    try:
        rows = source.read().withColumn("_valid", F.coalesce(valid, F.lit(False)))
        counted = rows.observe(seen, F.count_if("_valid").alias("valid"), F.count_if(~F.col("_valid")).alias("invalid"))
        counted.where("_valid").drop("_valid").write.mode("overwrite").parquet(at)
        n = seen.get
    except Exception as error:  # a source that throws must not take the others with it; it is told, with what it said
        return row("SOURCE_ERROR", message=str(error).split("\n")[0][:500])
    status = "NO_RESULTS_FROM_SOURCE" if not n["valid"] else "SOURCE_SUCCESS_WITH_WARNINGS" if n["invalid"] else "SOURCE_SUCCESS"
    return row(status, n["valid"], n["invalid"], at=at)


def run_sources(spark: SparkSession, sources: list[Source], first: list[str], path: str, valid: Column, low_yield: int = LOW_YIELD) -> DataFrame:
    """A row of RUN per source that ran: those of first, and, once each, the fallbacks of those that failed or gave fewer than low_yield valid rows.

    Rows of a source for which valid holds are written to path/source=<name>, in place of what lay there; they are
    counted as they are written, without a second scan. Fallbacks of fallbacks aren't followed. A failed write leaves no
    path in its row, and what it left is not read.
    """
    by_name, runs = {s.name: s for s in sources}, []
    launched = set(first)
    for name in first:
        runs.append(_run(by_name[name], path, valid, False))
        if runs[-1][1] in FAILED or runs[-1][2] < low_yield:
            for other in by_name[name].fallbacks:
                if other in by_name and other not in launched:
                    launched.add(other)
                    runs.append(_run(by_name[other], path, valid, True))
    return spark.createDataFrame(runs, RUN)


def results_of(spark: SparkSession, runs: DataFrame) -> DataFrame | None:
    """The rows of all runs that gave some, with source; columns that a source lacks are null. None if there are none."""
    out = None
    for r in runs.where("returned > 0").select("source", "path").collect():  # a row a source
        rows = spark.read.parquet(r["path"]).withColumn("source", F.lit(r["source"]))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
