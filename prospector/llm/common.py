"""Shared pieces of the corpus operators: tables, the shared folder, and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters `[\x20\x09-\x0D]`.
ASCII_SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all runs on this machine (tests), one of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="prospector-")
    return _LOCAL[app]


_NOTED: ContextVar[list[str] | None] = ContextVar("tables", default=None)


@contextmanager
def noted_tables() -> Iterator[list[str]]:
    """The paths of the tables that are made inside, in order: those of this thread and block alone."""
    made: list[str] = []
    before = _NOTED.set(made)
    try:
        yield made
    finally:
        _NOTED.reset(before)


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    if (made := _NOTED.get()) is not None:
        made.append(path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, and gives the planner true sizes."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Removes every table that this application left in the shared folder; call it once results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: At most so many keys are hot: a key is hot if it holds more than its share of rows, so there can't be more.
HOT_KEYS = 10_000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, how: str = "left", least: int = 200) -> DataFrame:
    """left joined with right (a written table, one row per key) on keys, where right[count] is at least the number of left rows of a key.

    Keys of more than max(least, all / HOT_KEYS) rows are broadcast, HOT_KEYS rows at most by that rule; so no task gets
    more rows of one key than that. The other keys shuffle. right's count column is dropped. Null keys match nothing.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = right.where(F.col(count) > max(least, total // HOT_KEYS)).drop(count)
    cold = right.where(F.col(count) <= max(least, total // HOT_KEYS)).drop(count)
    if hot.isEmpty():
        return left.join(cold, keys, how)
    small = F.broadcast(hot)
    return left.join(small, keys).unionByName(left.join(small.select(*keys), keys, "left_anti").join(cold, keys, how))


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else as it is. For pure ASCII, lower() does just that, and faster."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.StringArray:
    """A text column with null as empty text, offsets of 32 bits."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def slices(texts: pa.StringArray, limit: int = 1 << 20):
    """(first, last) row ranges with about `limit` bytes of text each; a longer text is one range of its own."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, n in enumerate(size):
        if total and total + n > limit:
            yield first, i
            first, total = i, 0
        total += int(n)
    if first < len(size):
        yield first, len(size)
