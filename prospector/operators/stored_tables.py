"""Stored tables that change in part: rows lie in folders by a hash of their key, and a change rewrites the folders that it touches only.

A write replaces whole folders when it commits (dynamic partition overwrite), so a failed one leaves the old rows, and files of other
folders keep their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import stored

FOLDER = "_folder"
#: Rows that one task sorts; wide rows of a task are its memory.
ROWS_A_TASK = 50_000


def _placed(rows: DataFrame, keys: list[str], folders: int) -> DataFrame:
    return rows.withColumn(FOLDER, F.pmod(F.xxhash64(*keys), F.lit(folders)).cast("int"))


def by_keys(rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    """Rows of a key in one task, ROWS_A_TASK a task: more rows make more tasks, not larger ones."""
    return rows.repartition(-(-count // ROWS_A_TASK) or 1, *keys)


def _dealt(rows: DataFrame, keys: list[str], folders: int, count: int) -> DataFrame:
    """A folder's rows in one task, or in as many as they need, a file each."""
    shares = -(-count // (folders * ROWS_A_TASK))
    if shares <= 1:
        return rows.repartition(FOLDER)
    return rows.repartition(folders * shares, FOLDER, F.pmod(F.xxhash64(F.lit("share"), *keys), F.lit(shares)))


def _replace(rows: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Each folder that rows (stored) have anything of becomes just these rows. keys: columns by which a large folder is dealt, by default all but maps, which have no hash."""
    own = keys or [c for c, kind in rows.dtypes if c != FOLDER and "map<" not in kind]
    folders, count = rows.agg(F.count_distinct(FOLDER), F.count("*")).first()
    _dealt(rows, own, max(folders, 1), count).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(FOLDER).parquet(path)


def create(rows: DataFrame, path: str, keys: list[str], folders: int) -> None:
    """A new table at path, its rows in at most `folders` folders by keys; null keys are keys like others."""
    _dealt(_placed(rows, keys, folders), keys, folders, rows.count()).write.partitionBy(FOLDER).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(FOLDER)


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], folders: int, latest: Column | None = None) -> None:
    """Puts rows into the table in place of those of equal keys; of several rows of a key the one that comes last by `latest` counts, an arbitrary one without it.

    folders is the number that the table was created with. rows have the table's columns. No rows change nothing.
    """
    rows = by_keys(rows, keys, rows.count())
    if latest is not None:
        last = F.row_number().over(W.partitionBy(*keys).orderBy(latest.desc_nulls_last()))
        rows = rows.withColumn("_last", last).where("_last = 1").drop("_last")
    else:
        rows = rows.dropDuplicates(keys)
    new = stored(_placed(rows, keys, folders))
    touched = [r[FOLDER] for r in new.select(FOLDER).distinct().collect()]  # at most `folders`
    if not touched:
        return
    old = spark.read.parquet(path).where(F.col(FOLDER).isin(*touched))
    same = new.select(*[F.col(k).alias(f"_new_{k}") for k in keys])
    equal = F.lit(True)
    for k in keys:
        equal = equal & old[k].eqNullSafe(F.col(f"_new_{k}"))
    kept = old.join(same.hint("shuffle_hash"), equal, "left_anti")  # only the keys are held, old rows pass by unsorted
    _replace(stored(kept.unionByName(new.select(*kept.columns))), path, keys)


def retain(spark: SparkSession, path: str, keep: Column) -> int:
    """Removes rows for which keep doesn't hold; the number of them. Only folders that hold such rows are read again and rewritten."""
    table = spark.read.parquet(path)
    stays = F.coalesce(keep, F.lit(False))
    counts = {r[FOLDER]: (r["gone"], r["left"]) for r in table.groupBy(FOLDER).agg(F.count_if(~stays).alias("gone"), F.count_if(stays).alias("left")).collect()}  # a row a folder
    touched = [f for f, (gone, _) in counts.items() if gone]
    if touched:
        rows = stored(table.where(F.col(FOLDER).isin(*touched)).where(stays))
        _replace(rows, path)
    for f in touched:
        if not counts[f][1]:  # no row is left to replace the folder with
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{FOLDER}={f}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return sum(gone for gone, _ in counts.values())
