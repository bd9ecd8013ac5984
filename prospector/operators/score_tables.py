"""Scores that are kept: a row for each company, its factors in it, so that a score and what explains it never come apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stored_tables

COLUMNS = ["company_id", "score", "level", "category_scores", "factors", "data_quality", "computed_at"]


def keep_scores(spark: SparkSession, path: str, scored: DataFrame, folders: int) -> None:
    """Puts scores as `prospect_score` gives them (with company_id, data_quality and computed_at, none of the last null) into the table at path, made with this number of folders if there is none.

    A company's new row takes the place of its old one, factors that no longer count included; of several rows of a company
    in scored the one computed last counts. Only folders of these companies are rewritten; a failed write leaves the old rows.
    """
    rows = scored.select(*COLUMNS)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        last = stored_tables.by_keys(rows, ["company_id"], rows.count()).groupBy("company_id").agg(F.max_by(F.struct(*COLUMNS[1:]), "computed_at").alias("r"))
        stored_tables.create(last.select("company_id", "r.*"), path, ["company_id"], folders)
        return
    stored_tables.upsert(spark, path, rows, ["company_id"], folders, F.col("computed_at"))


def factors(table: DataFrame) -> DataFrame:
    """(company_id, rule, category, points): a row for each rule that counts."""
    return table.select("company_id", F.explode("factors").alias("f")).select("company_id", "f.*")


def stale(table: DataFrame, before: Column) -> DataFrame:
    """Companies whose score was computed before a moment."""
    return table.where(F.col("computed_at") < before).select("company_id")
