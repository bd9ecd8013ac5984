"""Upserts, complement merges, funnels, suppression, brands of status: the relational operators on stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scoped(df: DataFrame, workspace: str, archived: bool = False) -> DataFrame:
    """Rows of one workspace that are not deleted, and not archived unless asked for: every read starts here."""
    out = df.where((F.col("workspace_id") == workspace) & F.col("deleted_at").isNull())
    return out if archived else out.where(F.col("archived_at").isNull())


def contains_text(columns: list[str], text: str) -> Column:
    """Any column contains text, in any case; % and _ are characters like others."""
    low = F.lit(text.lower())
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c)), low), F.lit(False)) for c in columns])


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; new must have one row per key."""
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti"))


def complement(existing: DataFrame, new: DataFrame, keys: list[str], fill: list[str], refresh: list[str] = ()) -> DataFrame:
    """existing with its empty `fill` fields filled from new and its `refresh` fields taken from new where new has the row; nothing else changes."""
    own = new.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in [*fill, *refresh]])
    joined = existing.join(own, keys, "left")
    empty = lambda c: F.nullif(F.col(c), F.lit("")) if dict(existing.dtypes)[c] == "string" else F.col(c)
    changed = {c: F.coalesce(empty(c), F.col(f"_{c}")) for c in fill} | {c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in refresh}
    return joined.withColumns(changed).select(*existing.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def union_first(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of all sources; of rows with one key that of the first source."""
    tagged = [s.withColumn("_s", F.lit(i)) for i, s in enumerate(sources)]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return first_per_key(whole, [key], [F.col("_s")]).drop("_s")


def removed_by(filters: dict[str, Column]) -> Column:
    """The first filter that a row meets, by name; null if it stays. Each removed row is counted under one name."""
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in filters.items()])


def funnel(df: DataFrame, filters: dict[str, Column]) -> DataFrame:
    return df.groupBy(F.coalesce(removed_by(filters), F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


def ratio(num: Column, den: Column) -> Column:
    """Whole percent, null when there is nothing to divide by."""
    return F.when(den > 0, F.floor(num / den * 100 + 0.5))


def suppressed(contacts: DataFrame, suppression: DataFrame, channel: str) -> DataFrame:
    """contacts with blocked: suppressed for the channel or for all."""
    keys = suppression.where(F.col("channel").isin(channel, "all")).select("contact").distinct().withColumn("_b", F.lit(True))
    return contacts.join(keys, "contact", "left").withColumn("blocked", F.coalesce("_b", F.lit(False))).drop("_b")


def move_stage(companies: DataFrame, ids: DataFrame, stage: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(companies with the stage of the given ids changed, the history rows of those that moved)."""
    moved = companies.join(ids.select("company_id").distinct(), "company_id", "left_semi").where(~F.col("stage").eqNullSafe(F.lit(stage)))
    history = moved.select("company_id", F.col("stage").alias("from_stage"), F.lit(stage).alias("to_stage"), at.alias("moved_at"))
    changed = moved.withColumn("stage", F.lit(stage))
    return companies.join(changed.select("company_id"), "company_id", "left_anti").unionByName(changed), history


def record_outreach(outreach: DataFrame, suppression: DataFrame, channel: str, follow_up_days: int = 3) -> tuple[DataFrame, DataFrame]:
    """(outreach that may go out, with the stage and follow-up it sets; outreach that suppression blocks)."""
    marked = suppressed(outreach, suppression, channel)
    due = F.col("sent_at") + F.expr(f"interval {follow_up_days} days")
    return marked.where(~F.col("blocked")).drop("blocked").withColumns({"stage": F.lit("CONTACTED"), "follow_up_at": due}), marked.where("blocked").drop("blocked")


def resolve_conflict(df: DataFrame, value: Column) -> Column:
    """The value if it is one of the alternatives (array<struct<value>>), else null: nothing else is accepted."""
    return F.when(F.exists("alternatives", lambda a: a["value"] == value), value)


def merge_maps(old: Column, new: Column) -> Column:
    """Both maps; the old value wins."""
    return F.map_zip_with(old, new, lambda _, a, b: F.coalesce(a, b))


def keep_recent(df: DataFrame, at: str, as_of: Column, days: int = 30) -> DataFrame:
    return df.where(F.col(at) > as_of - F.expr(f"interval {days} days"))
