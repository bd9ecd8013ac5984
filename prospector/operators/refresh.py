"""Incremental entity resolution: when records change, only what they touch is taken apart and resolved again.

A change touches the records that came, changed or went, and those of a block key whose size crosses the cap, as its pairs appear or
vanish. Pairs of touched records are made and judged anew; all other evidence is kept by anti-join. The connected
components of sure links that hold a touched record, before or after, are clustered again, which may join or split
clusters; members and reviews of all others are kept.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import stored
from .resolve import BLOCK_CAP, block_keys, block_levels, classify, merged, review_pairs


class Resolved(NamedTuple):
    """Tables of a resolution: prepared records; (idx, key); (a, b, level); (idx, component, cluster, confidence); (a, b, level) to review."""

    records: DataFrame
    keys: DataFrame
    levels: DataFrame
    members: DataFrame
    reviews: DataFrame


def resolved(p: DataFrame, cap: int = BLOCK_CAP) -> Resolved:
    """The full resolution of prepared records, one row an idx."""
    p = stored(p)
    keys = stored(block_keys(p))
    levels = stored(block_levels(p, keys, cap))
    members, reviews = merged(p, levels)
    members = stored(members)
    return Resolved(p, keys, levels, members, stored(reviews))


def _without(df: DataFrame, ids: DataFrame, *cols: str) -> DataFrame:
    names = df.columns
    for c in cols:
        df = df.join(ids.select(F.col("idx").alias(c)), c, "left_anti")
    return df.select(*names)


def _within(df: DataFrame, ids: DataFrame, *cols: str) -> DataFrame:
    names = df.columns
    for c in cols:
        df = df.join(ids.select(F.col("idx").alias(c)), c, "left_semi")
    return df.select(*names)


def touched_records(old: Resolved, keys: DataFrame, gone: DataFrame, cap: int) -> DataFrame:
    """idx of the records that changed, and of those, at most cap a key, whose key crossed the cap."""
    of_change = _within(old.keys, gone, "idx").select("key").union(_within(keys, gone, "idx").select("key")).distinct()
    sizes = lambda k, name: k.join(of_change, "key", "left_semi").groupBy("key").agg(F.count("*").alias(name))
    both = sizes(old.keys, "was").join(sizes(keys, "now"), "key", "full").na.fill(0)
    crossed = stored(both.where((F.col("was") > cap) != (F.col("now") > cap)))
    holders = old.keys.join(crossed.where(F.col("was") <= cap), "key", "left_semi").select("idx").union(keys.join(crossed.where(F.col("now") <= cap), "key", "left_semi").select("idx"))
    return stored(gone.union(holders).distinct())


def touching_pairs(keys: DataFrame, touched: DataFrame, cap: int) -> DataFrame:
    """Distinct (a, b), a < b, that share a key of 2 to cap records and hold a touched one."""
    own = _within(keys, touched, "idx")
    near = keys.join(own.select("key").distinct(), "key", "left_semi")
    sizes = near.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n").between(2, cap)).select("key")
    both = own.join(sizes, "key").join(near.select("key", F.col("idx").alias("other")), "key").where("idx <> other")
    return both.select(F.least("idx", "other").alias("a"), F.greatest("idx", "other").alias("b")).distinct()


def refreshed(old: Resolved, changed: DataFrame, removed: DataFrame, cap: int = BLOCK_CAP) -> Resolved:
    """old with changed (prepared records, new or in place of those of their idx) and without removed (idx): the rows of resolved() over what is there then.

    An idx in both stays, as changed. Unknown idx in removed, and no changes at all, change nothing. Null idx are left out.
    """
    changed = stored(changed.where("idx is not null").dropDuplicates(["idx"]))
    gone = stored(changed.select("idx").union(removed.select("idx")).where("idx is not null").distinct())
    records = stored(_without(old.records, gone, "idx").unionByName(changed))
    keys = stored(_without(old.keys, gone, "idx").unionByName(block_keys(changed)))
    touched = touched_records(old, keys, gone, cap)
    fresh = stored(classify(records, touching_pairs(keys, touched, cap)))
    levels = stored(_without(old.levels, touched, "a", "b").unionByName(fresh))
    sure = fresh.where("level in ('EXACT', 'HIGH')")
    reached = touched.union(sure.select("a")).union(sure.select("b")).distinct()
    parts = _within(old.members, reached, "idx").select("component").distinct()
    again = stored(old.members.join(parts, "component", "left_semi").select("idx").union(reached).distinct())
    own, _ = merged(_within(records, again, "idx"), _within(levels, again, "a", "b"))
    members = stored(_without(old.members, again, "idx").unionByName(own.select(*old.members.columns)))
    near = _within(levels, again, "a").union(_without(_within(levels, again, "b"), again, "a"))
    reviews = stored(_without(old.reviews, again, "a", "b").unionByName(review_pairs(near, members)))
    return Resolved(records, keys, levels, members, reviews)
