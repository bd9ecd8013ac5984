"""Pairs of records that share a key: parts of the records meet two by two, so that pairs are made once and never shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import stored

BLOCK_CAP = 400
#: Keys of the records of a part, of which two meet in a task; the fewest parts, for work of small tables on many cores; shared keys that a task looks at at once.
PART_KEYS = 2_000_000
LEAST_PARTS = 8
PAIRS_A_STEP = 4_000_000


def _pairs_of_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (a, b) of records of one cell, a from the lower part and b from the higher, that share a key; some PAIRS_A_STEP places at a time."""
    rows = pa.Table.from_batches(list(batches)).sort_by("idx").combine_chunks()
    idx, low, high = (rows[c].to_numpy() for c in ("idx", "low", "high"))
    lists = rows["numbers"].combine_chunks()
    keys, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(idx)), lists.value_lengths().to_numpy())
    key, of = keys[high[owner]], owner[high[owner]]
    order = np.argsort(key)
    key, of = key[order], of[order]
    asked, by = keys[low[owner]], owner[low[owner]]
    first = np.searchsorted(key, asked)
    n = np.searchsorted(key, asked, "right") - first
    ends = np.append(0, np.cumsum(n))
    lasts = np.append(np.flatnonzero(np.diff(by)) + 1, len(by))  # where a record of the lower part ends
    start = 0
    while start < len(by):
        stop = lasts[min(np.searchsorted(ends[lasts], ends[start] + PAIRS_A_STEP), len(lasts) - 1)]
        m = n[start:stop]
        at = np.repeat(first[start:stop] - ends[start:stop], m) + np.arange(ends[start], ends[stop])
        x, y = np.repeat(by[start:stop], m), of[at]
        pair = np.sort((x * len(idx) + y)[x < y])
        pair = pair[np.append(True, pair[1:] != pair[:-1])[: len(pair)]]
        yield pa.record_batch([pa.array(idx[pair // len(idx)]), pa.array(idx[pair % len(idx)])], ["a", "b"])
        start = stop


def candidate_pairs(keys: DataFrame, cap: int = BLOCK_CAP, part_keys: int = PART_KEYS) -> DataFrame:
    """Distinct (a, b), a < b, that share a key of 2 to cap records; idx is a long.

    Records are dealt by ranges of idx into parts of about part_keys kept keys, and each two parts meet in a task, which makes a pair once
    whatever it shares. So a record's keys, as numbers, go to as many tasks as there are parts, and pairs, far more, through no shuffle.
    """
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n").between(2, cap))
    sizes = stored(sizes.select("key", F.monotonically_increasing_id().alias("number")))
    held = keys.where("idx is not null").join(sizes.hint("merge"), "key").groupBy("idx").agg(F.array_sort(F.collect_set("number")).alias("numbers"))  # a record's own keys
    held = stored(held.select(F.col("idx").cast("long").alias("idx"), "numbers"))
    total = held.agg(F.coalesce(F.sum(F.size("numbers")), F.lit(0))).first()[0]
    parts = max(LEAST_PARTS, -(-total // part_keys))
    cuts = held.select("idx", F.explode("numbers")).agg(F.percentile_approx("idx", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("idx"))) if cuts else F.lit(0)
    met = held.withColumn("part", part).select("idx", "numbers", "part", F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))).alias("other"))
    met = met.select("idx", "numbers", (F.col("part") <= F.col("other")).alias("low"), (F.col("part") >= F.col("other")).alias("high"), (F.least("part", "other") * (len(cuts) + 1) + F.greatest("part", "other")).alias("cell"))
    return met.groupBy("cell").applyInArrow(_pairs_of_cell, "a long, b long")
