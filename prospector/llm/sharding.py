"""Operator 10, sharding: a uniform shuffle with exact shard sizes from a hypergeometric communication matrix.

The driver knows only how many rows each partition holds. It draws the matrix of partition-to-shard counts from the
multivariate hypergeometric law, the law a uniform permutation of all rows would give. Each partition permutes its rows
locally (a sort by a seeded hash) and is written with each row's place in it; counts are read from what was written, so they
hold however later jobs lay out their scans and whatever executors come and go. By its matrix row a partition deals its rows out, one exchange moves them, and each shard is permuted
again. Row (partition p, place i) alone decides shard and bucket, so bucket sizes are counted without reading texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

#: Bytes per bucket of the second permutation, about: what one task sorts.
BUCKET_BYTES = 4 << 20
#: Most partitions the matrix is drawn for (times 24 shards: some 50 MB); more are coalesced, without a shuffle: at 100 TB a task then reads some 400 MB.
MAX_PARTITIONS = 1 << 18


def communication_matrix(rows: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """counts[p, s] of partition p's rows that go to shard s: each row sums to rows[p], each column to sizes[s]."""
    rng, left = np.random.default_rng(seed), np.array(sizes, np.int64)
    out = np.zeros((len(rows), len(sizes)), np.int64)
    for p, n in enumerate(rows):
        out[p] = rng.multivariate_hypergeometric(left, n, method="marginals")
        left -= out[p]
    return out


def shard_rows(df: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """df with shard (int) and slot (long, gapless from 0 in each shard); shard sizes differ by one at most.

    Every row counts, whatever it holds: nulls, repeated rows and ties are rows like others. Columns of df named shard
    or slot are replaced, all others pass through, whatever their names. Empty table: no rows. df may be any DataFrame: it is read once,
    and its rows written to the shared folder with their places. A row without a place among the counted ones fails the query.
    """
    df = df.drop("shard", "slot")
    spark = df.sparkSession
    if df.rdd.getNumPartitions() > MAX_PARTITIONS:
        df = df.coalesce(MAX_PARTITIONS)
    wide = sum((F.coalesce(F.octet_length(df[c]), F.lit(0)).cast("long") if t in ("string", "binary") else F.lit(16) for c, t in df.dtypes), F.lit(0).cast("long"))
    local = df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"), wide.alias("_bytes")).withColumn("_key", F.xxhash64(F.lit(seed), "_row")).sortWithinPartitions("_key")
    rows = written(local.select("_row", "_bytes", F.monotonically_increasing_id().alias("_place")), "shard-places")
    here, index = F.shiftright("_place", 33).cast("int").alias("_p"), F.col("_place").bitwiseAND(2**33 - 1).alias("_i")
    sums = rows.groupBy(here).agg(F.count("*").alias("n"), F.sum("_bytes").alias("bytes")).toPandas()  # a row per partition
    counts = dict(zip(sums["_p"].tolist(), sums["n"].tolist(), strict=True))
    total, parts = sum(counts.values()), sorted(counts)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([counts[p] for p in parts], sizes, seed)
    bounds = spark.createDataFrame(pa.table({"_p": pa.array(parts, pa.int32()), "_bounds": pa.array(list(np.cumsum(matrix, axis=1)), pa.list_(pa.int64()))}))
    buckets = max(1, -(-int(sums["bytes"].sum()) // (shards * BUCKET_BYTES)))

    def labelled(rows: DataFrame) -> DataFrame:
        """rows with _place, and by it alone _p, _i, _shard, _bucket and _draw."""
        rows = rows.withColumns({"_p": here, "_i": index}).join(F.broadcast(bounds), "_p", "left")  # a row per partition
        draw = F.xxhash64(F.lit(seed + 1), "_p", "_i")
        shard = F.size(F.filter("_bounds", lambda b: b <= F.col("_i")))
        counted = F.coalesce(F.element_at("_bounds", -1) > F.col("_i"), F.lit(False))
        shard = F.when(counted, shard).otherwise(F.raise_error(F.lit("a row was not counted")).cast("int"))
        return rows.withColumns({"_shard": shard, "_draw": draw}).withColumn("_bucket", F.pmod(F.shiftright("_draw", 17), F.lit(buckets))).drop("_bounds")

    tally = labelled(rows.select("_place")).groupBy("_shard", "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = written(tally.select("_shard", "_bucket", before.alias("_before")), "shard-offsets")  # shards x buckets rows

    rank = F.row_number().over(W.partitionBy("_shard", "_bucket").orderBy("_draw", "_p", "_i"))
    placed = labelled(rows.select("_row", "_place")).withColumn("_rank", rank).join(offsets, ["_shard", "_bucket"])
    return placed.select(*[F.col("_row")[c].alias(c) for c in df.columns], F.col("_shard").alias("shard"), (F.col("_before") + F.col("_rank") - 1).alias("slot"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = shard_rows(docs, 24)
    return out.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
