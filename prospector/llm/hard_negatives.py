"""Operator 11, hard-negative mining: integer scores of each anchor with all rows, sorted, and read from each positive's upper limit on.

Anchors are taken in blocks of a bounded size, and each block meets all rows in two passes without a shuffle of vectors. A task
scores its rows against the block by matrix products, sorts each anchor's scores (ties by the smaller id) and keeps what
can still be among the first of all rows: the nearest rows of the anchor's label in the first pass, and in the second, by
binary search for each positive's upper limit, the first rows of other labels down to the lower one. What tasks keep is
merged by rank: a task hands on at most `positives` and `positives * negatives` rows per anchor, so no anchor's scores are
ever gathered. The work is rows times anchors, and passes over the rows are twice the number of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch_path, table, written

#: Components are multiplied by this and rounded down.
SCALE = 256
#: A block of anchors holds at most so many, and about so many bytes of codes: what a task holds besides its rows.
ANCHORS, ANCHOR_BYTES = 32_768, 32 << 20
#: Anchors and rows that are multiplied at once.
ANCHORS_AT_ONCE, ROWS_AT_ONCE = 256, 4096
#: Rows whose codes have a squared norm from here on take no part: their scores need not fit 64 bits.
LARGEST = 2.0**59
_NONE, _LAST = -(2**62), np.iinfo(np.int64).max


def coded(batch: pa.RecordBatch):
    """(ids, labels, codes) for each number of components in the batch, codes as whole numbers in doubles; rows that take no part are left out."""
    lists = batch.column("embedding")
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(size) - size
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    there = lists.is_valid().to_numpy(zero_copy_only=False) & batch.column("id").is_valid().to_numpy(zero_copy_only=False) & batch.column("label").is_valid().to_numpy(zero_copy_only=False)
    ids, labels = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("id", "label"))
    for d in np.unique(size[there]):
        own = np.flatnonzero(there & (size == d))
        for at in range(0, len(own), ROWS_AT_ONCE):
            some = own[at : at + ROWS_AT_ONCE]
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(flat[begin[some][:, None] + np.arange(d)] * SCALE)
                fine = np.isfinite(x).all(1) & ((x * x).sum(1) < LARGEST)
            if fine.any():
                yield ids[some[fine]], labels[some[fine]], x[fine]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: all sums along the way are below the product of the norms, so the narrowest exact type multiplies."""
    bound = float(np.sqrt((a * a).sum(1).max(initial=0) * (b * b).sum(1).max(initial=0))) * (1 + 1e-9)
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


class Block:
    """Anchors of a block, by number of components: places in the block, ids, labels and codes."""

    def __init__(self, anchors: pa.Table):
        self.n = len(anchors)
        self.ids, self.labels = (anchors.column(c).to_numpy() for c in ("id", "label"))
        lists = anchors.column("codes").combine_chunks()
        size, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        begin = np.cumsum(size, dtype=np.int64) - size
        self.of_size = {int(d): (own := np.flatnonzero(size == d), flat[begin[own][:, None] + np.arange(d)]) for d in np.unique(size)}

    def parts(self, d: int):
        """(places, codes) of at most ANCHORS_AT_ONCE anchors with d components."""
        own, codes = self.of_size.get(d, (np.zeros(0, np.int64), None))
        for at in range(0, len(own), ANCHORS_AT_ONCE):
            yield own[at : at + ANCHORS_AT_ONCE], codes[at : at + ANCHORS_AT_ONCE]


def _rows(keys: dict[str, np.ndarray]):
    for at in range(0, len(next(iter(keys.values()))), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(v[at : at + 10_000]) for v in keys.values()], names=list(keys))


def _positives(shared, k: int):
    """The first k other rows of each anchor's label among a task's rows."""

    def run(batches):
        block: Block = shared.value
        best, who = np.full((block.n, k), _NONE), np.full((block.n, k), _LAST)
        for batch in batches:
            for ids, labels, codes in coded(batch):
                for label in np.unique(labels):
                    own = np.flatnonzero(labels == label)
                    for places, anchors in block.parts(codes.shape[1]):
                        mine = block.labels[places] == label
                        if not mine.any():
                            continue
                        a = places[mine]
                        s, d = scores(anchors[mine], codes[own]), np.broadcast_to(ids[own], (len(a), len(own)))
                        itself = block.ids[a][:, None] == d
                        s, d = np.hstack([best[a], np.where(itself, _NONE, s)]), np.hstack([who[a], np.where(itself, _LAST, d)])
                        first = np.lexsort((d, -s))[:, :k]
                        best[a], who[a] = np.take_along_axis(s, first, 1), np.take_along_axis(d, first, 1)
        a, j = np.nonzero(best != _NONE)
        yield from _rows({"a": a.astype(np.int32), "id": who[a, j], "score": best[a, j]})

    return run


def _negatives(shared, k: int, low: int, high: int):
    """For each anchor and positive, the first k rows of other labels within the limits among a task's rows."""

    def run(batches):
        block, found = shared.value
        limits = [[(-(-low * p // 100), high * p // 100) for p in own] for own in found]
        best = {a: [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in own] for a, own in enumerate(limits) if own}
        for batch in batches:
            for ids, labels, codes in coded(batch):
                for places, anchors in block.parts(codes.shape[1]):
                    every = scores(anchors, codes)
                    order = np.lexsort((np.broadcast_to(ids, every.shape), -every))
                    for i, a in enumerate(places.tolist()):
                        if not limits[a]:
                            continue
                        sorted_rows = order[i][labels[order[i]] != block.labels[a]]
                        falling = -every[i][sorted_rows]
                        begin = np.searchsorted(falling, [-up for _, up in limits[a]], "left").tolist()
                        end = np.searchsorted(falling, [-least for least, _ in limits[a]], "right").tolist()
                        for j, (b, e) in enumerate(zip(begin, end, strict=True)):
                            own_s, own_d = best[a][j]
                            if b >= e or len(own_s) == k and -falling[b] < own_s[-1]:
                                continue
                            read = slice(b, min(b + k, e))
                            s, d = np.concatenate([own_s, -falling[read]]), np.concatenate([own_d, ids[sorted_rows[read]]])
                            first = np.lexsort((d, -s))[:k]
                            best[a][j] = s[first], d[first]
        out = [(a, j, *pair) for a, own in best.items() for j, pair in enumerate(own) if len(pair[0])]
        if out:
            n = [len(s) for _, _, s, _ in out]
            places = {c: np.repeat(np.array([o[i] for o in out], np.int32), n) for i, c in enumerate("aj")}
            yield from _rows(places | {"id": np.concatenate([o[3] for o in out]), "score": np.concatenate([o[2] for o in out])})

    return run


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, anchors_at_most: int = ANCHORS) -> DataFrame:
    """Hard negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors holds vec_id, label (both whole numbers) and embedding; is_anchor chooses its anchors. A row's score is the
    inner product of its codes, floor(256 * x), with the anchor's; higher scores come first, ties by smaller vec_id. An
    anchor's positives are its first `positives` rows of its label with another vec_id. Its negatives for one of them
    are the first `negatives` rows of other labels with low * positive_score <= 100 * score <= high * positive_score.

    Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part, nor do rows whose
    codes have a squared norm of 2**59 or more (of 64 components, if one is beyond 2,965,820 in size). Vectors of other lengths don't
    meet; vectors without components score 0. Repeated rows are rows like others, but an anchor that repeats as a whole
    is one. A negative positive score leaves no room between the limits, so no rows. Other columns have no say. Empty table, or no anchors: no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), is_anchor.alias("_anchor"))

    def anchor_rows(batches):
        for batch in batches:
            for ids, labels, codes in coded(batch):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.reshape(-1) + 0.0))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), lists], names=["id", "label", "codes"])

    of_anchors = rows.where("_anchor").drop("_anchor").mapInArrow(anchor_rows, "id long, label long, codes array<double>").distinct()
    anchors = written(of_anchors, "anchors")
    total, size = anchors.agg(F.count("*"), F.sum(F.size("codes"))).first()
    blocks = max(1, -(-total // anchors_at_most), -(-8 * (size or 0) // ANCHOR_BYTES))
    rows, path = rows.drop("_anchor"), scratch_path(spark, "hard-negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for b in range(blocks):
        held = anchors.where(F.pmod(F.xxhash64("id", "label", "codes"), F.lit(blocks)) == b).toArrow()  # a block: its size is bounded
        block = Block(held)
        shared = spark.sparkContext.broadcast(block)
        near = rows.mapInArrow(_positives(shared, positives), "a int, id long, score long")
        first = W.partitionBy("a").orderBy(F.desc("score"), "id")
        near = near.withColumn("j", F.row_number().over(first) - 1).where(F.col("j") < positives).toArrow().sort_by([("a", "ascending"), ("j", "ascending")])
        found: list[list[int]] = [[] for _ in range(block.n)]
        for a, p in zip(near.column("a").to_pylist(), near.column("score").to_pylist(), strict=True):
            found[a].append(p)
        known = spark.createDataFrame(pa.table({"a": near.column("a"), "j": near.column("j"), "anchor_id": pa.array(block.ids[near.column("a").to_numpy()], pa.int64()), "positive_id": near.column("id"), "positive_score": near.column("score")}), "a int, j int, anchor_id long, positive_id long, positive_score long")
        both = spark.sparkContext.broadcast((block, found))
        far = rows.mapInArrow(_negatives(both, negatives, low, high), "a int, j int, id long, score long")
        rank = F.row_number().over(W.partitionBy("a", "j").orderBy(F.desc("score"), "id"))
        kept = far.withColumn("rank", rank).where(F.col("rank") <= negatives)
        out = kept.join(F.broadcast(known), ["a", "j"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))  # `positives` rows an anchor of the block
        out.write.mode("append").parquet(path)
        shared.destroy()
        both.destroy()
    return spark.read.schema(schema).parquet(path)


OP11_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.c, r.c) AS BIGINT) AS score FROM r a JOIN r ON len(a.c) = len(r.c) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE same AND vec_id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)
