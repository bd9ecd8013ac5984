"""Operator 9, embedding near-dedup: sign hashing by random hyperplanes in several tables, exact cosines, components.

Equal vectors are one class. A class has a code of sign bits in each table; classes with equal label and code meet in a
bucket. A pair counts in the first table in which it meets; a bucket all of whose classes met in an earlier table is left out. Buckets beyond a block's size are cut into chunks, and every two chunks meet in a task of
their own, so no bucket is gathered whole and none is capped. Codes alone go to the buckets: the bits in which two classes differ, over all
tables, tell their angle, and only classes with a pair that can be near get their vectors there. Those pairs
get exact cosines in double precision by blocks of a matrix product. What leaves a block is a row per class, never a row per pair:
the copies it links with, and the smallest class that links inside the block connect it with.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .components import components

COSINE = 0.98
#: Recall at the threshold itself that the number of tables is chosen for; closer pairs are found more often.
RECALL = 0.997
#: Classes in a block.
BLOCK = 384


def tables_for(rows: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables): buckets hold a few vectors at any number of rows, and tables make up for the pairs that more bits part."""
    bits = max(12, math.ceil(math.log2(max(rows, 2))) - 2)
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def differing_bits(bits: int, tables: int, cosine: float) -> int:
    """Most sign bits, of all tables together, in which a pair at the threshold may differ: six standard deviations beyond the mean, one pair in 10**9 has more."""
    n, share = bits * tables, math.acos(cosine) / math.pi
    return math.ceil(n * share + 6 * math.sqrt(n * share * (1 - share)) + 1)


def _signed(bits: int, tables: int, seed: int):
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            lists, n = batch.column("embedding"), batch.num_rows
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat, begin = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(size)])
            codes = np.zeros((n, tables), np.int64)
            prints: list[bytes] = [b""] * n
            for d in np.unique(size):
                own = np.flatnonzero(size == d)
                x = flat[begin[own][:, None] + np.arange(d)]
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), tables * bits))
                scaled = x / np.maximum(np.abs(x).max(1, initial=0)[:, None], np.finfo(np.float64).tiny)
                up = (scaled @ planes[d] > 0).reshape(len(own), tables, bits)
                codes[own] = up @ (np.int64(1) << np.arange(bits, dtype=np.int64))
                for i, v in zip(own, x + 0.0, strict=True):
                    prints[i] = xxhash.xxh3_128_digest(v.tobytes())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * tables + 1, tables, dtype=np.int32)), pa.array(codes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(prints, pa.binary()), lists, batch.column("embedding")], names=["id", "label", "print", "codes", "embedding"])

    return run


def _new_pairs(k: int, codes: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool, most: int) -> np.ndarray:
    """Which pairs meet here first and can be near: one that met in an earlier table was judged there, for its links and its component."""
    new = np.ones((len(a), len(b)), np.bool_)
    for t in range(k):
        new &= codes[a, t][:, None] != codes[b, t][None, :]
    if same:
        np.fill_diagonal(new, False)
    if new.any():
        differ = np.zeros(new.shape, np.int32)
        for t in range(codes.shape[1]):
            differ += np.bitwise_count(codes[a, t][:, None] ^ codes[b, t][None, :])
        new &= differ <= most
    return new


def _sides(t: pa.Table) -> tuple[int, np.ndarray, np.ndarray, bool]:
    """The table k of a unit, the places of its two chunks, and whether they are one."""
    k, first, second = (t.column(c)[0].as_py() for c in ("k", "first", "second"))
    chunk = t.column("chunk").to_numpy()
    a = np.flatnonzero(chunk == first)
    return k, a, a if first == second else np.flatnonzero(chunk == second), first == second


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().flatten().to_numpy().reshape(len(t), -1)


def _candidates(most: int):
    """The rows of a unit that have a pair there which can be near."""

    def unit(t: pa.Table):
        k, a, b, same = _sides(t)
        if not len(a) or not len(b):
            return None
        new = _new_pairs(k, _matrix(t, "codes"), a, b, same, most)
        found = np.union1d(a[new.any(1)], b[new.any(0)])
        return t.take(pa.array(found)).select(["unit", "k", "first", "second", "chunk", "label", "print"]) if len(found) else None

    return unit


def _blocks(cosine: float, most: int):
    """For each class of a unit with links: id, copies linked, root."""

    def unit(t: pa.Table):
        k, a, b, same = _sides(t)
        if not len(a) or not len(b):
            return None
        new = _new_pairs(k, _matrix(t, "codes"), a, b, same, most)
        if not new.any():
            return None
        ids, copies = t.column("id").to_numpy(), t.column("copies").to_numpy()
        x = _matrix(t, "embedding").astype(np.float64)  # all of one length
        x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])  # powers of two: exact, and no square overflows or vanishes
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        near = new & ((x[a] @ x[b].T) / np.outer(norm[a], norm[b]) >= cosine)
        if not near.any():
            return None
        linked = np.zeros(len(ids), np.int64)
        linked[a] += near @ copies[b]
        root = ids.copy()
        while True:
            before = root.copy()
            far = np.where(near, root[b][None, :], np.iinfo(np.int64).max).min(1)
            root[a] = np.minimum(root[a], far)
            if not same:
                far = np.where(near, root[a][:, None], np.iinfo(np.int64).max).min(0)
                root[b] = np.minimum(root[b], far)
            if (root == before).all():
                break
        if not same:
            linked[b] += copies[a] @ near
        some = (linked > 0) | (root != ids)
        return pa.table({n: pa.array(v[some], pa.int64()) for n, v in (("id", ids), ("linked", linked), ("root", root))})

    return unit


def _by_unit(work):
    """work on the rows of each unit, rows being sorted by unit."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        current = None

        def flush():
            out = work(pa.Table.from_batches(held)) if held else None
            return out.combine_chunks().to_batches() if out is not None else []

        for batch in batches:
            names = batch.column("unit").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]]) if len(names) else np.zeros(1, np.int64)
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if held and names[s] != current:
                    yield from flush()
                    held = []
                current = names[s]
                held.append(batch.slice(s, e - s))
        yield from flush()

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, seed: int = 5, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Only vectors with equal, not null labels and as many components are compared. Null vectors, zero vectors and those with null
    or non-finite components, and rows with a null label, link with nothing: n_links 0, the own id, kept. Rows that
    repeat an id are vectors like others to n_links and one to components. No pair below the threshold is linked.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), "label", "embedding")
    fine = F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    valid = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    bits, tables = tables_for(valid.count(), cosine)
    most = differing_bits(bits, tables, cosine)
    kind, of = (rows.schema[c].dataType.simpleString() for c in ("label", "embedding"))
    signed = written(valid.mapInArrow(_signed(bits, tables, seed), f"id long, label {kind}, print binary, codes array<long>, embedding {of}"), "signed")
    group = ["label", "print"]
    classes = written(signed.groupBy(*group).agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vector-classes")
    reps = written(signed.join(classes, group).where("id = rep").dropDuplicates(group).select("id", *group, "copies", "codes", "embedding"), "vectors")
    each = reps.select("id", *group, F.size("embedding").alias("dim"), "codes", F.posexplode("codes").alias("k", "code"))
    codes = reps.select("label", F.size("embedding").alias("dim"), "codes", F.posexplode("codes").alias("k", "code")).withColumn("before", F.xxhash64(F.slice("codes", F.lit(1), F.col("k"))))
    # Classes whose earlier codes are all equal have met each other.
    some = (F.col("size") > 1) & ((F.col("k") == 0) | (F.col("least") != F.col("most")))
    full = written(codes.groupBy("label", "dim", "k", "code").agg(F.count("*").alias("size"), F.min("before").alias("least"), F.max("before").alias("most")).where(some).drop("least", "most"), "buckets")
    chunks = F.ceil(F.col("size") / block).cast("int")
    met = each.join(full, ["label", "dim", "k", "code"]).withColumn("chunk", F.pmod(F.xxhash64("id"), chunks).cast("int"))
    spread = met.withColumn("with", F.explode(F.sequence(F.lit(0), chunks - 1)))
    spread = spread.withColumns({"first": F.least("chunk", "with"), "second": F.greatest("chunk", "with")})
    spread = spread.select(F.xxhash64("label", "dim", "k", "code", "first", "second").alias("unit"), "k", "first", "second", "chunk", *group, "codes")
    some = written(spread.repartition("unit").sortWithinPartitions("unit").mapInArrow(_by_unit(_candidates(most)), f"unit long, k int, first int, second int, chunk int, label {kind}, print binary"), "vector-candidates")
    full_rows = some.join(reps.select(*group, "id", "copies", "codes", "embedding"), group).drop(*group)
    found = written(full_rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(_by_unit(_blocks(cosine, most)), "id long, linked long, root long"), "vector-links")
    label = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("id").agg(F.sum("linked").alias("linked"))
    named = classes.join(linked.withColumnRenamed("id", "rep"), "rep", "left").join(label.toDF("rep", "top"), "rep", "left")
    named = written(named.select(*group, (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("top", "rep").alias("component_id")), "named-vectors")
    whole = signed.select("id", *group).join(named, group).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    rest = rows.where(~(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))))
    out = whole.unionByName(rest.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), fine AS (
  SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.98
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a), lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(lowest.b, vec_id)) AS component_id, vec_id <= coalesce(lowest.b, vec_id) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN lowest ON lowest.a = vec_id
"""


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
