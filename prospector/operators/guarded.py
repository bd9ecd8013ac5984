"""Clusters under guards, by rounds: what an ordered pass over all links gives, without a group per component.

The pass takes links in order and joins two clusters unless they would hold two tax ids or cities that don't fit. A link can be
decided as soon as no undecided earlier link touches either of its clusters, and a link whose clusters conflict
now will be refused whenever its turn comes, as clusters only grow. So links are dealt into chunks of a bounded size, in a round
each chunk decides what no earlier link of another chunk can change, and the next round goes on with what is left. The
first undecided link is always decided, so rounds end; a component of any size is as many chunks as it needs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import stored

#: Links that one task decides in a round.
CHUNK_LINKS = 100_000
_NEVER = 2**63 - 1


def cities_fit(x: Column, y: Column) -> Column:
    """Folded city names fit if one is empty or holds the other."""
    return (x == "") | (y == "") | F.contains(x, y) | F.contains(y, x)


def conflict(x_tax: Column, y_tax: Column, x_cities: Column, y_cities: Column, same_record: Column) -> Column:
    """Whether two clusters may not be joined: two tax ids, or, but for links of one source record, cities that don't fit."""
    both = F.array_union(x_cities, y_cities)
    apart = F.exists(both, lambda m: F.exists(both, lambda n: ~cities_fit(m, n)))
    return F.coalesce(x_tax != y_tax, F.lit(False)) | (~same_record & (F.size(both) > 1) & apart)


def _decide(links: pd.DataFrame) -> pd.DataFrame:
    """(node, root, weakest) of the clusters of a chunk that its decided links join."""
    root: dict[int, int] = {}
    tax: dict[int, str | None] = {}
    cities: dict[int, set] = {}
    torn: dict[int, bool] = {}
    blocked: dict[int, int] = {}
    weakest: dict[int, int] = {}

    def fit(m: str, n: str) -> bool:
        return not m or not n or m in n or n in m

    for s in "xy":
        for i, t, c, o in zip(links[s], links[f"{s}_tax"], links[f"{s}_cities"], links[f"{s}_outer"], strict=True):
            if i not in root:
                root[i], tax[i], cities[i], blocked[i] = i, t, set(c), o
                torn[i] = not all(fit(m, n) for m in c for n in c)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = links.sort_values("seq")
    for a, b, seq, rank, same in zip(links["x"], links["y"], links["seq"], links["rank"], links["same_record"], strict=True):
        x, y = sorted((find(a), find(b)))
        if x == y:
            continue
        if blocked[x] < seq or blocked[y] < seq:  # it waits, and what comes later for these clusters waits for it
            blocked[x], blocked[y] = min(blocked[x], seq), min(blocked[y], seq)
            continue
        if tax[x] and tax[y] and tax[x] != tax[y]:
            continue
        apart = torn[x] or torn[y] or not all(fit(m, n) for m in cities[x] for n in cities[y])
        if apart and not same:
            continue
        root[y] = x
        tax[x], torn[x], blocked[x] = tax[x] or tax[y], apart, min(blocked[x], blocked[y])
        cities[x] |= cities.pop(y)
        weakest[x] = min(weakest.get(x, rank), weakest.get(y, rank), rank)
    rows = [(i, find(i), weakest[find(i)]) for i in root if find(i) in weakest]
    return pd.DataFrame(rows, columns=["node", "root", "weakest"])


def _outer(open_: DataFrame) -> DataFrame:
    """(node, _part, outer) of clusters that links of several chunks touch: outer is the first link of another chunk."""
    ends = open_.select("_part", F.col("x").alias("node"), "seq").unionByName(open_.select("_part", F.col("y").alias("node"), "seq"))
    first = ends.groupBy("node", "_part").agg(F.min("seq").alias("seq"))
    two = first.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct("seq", "_part"))), 1, 2).alias("two")).where(F.size("two") > 1)  # an entry a chunk
    other = F.when(F.col("two")[0]["_part"] == F.col("_part"), F.col("two")[1]["seq"]).otherwise(F.col("two")[0]["seq"])
    return first.join(two, "node").select("node", "_part", other.alias("outer"))


def guarded_clusters(nodes: DataFrame, links: DataFrame, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """(idx, cluster, weakest) of the nodes that links touch: cluster is its smallest idx, weakest the least rank that joined it, null for a node alone.

    nodes (idx long, tax string, city string) are one row an idx; a null or empty tax or city says nothing. links (a, b, rank int, same_record
    boolean, component) go by falling rank, then a, then b; component is a key that the links of a component share and only keeps them near each other. Links
    of a node with itself, and repeated links, change nothing. Empty links: no rows.
    """
    seq = F.monotonically_increasing_id()  # rising over the partitions of a global sort
    ordered = stored(links.where("a <> b").orderBy(F.desc("rank"), "a", "b").select("component", F.col("a").alias("x"), F.col("b").alias("y"), "rank", F.coalesce("same_record", F.lit(False)).alias("same_record"), seq.alias("seq")))
    ends = ordered.select(F.col("x").alias("idx")).union(ordered.select("y")).distinct()
    city = F.nullif(F.coalesce("city", F.lit("")), F.lit(""))
    attrs = stored(nodes.join(ends, "idx").select(F.col("idx").alias("cluster"), F.nullif("tax", F.lit("")).alias("tax"), F.array_compact(F.array(city)).alias("cities"), F.lit(None).cast("int").alias("weakest")))
    labels = attrs.select(F.col("cluster").alias("idx"), "cluster")
    open_ = ordered
    while True:
        side = lambda s: attrs.select(F.col("cluster").alias(s), F.col("tax").alias(f"{s}_tax"), F.col("cities").alias(f"{s}_cities"))  # noqa: E731, B023
        known = open_.where("x <> y").join(side("x"), "x").join(side("y"), "y")
        known = stored(known.where(~conflict(F.col("x_tax"), F.col("y_tax"), F.col("x_cities"), F.col("y_cities"), F.col("same_record"))))
        left = known.count()
        if not left:
            return labels.join(attrs.select("cluster", "weakest"), "cluster").select("idx", "cluster", "weakest")
        parts = -(-left // chunk_links)
        dealt = stored(known.repartitionByRange(parts, "component", "x", "y").withColumn("_part", F.spark_partition_id()))
        outer = _outer(dealt)
        chunk = dealt
        for s in ("x", "y"):
            chunk = chunk.join(outer.select(F.col("node").alias(s), "_part", F.col("outer").alias(f"{s}_outer")), [s, "_part"], "left")
        chunk = chunk.fillna(_NEVER, ["x_outer", "y_outer"])
        joined = stored(chunk.groupBy("_part").applyInPandas(_decide, "node long, root long, weakest int"))
        moved = joined.where("node <> root").select("node", "root")
        labels = stored(labels.join(moved, F.col("cluster") == F.col("node"), "left").select("idx", F.coalesce("root", "cluster").alias("cluster")))
        both = attrs.join(joined.withColumnRenamed("weakest", "_new"), F.col("cluster") == F.col("node"), "left")
        both = both.select(F.coalesce("root", "cluster").alias("cluster"), "tax", F.explode_outer("cities").alias("city"), F.least("weakest", "_new").alias("weakest"))
        attrs = stored(both.groupBy("cluster").agg(F.max("tax").alias("tax"), F.collect_set("city").alias("cities"), F.min("weakest").alias("weakest")))
        open_ = dealt.drop("_part", "x_tax", "y_tax", "x_cities", "y_cities")
        for s in ("x", "y"):
            open_ = open_.join(moved.select(F.col("node").alias(s), F.col("root").alias("_to")), s, "left").withColumn(s, F.coalesce("_to", s)).drop("_to")
