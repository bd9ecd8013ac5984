"""Connected components of a table of links: union-find inside tasks, and rounds of joins for what crosses them; nothing is gathered on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Links that are contracted together inside a task.
CHUNK_LINKS = 250_000


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links and, for each, the smallest node that these links connect it with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], least)
        np.minimum.at(new, root[y], least)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _contracted(chunk_links: int):
    """Links (a, b) as stars: a row (node, label) for each node of every chunk_links links, and the number of the chunk."""

    def run(batches):
        from pyspark import TaskContext

        held, rows, chunk = [], 0, 0

        def flush():
            t = pa.Table.from_batches(held)
            nodes, roots = _roots(t.column(0).to_numpy(), t.column(1).to_numpy())
            number = TaskContext.get().partitionId() * (1 << 32) + chunk
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots), pa.array(np.full(len(nodes), number))], names=["node", "label", "chunk"])

        for batch in batches:
            for at in range(0, batch.num_rows, chunk_links):
                part = batch.slice(at, chunk_links)
                if rows + part.num_rows > chunk_links:
                    yield flush()
                    held, rows, chunk = [], 0, chunk + 1
                held.append(part)
                rows += part.num_rows
        if held:
            yield flush()

    return run


def components(links: DataFrame, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """(node, label) for every node of links (a, b: long), label the smallest node it is connected with.

    First every task contracts its links, at most chunk_links at a time, to stars. If they were all in one chunk, that is the
    answer. Otherwise rounds of joins connect the stars: each round hangs every node under its smallest neighbour (a partial
    aggregate, so hubs are no hot spot), shortens the trees to stars by pointer jumping, and contracts the links to those
    between stars. The number of rounds and jumps is about the logarithm of the longest path. Self-links are ignored;
    repeated links count once; an empty table has no nodes.
    """
    a, b = F.col("a"), F.col("b")
    edges = written(links.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links")
    tasks = -(-edges.count() // chunk_links) or 1  # a count of metadata
    stars = written(edges.coalesce(tasks).mapInArrow(_contracted(chunk_links), "node long, label long, chunk long"), "stars")
    if stars.agg(F.countDistinct("chunk")).first()[0] <= 1:
        return stars.select("node", "label")
    every = stars.groupBy("node").agg(F.min("label").alias("label"))
    edges = written(stars.where("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b")).distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.select(a.alias("node"), b.alias("other")).union(edges.select(b, a))
        trees = written(both.groupBy("node").agg(F.min("other").alias("label")).select("node", F.least("node", "label").alias("label")), "trees")
        while True:
            up = trees.select(F.col("node").alias("label"), F.col("label").alias("upper"))
            twice = trees.join(up, "label").select("node", "label", "upper").join(up.toDF("upper", "top"), "upper")
            jumped = written(twice.select("node", F.col("top").alias("label"), (F.col("top") != F.col("label")).alias("moved")), "trees")
            trees = jumped.select("node", "label")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = trees
        else:
            up = trees.select(F.col("node").alias("label"), F.col("label").alias("upper"))
            labels = written(labels.join(up, "label", "left").select("node", F.coalesce("upper", "label").alias("label")), "labels")
        ends = edges.join(trees.toDF("a", "la"), "a").join(trees.toDF("b", "lb"), "b")
        edges = written(ends.where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "links")
    return labels if labels is not None else every
