"""Points in a table of polygons: each polygon is covered by cells of several sizes, and points meet cells by equality.

A cell that no edge touches is inner, and a point in it is inside without looking; a cell on the border carries the edges at
its height, and only points in such cells are judged by them. Cells are squares of a power of two degrees, so a
point's cell is exact; the answer for every point is that of the even-odd rule over all rings, to the bit.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .graph import stored

#: Cells that cover a polygon, about.
CELLS = 256
_LEVELS = (-9, 30)


def _edges(rings) -> np.ndarray:
    """(n, 4): x and y of both ends of all edges; points with a null end none."""
    out = []
    for ring in rings:
        p = np.array([[math.nan if q is None or q[c] is None else q[c] for c in ("x", "y")] for q in ring], float).reshape(-1, 2)
        out.append(np.hstack([p[:-1], p[1:]]))
    edges = np.vstack(out) if out else np.zeros((0, 4))
    return edges[np.isfinite(edges).all(1)]


def _crossings(x: np.ndarray, y: np.ndarray, e: np.ndarray) -> np.ndarray:
    """How many edges lie right of each point at its height, as in_polygon counts them."""
    ax, ay, bx, by = e.T
    y = y[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return (((ay > y) != (by > y)) & (x[:, None] < (bx - ax) * (y - ay) / (by - ay) + ax)).sum(1)


def _touched(cx: np.ndarray, cy: np.ndarray, size: float, e: np.ndarray) -> np.ndarray:
    """Whether an edge touches each closed cell: their boxes meet, and the corners don't all lie strictly on one side."""
    x0, y0 = (cx * size)[:, None], (cy * size)[:, None]
    x1, y1 = x0 + size, y0 + size
    ax, ay, bx, by = e.T
    meet = (np.maximum(ax, bx) >= x0) & (np.minimum(ax, bx) <= x1) & (np.maximum(ay, by) >= y0) & (np.minimum(ay, by) <= y1)
    side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x in (x0, x1) for y in (y0, y1)]
    # Rounding must not hide an edge that runs along a corner.
    near = 1e-12 * (np.abs(bx - ax) * (np.abs(y1) + np.abs(ay) + size) + np.abs(by - ay) * (np.abs(x1) + np.abs(ax) + size))
    return (meet & (np.minimum.reduce(side) <= near) & (np.maximum.reduce(side) >= -near)).any(1)


def _chunked(f, cx: np.ndarray, cy: np.ndarray, edges: int) -> np.ndarray:
    step = max(1, (1 << 20) // max(1, edges))
    return np.concatenate([f(cx[i : i + step], cy[i : i + step]) for i in range(0, len(cx), step)]) if len(cx) else np.zeros(0, bool)


def cover(rings, cells: int = CELLS) -> list[tuple[int, int, int, list[dict] | None]]:
    """(level, cx, cy, edges) of the cells that a polygon lies in, 2**-level degrees wide; edges is null for inner ones."""
    e = _edges(rings)
    if not len(e):
        return []
    xs, ys = e[:, [0, 2]], e[:, [1, 3]]
    wide = max(xs.max() - xs.min(), ys.max() - ys.min())
    level = _LEVELS[1] if wide == 0 else min(max(math.floor(math.log2(4 / wide)), _LEVELS[0]), _LEVELS[1])
    size = 2.0**-level
    x, y = (np.arange(math.floor(v.min() / size), math.floor(v.max() / size) + 1) for v in (xs, ys))
    cx, cy = (v.reshape(-1) for v in np.meshgrid(x, y))
    out: list[tuple[int, int, int, list[dict] | None]] = []
    while True:
        border = _chunked(lambda u, v: _touched(u, v, size, e), cx, cy, len(e))  # noqa: B023
        free_x, free_y = cx[~border], cy[~border]
        inner = _chunked(lambda u, v: _crossings((u + 0.5) * size, (v + 0.5) * size, e) % 2 == 1, free_x, free_y, len(e))  # noqa: B023
        out += [(level, int(u), int(v), None) for u, v in zip(free_x[inner], free_y[inner], strict=True)]
        cx, cy = cx[border], cy[border]
        if len(out) + 4 * len(cx) > cells or level == _LEVELS[1]:
            break
        level, size = level + 1, size / 2
        cx, cy = (np.concatenate([2 * v + d for d in step]) for v, step in ((cx, (0, 0, 1, 1)), (cy, (0, 1, 0, 1))))
    low, high, right = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3]), np.maximum(e[:, 0], e[:, 2])
    for u, v in zip(cx.tolist(), cy.tolist(), strict=True):
        own = e[(high >= v * size) & (low <= (v + 1) * size) & (right >= u * size)]
        out.append((level, u, v, [dict(zip(("ax", "ay", "bx", "by"), r, strict=True)) for r in own.tolist()]))
    return out


def covers(polygons: DataFrame, area: str, cells: int = CELLS) -> DataFrame:
    """(area, level, cx, cy, edges) of all polygons (area, rings array<array<struct<x, y>>>, closed)."""
    kind = polygons.schema[area].dataType.simpleString()
    schema = f"area {kind}, level int, cx long, cy long, edges array<struct<ax: double, ay: double, bx: double, by: double>>"
    arrow = to_arrow_schema(polygons.sparkSession.createDataFrame([], schema).schema)

    def each(batches):
        for batch in batches:
            for a, rings in zip(batch.column("area"), batch.column("rings"), strict=True):
                rows = cover([r for r in rings.as_py() if r is not None], cells)
                yield pa.RecordBatch.from_pylist([{"area": a.as_py(), "level": k, "cx": x, "cy": y, "edges": e} for k, x, y, e in rows], arrow)

    known = polygons.where(F.col("rings").isNotNull() & F.col(area).isNotNull())
    return known.select(F.col(area).alias("area"), F.col("rings").cast("array<array<struct<x: double, y: double>>>").alias("rings")).mapInArrow(each, schema)


def in_polygons(points: DataFrame, polygons: DataFrame, key: str, area: str, x: str = "lon", y: str = "lat", cells: int = CELLS) -> DataFrame:
    """(key, area) of points inside polygons, by the even-odd rule, so holes are outside and parts of one area may be rings of one row.

    One equi-join on cells: a point has one cell for each size that the covers use. Points without finite coordinates,
    and polygons without rings, match nothing; repeated points and polygons match each; areas may overlap.
    """
    cover_ = stored(covers(polygons, area, cells))
    levels = [r["level"] for r in cover_.select("level").distinct().collect()]  # at most 40 sizes
    fine = lambda c: F.abs(F.col(c)) < 1e6  # noqa: E731, not so for NaN
    own = points.where(fine(x) & fine(y)).select(key, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    if not levels:
        return own.limit(0).select(key, F.lit(None).cast(polygons.schema[area].dataType).alias(area))
    at = F.explode(F.array(*[F.struct(F.lit(v).alias("level"), F.floor(F.col("_x") * 2.0**v).alias("cx"), F.floor(F.col("_y") * 2.0**v).alias("cy")) for v in levels]))
    met = own.select("*", at.alias("_at")).select(key, "_x", "_y", "_at.*").join(cover_, ["level", "cx", "cy"])
    right = lambda e: ((e["ay"] > F.col("_y")) != (e["by"] > F.col("_y"))) & (F.col("_x") < (e["bx"] - e["ax"]) * (F.col("_y") - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"])
    inside = F.col("edges").isNull() | (F.size(F.filter("edges", right)) % 2 == 1)
    return met.where(inside).select(key, F.col("area").alias(area))
