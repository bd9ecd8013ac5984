"""Places on the globe: distance, boxes, cells, polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(a))


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float, margin: float = 0.0) -> Column:
    """Plain comparisons, so that they reach the statistics of a columnar file."""
    return lat.between(south - margin, north + margin) & lon.between(west - margin, east + margin)


def cell(c: Column, size: float = 0.002) -> Column:
    return F.floor(c / size + 0.5)


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd rule over all rings (array<array<struct<x, y>>>, closed), so holes are outside."""

    def crossings(ring: Column) -> Column:
        edges = F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b"))
        hit = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"])
        return F.size(F.filter(edges, hit))

    return F.aggregate(rings, F.lit(0), lambda acc, r: acc + crossings(r)) % 2 == 1


def box_around(lat: Column, lon: Column, radius_km: float) -> Column:
    """struct(south, north, west, east) of a box that holds the circle."""
    d_lat = F.lit(radius_km / 111.32)
    d_lon = radius_km / (111.32 * F.cos(F.radians(lat)))
    return F.struct((lat - d_lat).alias("south"), (lat + d_lat).alias("north"), (lon - d_lon).alias("west"), (lon + d_lon).alias("east"))


def in_areas(points: DataFrame, areas: DataFrame, key: str, area: str, margin: float = 0.003, size: float = 0.05) -> DataFrame:
    """(key, area) of points (key, lat, lon) in the boxes of areas (area, south, north, west, east), with a margin.

    An equi-join on cells of a grid: an area lies in the cells that it touches, a point in one; then the box decides.
    """
    at = lambda c: F.floor(c / size).cast("long")
    wide = areas.select(area, *[(F.col(c) + s * margin).alias(f"_{c}") for c, s in (("south", -1), ("north", 1), ("west", -1), ("east", 1))])
    cells = wide.withColumn("_y", F.explode(F.sequence(at(F.col("_south")), at(F.col("_north"))))).withColumn("_x", F.explode(F.sequence(at(F.col("_west")), at(F.col("_east")))))
    own = points.where("lat is not null and lon is not null").select(key, "lat", "lon", at(F.col("lat")).alias("_y"), at(F.col("lon")).alias("_x"))
    return own.join(cells, ["_y", "_x"]).where("lat between _south and _north and lon between _west and _east").select(key, area)
