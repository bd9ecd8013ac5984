"""Units of a brand: how many places of one domain, or of one distinctive name, lie apart."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, haversine
from ..functions.ids import website_domain
from ..functions.text import fold_text, normalize_business_name, significant_tokens
from .graph import stored

#: Places of a brand that are nearer than this are one.
APART_M = 200.0


def brand_members(places: DataFrame) -> DataFrame:
    """(brand, ord, lat, lon, address) of places (ord, name, website, lat, lon, street, house_number): a row for its domain and one for its name, where that has a telling word."""
    name = normalize_business_name(F.col("name"))
    telling = (name != "") & (F.size(significant_tokens(name, F.array().cast("array<string>"))) > 0)
    keys = F.array_compact(F.array(F.concat(F.lit("d:"), website_domain("website")), F.when(telling, F.concat(F.lit("n:"), name))))
    address = fold_text(F.concat_ws(" ", "street", "house_number"))
    return places.select(F.explode(keys).alias("brand"), "ord", "lat", "lon", address.alias("address"))


def _near(left: DataFrame, right: DataFrame, meters: float) -> DataFrame:
    """(ord_l, ord_r, brand), ord_l < ord_r, of places of a brand that are near: by distance where both have coordinates, else by equal addresses. Equi-joins on grid cells and on addresses."""
    step = meters / (EARTH_M * math.pi / 180) * 1.000001
    row = F.floor(F.col("lat") / step).cast("long")

    def column(r):
        """The cell of lon in a row: as wide as the distance at the farthest latitude of the row and those next to it, so near places lie in cells next to each other."""
        farthest = F.least(F.greatest(F.abs((r - 1) * step), F.abs((r + 2) * step)), F.lit(89.9))
        return F.floor(F.col("lon") / (F.lit(step) / F.cos(F.radians(farthest)))).cast("long")

    placed = lambda df: df.where("lat is not null and lon is not null")
    own = placed(left).withColumn("_row", row).withColumn("_col", column(F.col("_row"))).select("brand", F.col("ord").alias("ord_l"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "_row", "_col")
    around = lambda c: F.explode(F.sequence(c - 1, c + 1))
    other = placed(right).withColumn("_row", around(row)).withColumn("_col", around(column(F.col("_row"))))
    far = own.join(other.hint("merge"), ["brand", "_row", "_col"]).where("ord_l < ord").where(haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")) < meters)
    by_distance = far.select("brand", "ord_l", F.col("ord").alias("ord_r"))
    blank = lambda df: df.withColumn("_blank", F.col("lat").isNull() | F.col("lon").isNull())
    same = blank(left).select("brand", "address", F.col("ord").alias("ord_l"), F.col("_blank").alias("_b")).join(blank(right).select("brand", "address", F.col("ord").alias("ord_r"), "_blank").hint("merge"), ["brand", "address"])
    return by_distance.unionByName(same.where("ord_l < ord_r and (_b or _blank)").select("brand", "ord_l", "ord_r"))


def distinct_places(members: DataFrame, meters: float = APART_M) -> DataFrame:
    """(brand, ord) of the places that count: in order of ord, those not near an earlier one that counts.

    Of places alike in brand, coordinates and address only the first can count. For the others, rounds of joins: a place counts
    once no earlier undecided one is near, and what is near a later one of it falls. No brand is gathered into one task.
    The tables of the rounds are small as files and large as rows, so joins are hinted: a broadcast would fill the driver.
    """
    first = stored(members.groupBy("brand", "lat", "lon", "address").agg(F.min("ord").alias("ord")))
    near = stored(_near(first, first, meters).distinct())
    kept = stored(first.select("brand", "ord").join(near.select("brand", F.col("ord_r").alias("ord")).hint("merge"), ["brand", "ord"], "left_anti"))
    while True:
        fallen = near.join(kept.withColumnRenamed("ord", "ord_l").hint("merge"), ["brand", "ord_l"], "left_semi").select("brand", F.col("ord_r").alias("ord")).distinct()
        gone = fallen.withColumn("_gone", F.lit(True))
        open_ = near
        for side in ("ord_l", "ord_r"):
            open_ = open_.join(gone.select("brand", F.col("ord").alias(side)).hint("merge"), ["brand", side], "left_anti")
        open_ = stored(open_)
        waiting = near.select("brand", F.col("ord_r").alias("ord")).distinct().join(fallen.hint("merge"), ["brand", "ord"], "left_anti")
        free = stored(waiting.join(open_.select("brand", F.col("ord_r").alias("ord")).hint("merge"), ["brand", "ord"], "left_anti").join(kept.hint("merge"), ["brand", "ord"], "left_anti"))
        if free.isEmpty():
            return kept
        kept, near = stored(kept.unionByName(free)), open_


def brand_locations(places: DataFrame, meters: float = APART_M) -> DataFrame:
    """(ord, locations) of places whose brand has two distinct places or more: the most of its domain's and its name's.

    places: ord (unique), name, website, lat, lon, street, house_number. Places of which one lacks coordinates are the same if
    street and number are, folded; so are two without any. Others are in no row: theirs is one location.
    """
    members = stored(brand_members(places))
    many = distinct_places(members, meters).groupBy("brand").agg(F.count("*").alias("n")).where("n >= 2")
    return members.join(many.hint("merge"), "brand").groupBy("ord").agg(F.max("n").alias("locations"))
