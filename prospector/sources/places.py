"""Points of interest: a columnar scan with a box that reaches the row-group statistics, then the polygon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import in_polygon
from ..functions.ids import social_network, website_domain
from ..functions.text import fold_text


def curve(x: Column, y: Column, bits: int = 16) -> Column:
    """A place's number on a Z-order curve over the globe, so that near places mostly have near numbers."""

    def spread(c: Column, low: float, width: float) -> Column:
        v = F.greatest(F.lit(0), F.least(F.lit(2**bits - 1), F.floor((c - low) / width * 2**bits))).cast("long")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x, -180.0, 360.0).bitwiseOR(F.shiftleft(spread(y, -90.0, 180.0), 1))


def write_clustered(places: DataFrame, path: str, by: list[str] | None = None, files: int | None = None, group_bytes: int = 16 << 20) -> None:
    """places (longitude, latitude, bbox) as Parquet that read_places scans in part: folders by the columns of `by`, and in them rows in order of the curve.

    Files hold ranges of the curve, and row groups of about group_bytes narrow ones, so a box meets few of them. Places
    without coordinates stand first.
    """
    by = by or []
    rows = places.withColumn("_curve", curve(F.col("longitude"), F.col("latitude")))
    dealt = rows.repartitionByRange(files, *by, "_curve") if files else rows.repartitionByRange(*by, "_curve")
    writer = dealt.sortWithinPartitions(*by, "_curve").drop("_curve").write.option("parquet.block.size", group_bytes)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def read_places(spark: SparkSession, path: str, south: float, west: float, north: float, east: float, folders: dict[str, str] | None = None) -> DataFrame:
    """Places whose bbox struct (xmin, xmax, ymin, ymax) lies in the box; the four comparisons are pushed to the scan, and folders (column: value) prune it."""
    b = F.col("bbox")
    rows = spark.read.parquet(path)
    for column, value in (folders or {}).items():
        rows = rows.where(F.col(column) == value)
    return rows.where((b["xmin"] >= west) & (b["xmax"] <= east) & (b["ymin"] >= south) & (b["ymax"] <= north))


def within(places: DataFrame, rings: list[list[tuple[float, float]]], x: str = "longitude", y: str = "latitude") -> DataFrame:
    polygon = F.array(*[F.array(*[F.struct(F.lit(float(px)).alias("x"), F.lit(float(py)).alias("y")) for px, py in ring]) for ring in rings])
    return places.where(in_polygon(F.col(x), F.col(y), polygon))


def search(places: DataFrame, city: str, state: str, categories: list[str], words: list[str]) -> DataFrame:
    """City and state, and either a category or a word of the name."""
    name = fold_text("name")
    named = F.lit(False)
    for w in words:
        named = named | F.contains(name, fold_text(F.lit(w)))
    return places.where((fold_text("city") == fold_text(F.lit(city))) & (F.col("state") == state) & (F.arrays_overlap("categories", F.array(*map(F.lit, categories))) | named))


def source_records(places: DataFrame) -> DataFrame:
    """Places as source records: profiles by network, the first site that is none, street and number apart, confidence from 0.6 on MEDIUM."""
    number = r",?\s+(\d+[A-Za-z]?)$"
    tagged = F.transform(F.coalesce("socials", F.array().cast("array<string>")), lambda u: F.struct(social_network(u).alias("key"), u.alias("value")))
    first: Column = F.get(F.filter(F.coalesce("websites", F.array().cast("array<string>")), lambda w: website_domain(w).isNotNull()), F.lit(0))
    return places.select(
        F.lit("places_overture").alias("source"),
        F.col("source_id").alias("source_record_id"),
        "name",
        "category",
        F.regexp_replace("street", number, "").alias("street"),
        F.nullif(F.regexp_extract("street", number, 1), F.lit("")).alias("house_number"),
        "postcode",
        "city",
        "state",
        F.get("phones", F.lit(0)).alias("phone"),
        "phones",
        F.get("emails", F.lit(0)).alias("email"),
        first.alias("website"),
        F.filter(tagged, lambda s: s["key"].isNotNull()).alias("socials"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        F.when(F.col("confidence") >= 0.6, "MEDIUM").otherwise("LOW").alias("confidence"),
    )
