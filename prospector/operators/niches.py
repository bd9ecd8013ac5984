"""The niche catalogue as a table: taxonomy matches, names, subsegments, and what a search of a niche asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fold_text, ordered_distinct


def match_segments(records: DataFrame, codes: DataFrame, names: DataFrame, searched: str | None = None) -> DataFrame:
    """(id, segment, points, evidence) of records (id, activity, category_keys, name, and category where there is one): the best evidence, of ties the segment that was considered first.

    codes: kind (activity or category), code, segment, level, and ord where the catalogue has an order; names: fragment, segment. An activity code is worth 30 and a
    category 20, and 3 more for each level; a name 10, by the first of the fragments, the longest before shorter ones; the
    searched segment 5 more. The activity is considered first, then category_keys in their order, each by ord, then the name. Records without
    category_keys fall back to the display category, without what stands in brackets at its end, or in small letters with _ for blanks.
    The table of codes is joined by equality; the few fragments are looked for in one pass.
    """
    if "ord" not in codes.columns:
        codes = codes.withColumn("ord", F.lit(0))
    keys = F.coalesce("category_keys", F.array().cast("array<string>"))
    if "category" in records.columns:
        shown = F.array_distinct(F.array(F.trim(F.regexp_replace("category", r"\s*\(.*\)$", "")), F.regexp_replace(F.lower("category"), r"\s+", "_")))
        keys = F.when(F.size(keys) == 0, F.array_compact(shown)).otherwise(keys)
    asked = F.concat(F.array(F.struct(F.lit("activity").alias("kind"), F.col("activity").alias("code"))), F.transform(keys, lambda c: F.struct(F.lit("category").alias("kind"), c.alias("code"))))
    each = records.select("id", F.posexplode(asked).alias("_at", "k")).select("id", "_at", "k.*").join(codes, ["kind", "code"])
    coded = each.select("id", "segment", (F.when(F.col("kind") == "activity", 30).otherwise(20) + F.col("level") * 3).alias("points"), F.concat_ws(" ", "kind", "code").alias("evidence"), F.struct(F.col("_at").alias("at"), F.col("ord").cast("long").alias("ord")).alias("place"))
    listed = names.agg(F.array_sort(F.collect_list(F.struct((-F.length("fragment")).alias("n"), "fragment", "segment"))).alias("_f"))  # the catalogue's fragments: one row
    folded = F.concat(F.lit(" "), fold_text("name"), F.lit(" "))
    hit = F.get(F.filter("_f", lambda f: F.contains(F.col("_n"), F.concat(F.lit(" "), fold_text(f["fragment"]), F.lit(" ")))), F.lit(0))
    named = records.select("id", folded.alias("_n"), F.lit(1).alias("_k")).join(F.broadcast(listed.withColumn("_k", F.lit(1))), "_k").withColumn("_h", hit).where("_h is not null")
    last = F.struct(F.lit(2**31 - 1).alias("at"), F.lit(0).cast("long").alias("ord"))
    named = named.select("id", F.col("_h")["segment"].alias("segment"), F.lit(10).alias("points"), F.concat_ws(" ", F.lit("name"), F.col("_h")["fragment"]).alias("evidence"), last.alias("place"))
    bonus = F.when(F.col("segment") == searched, 5).otherwise(0) if searched else F.lit(0)
    every = coded.unionByName(named).withColumn("points", (F.col("points") + bonus).cast("long"))
    # A segment stands where it was first considered, whatever evidence is its best.
    by_segment = every.groupBy("id", "segment").agg(F.max("points").alias("points"), F.min_by("evidence", F.struct(-F.col("points"), "place")).alias("evidence"), F.min("place").alias("place"))
    best = F.min_by(F.struct("segment", "points", "evidence"), F.struct(-F.col("points"), F.col("place"), F.col("segment")))
    return by_segment.groupBy("id").agg(best.alias("b")).select("id", "b.*")


def subsegment(text: Column, patterns: dict[str, str]) -> Column:
    """The first subsegment whose pattern the folded text meets; null if none does."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(patterns.items()):
        out = F.when(fold_text(text).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def expand(niches: DataFrame, mode: str, extra: list[str] | None = None, related: bool = False, expand_keywords: bool = True) -> DataFrame:
    """niches (key, primary, secondary, synonyms, activities, related_activities, tags, related_tags, broad_tags, name_keywords: arrays) with what a search asks for.

    terms, codes, places, keywords in the mode PRECISE, BALANCED or BROAD, and the terms, codes and places that are left to add.
    """
    none, more = F.array().cast("array<string>"), F.array(*map(F.lit, extra)) if extra else F.array().cast("array<string>")
    second = none if not expand_keywords else F.slice("secondary", 1, 2) if mode == "BALANCED" else F.col("secondary")
    terms = {"PRECISE": F.col("primary"), "BALANCED": F.concat("primary", second), "BROAD": F.concat("primary", "secondary", "synonyms" if expand_keywords else none)}[mode]
    places = {"PRECISE": F.col("tags"), "BALANCED": F.concat("tags", "related_tags"), "BROAD": F.concat("tags", "related_tags", "broad_tags")}[mode]
    codes = F.concat("activities", "related_activities") if mode == "BROAD" or related else F.col("activities")
    keywords = F.concat("name_keywords", more) if mode == "BROAD" else more
    lower = lambda c: F.transform(c, F.lower)
    rows = niches.withColumns({"terms": ordered_distinct(F.concat(terms, more)), "codes": F.array_distinct(codes), "places": F.array_distinct(places), "keywords": ordered_distinct(keywords)})
    left = lambda all_, taken: F.array_except(all_, taken)
    return rows.select(
        "key", "terms", "codes", "places", "keywords",
        F.filter(F.concat("primary", "secondary", "synonyms"), lambda t: ~F.array_contains(lower(F.col("terms")), F.lower(t))).alias("terms_left"),
        left(F.concat("activities", "related_activities"), F.col("codes")).alias("codes_left"), left(F.concat("tags", "related_tags", "broad_tags"), F.col("places")).alias("places_left"),
    )


def composite(expanded: DataFrame, terms: int = 12) -> DataFrame:
    """One row that stands for several niches (rows of `expand`, with ord): their codes and places, and terms in turn, one of each niche after another."""
    each = lambda c: expanded.select("ord", F.posexplode(c).alias("pos", "v")).groupBy("v").agg(F.min(F.struct("pos", "ord")).alias("at"))
    listed = lambda c: each(c).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias(c), F.lit(1).alias("_k"))
    out = listed("terms").join(listed("codes"), "_k").join(listed("places"), "_k")  # three one-row tables of the catalogue's size
    return out.select(F.slice("terms", 1, terms).alias("terms"), "codes", "places")


def merge_config(default: DataFrame, override: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of default with those of override in their place: whole lists replace lists, other fields only where they are given."""
    own = override.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return default.join(own, key, "full_outer").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


# Bounds of the radius, and terms that are offered at once.
FIRST_RADIUS, MOST_RADIUS, NEARBY_RADIUS, TERMS_OFFERED = 15, 100, 30, 5


def suggestions(found: Column, limit: Column, radius_km: Column, terms_left: Column, codes_left: Column, with_related: Column, sources_left: Column, fast: Column, mode: Column) -> Column:
    """array<struct<kind, values>> of what would widen a search that found fewer than its limit, in order; empty once the limit is reached.

    radius: twice the radius, at most 100 km, or 15 where there is none; keywords: the first five terms that are left;
    cnaes: the related codes that are left, if they weren't asked for; nearby_cities: 30 km; sources: those that are not
    used, or all free ones where the search was a fast one; mode: BROAD. radius_km is null where there is none; null lists are empty.
    """
    offer = lambda when, kind, values: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(kind).alias("kind"), values.alias("values")))
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    none = radius_km.isNull() | (radius_km == 0)
    wider = F.when(none, F.lit(FIRST_RADIUS).cast("double")).otherwise(F.least(F.lit(MOST_RADIUS).cast("double"), radius_km.cast("double") * 2))
    listed = F.array(
        offer(none | (radius_km < MOST_RADIUS), "radius", F.array(F.regexp_replace(wider.cast("string"), r"\.0$", ""))),
        offer(F.size(some(terms_left)) > 0, "keywords", F.slice(some(terms_left), 1, TERMS_OFFERED)),
        offer((F.size(some(codes_left)) > 0) & ~with_related, "cnaes", some(codes_left)),
        offer(none | (radius_km < NEARBY_RADIUS), "nearby_cities", F.array(F.lit(str(NEARBY_RADIUS)))),
        offer((F.size(some(sources_left)) > 0) | fast, "sources", some(sources_left)),
        offer(mode != "BROAD", "mode", F.array(F.lit("BROAD"))),
    )
    return F.when(found < limit, F.array_compact(listed)).otherwise(F.array().cast("array<struct<kind: string, values: array<string>>>"))


def last_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
