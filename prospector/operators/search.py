"""A search's results: visible filters in order, validation, source funnel, ranking, views, outcome."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_areas, in_box
from ..functions.text import fold_text, is_generic_name, present, strip_accents

# Statuses that say a business is closed, and those that a precise search keeps.
CLOSED_REGISTRY = ["BAIXADA", "INAPTA", "NULA"]
CLOSED_SOURCE = ["closed", "permanently_closed"]
PRECISE_STATUSES = ["ATIVA", "SUSPENSA"]
FAILED = ["SOURCE_ERROR", "SOURCE_TIMEOUT", "SOURCE_RATE_LIMITED", "SOURCE_BLOCKED", "SOURCE_CIRCUIT_OPEN", "SOURCE_NOT_CONFIGURED"]
MARGIN, AREA_MARGIN = 0.01, 0.003


def cities_fit(a: Column, b: Column) -> Column:
    """Folded names of which one contains the other."""
    return F.contains(a, b) | F.contains(b, a)


def other_city(city: Column, target: str) -> Column:
    """An address in another city; none at all stays."""
    folded = fold_text(city)
    return present(city).isNotNull() & ~cities_fit(folded, fold_text(F.lit(target)))


def outside_area(city: Column, lat: Column, lon: Column, sources: Column, box: tuple[float, float, float, float]) -> Column:
    """No city in the address, and coordinates outside the box; rows of the own base are never outside."""
    south, west, north, east = box
    placed = lat.isNotNull() & lon.isNotNull()
    return present(city).isNull() & placed & ~F.array_contains(sources, "local_db") & ~in_box(lat, lon, south, west, north, east, MARGIN)


def other_status(status: Column, statuses: list[str]) -> Column:
    """A registry status outside the set; rows without one stay."""
    return F.coalesce(present(status).isNotNull() & ~status.isin(*statuses), F.lit(False))


def named_neighborhood(neighborhood: Column, names: list[str]) -> Column:
    folded = fold_text(neighborhood)
    return (folded != "") & reduce(lambda a, b: a | b, [cities_fit(folded, fold_text(F.lit(n))) for n in names], F.lit(False))


def in_neighborhoods(df: DataFrame, key: str, names: list[str], areas: DataFrame) -> DataFrame:
    """df with in_neighborhood: by the address's name, or by coordinates in an area's box (a range join by cells)."""
    found = in_areas(df.select(key, "lat", "lon"), areas, key, "area", AREA_MARGIN).select(key).distinct().withColumn("_in", F.lit(True))
    return df.join(found, key, "left").withColumn("in_neighborhood", named_neighborhood(F.col("neighborhood"), names) | F.coalesce("_in", F.lit(False))).drop("_in")


def validation_failure(excluded: Column | None = None) -> Column:
    """closed, excluded, generic_name or insufficient_data, the first that holds; null for a valid row. Reads operating_status, cnpj_status, name, phone, whatsapp, email, website, socials (array), street."""
    closed = F.col("operating_status").isin(*CLOSED_SOURCE) | F.col("cnpj_status").isin(*CLOSED_REGISTRY)
    contact = reduce(lambda a, b: a | b, [present(c).isNotNull() for c in ("phone", "whatsapp", "email", "website")]) | (F.coalesce(F.size("socials"), F.lit(0)) > 0)
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = F.when(yes(closed), "closed")
    if excluded is not None:
        out = out.when(yes(excluded), "excluded")
    return out.when(is_generic_name("name"), "generic_name").when(~contact & present("street").isNull(), "insufficient_data")


def niche_match(industry: str | None, activities: list[str], keywords: list[str]) -> Column:
    """The stored niche, a primary or secondary activity, or one of at most twenty keywords (of three characters or more) in one of the names."""
    tests = [F.col("industry_id") == industry] if industry else []
    if activities:
        tests += [F.col("activity").isin(*activities), F.arrays_overlap("secondary_activities", F.array(*map(F.lit, activities)))]
    for k in keywords[:20]:
        if len(k.strip()) >= 3:
            tests += [F.contains(F.lower(c), F.lit(k.strip().lower())) for c in ("trade_name", "legal_name")]
    return reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in tests], F.lit(False)) if tests else F.lit(True)


def local_scan(companies: DataFrame, city: str, state: str | None, niche: Column) -> DataFrame:
    """Rows of the own base in a city (with accents or without) and state that the niche takes."""
    name = F.lower(F.trim("city"))
    same = (name == F.lower(F.lit(city))) | (name == F.lower(strip_accents(F.lit(city))))
    return companies.where(same & niche & (F.col("state") == state if state else F.lit(True)))


def local_records(companies: DataFrame, origins: DataFrame, socials: DataFrame, contacts: DataFrame) -> DataFrame:
    """Rows of the own base as source records: children are aggregated before they are joined.

    origins (id, kind, record_id), socials (id, network, url, found), contacts (id, role). Confidence is HIGH with an official
    origin or a tax id, else MEDIUM.
    """
    o = origins.groupBy("id").agg(F.array_sort(F.collect_set("kind")).alias("origins"), F.bool_or(F.col("kind") == "OFFICIAL").alias("official"), F.array_sort(F.collect_set(F.when(F.col("kind") == "OSM", F.concat(F.lit("osm:"), "record_id")))).alias("linked"))
    s = socials.where("found").groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("network", "url")))).alias("socials"))
    k = contacts.groupBy("id").agg(F.bool_or(F.col("role").isin("OWNER", "PARTNER")).alias("has_decision_maker"))
    out = companies.join(o, "id", "left").join(s, "id", "left").join(k, "id", "left")
    sure = F.coalesce("official", F.lit(False)) | present("cnpj").isNotNull()
    empty = F.array().cast("array<string>")
    return out.select(*companies.columns, F.coalesce("origins", empty).alias("origins"), F.coalesce("linked", empty).alias("linked_record_ids"), "socials", F.coalesce("has_decision_maker", F.lit(False)).alias("has_decision_maker"), F.when(sure, "HIGH").otherwise("MEDIUM").alias("confidence"))


def source_funnel(records: DataFrame, removed: DataFrame, qualified: DataFrame) -> DataFrame:
    """Per source: returned, invalid, valid, duplicate, filtered, accepted and qualified (distinct businesses).

    records: source, valid, key (of the business it is in). A business's first source in the order of records.place is its
    primary one; a record is a duplicate where it isn't its business's first record. removed, qualified: key.
    """
    first = records.where("valid").groupBy("key").agg(F.min("place").alias("first"))
    flag = lambda df, name: df.select("key").distinct().withColumn(name, F.lit(True))
    rows = records.join(first, "key", "left").join(flag(removed, "_gone"), "key", "left").join(flag(qualified, "_good"), "key", "left")
    valid, gone, good = F.col("valid"), F.coalesce("_gone", F.lit(False)), F.coalesce("_good", F.lit(False))
    distinct = lambda c: F.countDistinct(F.when(c, F.col("key")))
    return rows.groupBy("source").agg(
        F.count("*").alias("returned"), F.count_if(~valid).alias("invalid"), F.count_if(valid).alias("valid"), F.count_if(valid & (F.col("place") != F.col("first"))).alias("duplicate"),
        F.count_if(valid & gone).alias("filtered"), distinct(valid & ~gone).alias("accepted"), distinct(valid & ~gone & good).alias("qualified"),
    )


def in_language(c: Column | str, language: str = "pt") -> Column:
    """Text that sorts and compares as its readers expect: letters first, then accents, then small letters before capitals."""
    return F.collate(F.col(c) if isinstance(c, str) else c, language)


def result_order(mode: str) -> list[Column]:
    if mode == "name":
        return [in_language("name").asc_nulls_last(), F.col("key").asc()]
    by = ["completeness", "rank_score"] if mode == "completeness" else ["visibility", "rank_score"] if mode == "visibility" else ["lead_score", "rank_score", "completeness"]
    return [*[F.col(c).desc_nulls_last() for c in by], F.col("key").asc()]


def with_budget(results: DataFrame, order: list[Column], budget: int) -> DataFrame:
    """results with enrichment: PENDING for the first `budget` in order, SKIPPED for the others. A top-k, so nothing is ranked as a whole."""
    top = results.orderBy(*order).limit(budget).select("key").withColumn("_top", F.lit(True))
    return results.join(F.broadcast(top), "key", "left").withColumn("enrichment", F.when(F.col("_top"), "PENDING").otherwise("SKIPPED")).drop("_top")  # budget rows


def view(results: DataFrame, kind: str = "", text: str = "") -> DataFrame:
    """The rows of a named view, and of these those whose names or address contain the text."""
    kinds = {
        "new": ~F.col("in_pipeline"), "existing": F.col("in_pipeline"), "review": F.col("quality_label") == "NEEDS_REVIEW", "no_phone": present("phone").isNull() & present("whatsapp").isNull(),
        "no_website": present("website").isNull(), "with_owner": F.coalesce(F.size("contacts"), F.lit(0)) > 0,
    }
    out = results.where(kinds[kind]) if kind else results
    whole = fold_text(F.concat_ws(" ", "name", "legal_name", "street", "neighborhood", "category"))
    return out.where(F.contains(whole, fold_text(F.lit(text)))) if text.strip() else out


def outcome(runs: DataFrame, results: Column, stopped: bool = False) -> DataFrame:
    """One row: how a search with these source runs (status) and number of results ended."""
    a = runs.agg(F.count("*").alias("runs"), F.count_if(F.col("status").isin(*FAILED)).alias("failed"), F.count_if(F.col("status") == "SOURCE_PARTIAL_RESULTS").alias("partial"))
    none, failed = results == 0, F.col("failed")
    end = (
        F.when(F.col("runs") == 0, "FAILED")
        .when((failed == F.col("runs")) & none, "FAILED")
        .when(none, F.when(failed > 0, "PARTIAL").otherwise("NO_RESULTS"))
        .when(F.lit(stopped) | (F.col("partial") > 0), "PARTIAL")
        .when(failed > 0, "SUCCESS_WITH_WARNINGS")
        .otherwise("SUCCESS")
    )
    return a.select("runs", "failed", "partial", end.alias("outcome"))
