"""Merged businesses: what a cluster of source records becomes, links between businesses to review, and enrichment.

All by aggregates: the first value in source order is a min_by, distinct lists are grouped before they are collected, so no
cluster's records are gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import phone_key
from ..functions.text import fold_text, present
from .resolve import CONFLICT_FIELDS, FIELDS, SOURCE_ORDER, compare_key, completeness, completeness_label, rank_score

TEXT_MATCHES = ["text_search", "name_keyword"]


def _place(source: str = "source") -> Column:
    place = F.array_position(F.array(*map(F.lit, SOURCE_ORDER)), F.col(source))
    return F.when(place > 0, place).otherwise(len(SOURCE_ORDER) + 1)


def _at(source: str = "source", idx: str = "idx") -> Column:
    """The order of a cluster's records: by source, then as they came."""
    return F.struct(_place(source).alias("place"), F.col(idx).alias("idx"))


def _ordered(rows: DataFrame, value: str, key: str, out: str) -> DataFrame:
    """(cluster, out): distinct values of rows (cluster, at, value, key) by key, the first of each, in order of at."""
    one = rows.where(F.col(key).isNotNull()).groupBy("cluster", key).agg(F.min("at").alias("at"), F.min_by(value, "at").alias("value"))
    return one.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias(out))


def valid_time(c: Column | str) -> Column:
    return F.try_to_timestamp(F.col(c) if isinstance(c, str) else c)


def qualification_inputs(rows: DataFrame) -> DataFrame:
    """Per cluster: the first activity, opening date, size, description and hours; any status but open before silence; the earliest and latest moments, invalid ones left out.

    rows: cluster, idx, source, and the columns named below, moments as text.
    """
    at = _at()
    first = lambda c: F.min_by(c, F.when(present(F.col(c).cast("string")).isNotNull(), at)).alias(c)
    status = present("operating_status")
    shut = F.min_by(status, F.when(status != "open", at))
    return rows.groupBy("cluster").agg(
        *[first(c) for c in ("activity", "opened_at", "company_size", "description", "opening_hours")],
        F.coalesce(shut, F.min_by(status, F.when(status.isNotNull(), at))).alias("operating_status"),
        F.min(F.coalesce(valid_time("first_seen_at"), valid_time("collected_at"))).alias("first_seen_at"),
        F.max(valid_time("collected_at")).alias("last_seen_at"),
        F.max(valid_time("verified_at")).alias("last_verified_at"),
        F.max(valid_time("data_as_of")).alias("data_as_of"),
    )


def kept_phones(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(cluster, phones): the chosen one first, then every other distinct number of the records (phone, phones), by comparable form."""
    order = lambda later, place, idx, pos: F.struct(F.lit(later).alias("later"), place.cast("long").alias("place"), idx.cast("long").alias("idx"), pos.cast("int").alias("pos")).alias("at")
    each = rows.select("cluster", "idx", _place().alias("place"), F.posexplode(F.concat(F.array("phone"), F.coalesce("phones", F.array().cast("array<string>")))).alias("pos", "value"))
    each = each.select("cluster", order(1, F.col("place"), F.col("idx"), F.col("pos")), present("value").alias("value"))
    zero = F.lit(0)
    both = each.union(chosen.select("cluster", order(0, zero, zero, zero), present("phone").alias("value")))
    return _ordered(both.withColumn("key", F.coalesce(phone_key("value"), "value")), "value", "key", "phones")


def contact_union(contacts: DataFrame) -> DataFrame:
    """(cluster, contacts): names of contacts (cluster, idx, source, pos, name), the first spelling of each, in source order."""
    rows = contacts.select("cluster", F.struct(_at().alias("record"), "pos").alias("at"), "name", F.nullif(fold_text("name"), F.lit("")).alias("key"))
    return _ordered(rows, "name", "key", "contacts")


def duplicate_links(review: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, other, level) in both directions, for pairs (a, b, level) of records in different clusters; of several pairs the first (MEDIUM before LOW, then by records) speaks."""
    side = lambda s, out: members.select(F.col("idx").alias(s), F.col("cluster").alias(out))
    pairs = review.join(side("a", "ca"), "a").join(side("b", "cb"), "b").where("ca <> cb")
    order = F.struct(F.when(F.col("level") == "MEDIUM", 0).otherwise(1).alias("o"), "a", "b")
    one = pairs.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.min_by("level", order).alias("level"))
    return one.select(F.col("x").alias("cluster"), F.col("y").alias("other"), "level").union(one.select("y", "x", "level"))


def merged_records(records: DataFrame, members: DataFrame, fused: DataFrame, links: DataFrame) -> DataFrame:
    """One row per business: key, status, confidence, sources, warnings, chosen fields, completeness, rank and quality label.

    records: idx, source, source_record_id, company_id, confidence, matched_by, cnpj_status, has_decision_maker, in_pipeline.
    members: idx, cluster. fused: rows of `resolve.fuse`. links: rows of `duplicate_links`.
    """
    rows = records.join(members, "idx").withColumn("at", _at())
    first = lambda c: F.min_by(c, F.when(present(F.col(c).cast("string")).isNotNull(), F.col("at")))
    base = rows.groupBy("cluster").agg(
        F.count("*").alias("n_records"), first("company_id").alias("company_id"), F.countDistinct("company_id").alias("n_companies"), F.min_by(F.concat_ws(":", "source", "source_record_id"), "at").alias("identity"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.bool_or(F.col("confidence") == "HIGH").alias("sure"), F.bool_and(F.coalesce(F.col("matched_by").isin(*TEXT_MATCHES), F.lit(False))).alias("text_only"),
        first("cnpj_status").alias("cnpj_status"), F.bool_or(F.coalesce("has_decision_maker", F.lit(False))).alias("has_decision_maker"), F.bool_or(F.coalesce("in_pipeline", F.lit(False))).alias("in_pipeline"),
    )
    names = sorted({*FIELDS, "instagram", "facebook", "tiktok", "linkedin", "youtube"})
    wide = fused.groupBy("cluster").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in names], F.count_if("conflict").alias("n_conflicts"))
    dup = links.groupBy("cluster").agg(F.count("*").alias("n_duplicates"), F.bool_or(F.col("level") == "MEDIUM").alias("medium_duplicate"))
    out = base.join(wide, "cluster", "left").join(dup, "cluster", "left")
    has = lambda *cs: F.greatest(*[present(c).isNotNull() for c in cs], F.lit(False))
    flags = {"cnpj": has("cnpj"), "name": has("name"), "address": has("street"), "phone": has("phone", "whatsapp"), "email": has("email"), "website": has("website"), "social": has("instagram", "facebook", "tiktok", "linkedin", "youtube"), "decision_maker": F.col("has_decision_maker")}
    many = F.size("sources") >= 2
    confidence = F.when(many | F.col("sure") | has("cnpj"), "HIGH").when(F.col("text_only"), "LOW").otherwise("MEDIUM")
    warnings = (F.col("n_companies") > 1).cast("int") + F.coalesce((F.col("cnpj_status") != "ATIVA").cast("int"), F.lit(0))
    out = out.withColumns({
        "key": F.when(F.col("company_id").isNotNull(), F.concat(F.lit("db:"), "company_id")).otherwise(F.concat(F.lit("u:"), "identity")), "status": F.when(F.col("company_id").isNotNull(), "EXISTING").otherwise("NEW"),
        "confidence": confidence, "warnings": warnings, "n_conflicts": F.coalesce("n_conflicts", F.lit(0)), "n_duplicates": F.coalesce("n_duplicates", F.lit(0)), "completeness": completeness(flags),
    })
    review = (F.col("n_conflicts") > 0) | (F.col("warnings") > 0) | F.coalesce("medium_duplicate", F.lit(False))
    out = out.withColumns({"completeness_label": completeness_label(F.col("completeness")), "rank_score": rank_score(F.col("completeness"), F.col("confidence"), F.size("sources")), "quality_label": F.when(review, "NEEDS_REVIEW").when(F.col("completeness") >= 75, "COMPLETE").otherwise("PARTIAL")})
    return out.drop("sure", "text_only", "medium_duplicate", "identity")


def apply_enrichment(business: DataFrame, patches: DataFrame, fields: list[str], priorities: dict[str, list[str]]) -> DataFrame:
    """business (key, source, confidence rank, fields) after patches (key, source, confidence rank, fields, one row per key).

    An empty field is filled. A field of another value goes to the side whose source ranks higher in the field's priority (10 a
    place) and confidence (3 a rank), the present one on ties; the loser is kept in conflicts (field, value) where the field
    is one that conflicts are kept of.
    """
    own = patches.select("key", F.col("source").alias("_source"), F.col("conf").alias("_conf"), *[present(c).alias(f"_{c}") for c in fields])
    rows = business.join(own, "key", "left")
    changed, losers = {}, []
    for f in fields:
        ranks = priorities.get(f, [])
        place = lambda c, ranks=ranks: F.when(F.array_position(F.array(*map(F.lit, ranks)), c) > 0, (len(ranks) - F.array_position(F.array(*map(F.lit, ranks)), c) + 1) * 10).otherwise(0) if ranks else F.lit(0)
        old, new = present(f), F.col(f"_{f}")
        differs = old.isNotNull() & new.isNotNull() & F.coalesce(compare_key(f, old) != compare_key(f, new), F.lit(False))
        wins = place(F.col("_source")) + F.col("_conf") * 3 > place(F.col("source")) + F.col("conf") * 3
        changed[f] = F.when(old.isNull(), new).when(differs & wins, new).otherwise(old)
        if f in CONFLICT_FIELDS:
            losers.append(F.when(differs, F.struct(F.lit(f).alias("field"), F.when(wins, old).otherwise(new).alias("value"))))
    conflicts = F.array_compact(F.array(*losers)) if losers else F.array().cast("array<struct<field:string,value:string>>")
    return rows.select(*[c for c in business.columns if c not in fields], *[v.alias(k) for k, v in changed.items()], conflicts.alias("conflicts"))


def enrichment_batch(companies: DataFrame, tag: str, size: int = 5) -> DataFrame:
    """The next rows to enrich: not yet tagged, best rank first."""
    return companies.where(~F.coalesce(F.array_contains("tags", tag), F.lit(False))).orderBy(F.desc_nulls_last("rank_score"), "key").limit(size)


def enrichment_stats(companies: DataFrame, tag: str) -> DataFrame:
    done = F.coalesce(F.array_contains("tags", tag), F.lit(False))
    return companies.agg(F.count_if(done).alias("processed"), F.count_if(done & present("website").isNotNull()).alias("with_website"), F.count_if(done & present("email").isNotNull()).alias("with_email"), F.count_if(~done).alias("remaining"))


def enriched_by_source(businesses: DataFrame) -> DataFrame:
    """(source, n) of businesses with enriched_by (array of sources): each business counts once a source."""
    return businesses.select(F.explode(F.array_distinct("enriched_by")).alias("source")).groupBy("source").agg(F.count("*").alias("n"))
