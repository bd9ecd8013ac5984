"""Entity resolution: records of many sources to businesses, by blocks, evidence on pairs, guarded clusters and fusion.

Pairs come from equi-joins on block keys; a key held by more than BLOCK_CAP records is no signal and, as a rule of the
method, makes no pairs. Evidence is one `when` chain. Clusters are connected components of the sure links; those
in which a guard can speak (two tax ids, or cities that don't fit) are clustered by guarded rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import cell, haversine
from ..functions.ids import email, phone_key, tax_id, website_domain
from ..functions.text import fold_text, gram_similarity, name_similarity, normalize_business_name, round_half_up, significant_tokens, trigram_numbers
from .graph import connected, stored
from .guarded import cities_fit, guarded_clusters
from .pairs import BLOCK_CAP, candidate_pairs  # noqa: F401

# Source order, priorities by field group, and weights that results depend on.
SOURCE_ORDER = ["local_db", "places_overture", "osm_overpass", "osm_nominatim", "osm_photon", "cnpj_brasilapi", "website_discovery"]
CONFIDENCE = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}
CONFLICT_FIELDS = ["cnpj", "phone", "email", "website", "street", "house_number", "postcode", "instagram"]
COMPLETENESS = {"cnpj": 15, "name": 10, "address": 15, "phone": 15, "email": 10, "website": 15, "social": 10, "decision_maker": 10}
FIELDS = ["name", "legal_name", "cnpj", "category", "street", "house_number", "neighborhood", "city", "state", "postcode", "phone", "whatsapp", "email", "website"]


def prepare(records: DataFrame, target_city: str | None = None) -> DataFrame:
    """records (idx long, source, source_record_id, name, trade_name, cnpj, website, phones, city, street, lat, lon, linked_record_ids) with comparable keys."""
    name = normalize_business_name(F.coalesce(F.nullif("trade_name", F.lit("")), "name"), F.lit(target_city) if target_city else None)
    stop = F.split(fold_text(F.lit(target_city or "")), " ")
    return records.select(
        "idx",
        "source",
        name.alias("norm"),
        significant_tokens(name, stop).alias("tokens"),
        tax_id("cnpj").alias("tax"),
        website_domain("website").alias("domain"),
        F.array_distinct(F.array_compact(F.transform(F.coalesce("phones", F.array().cast("array<string>")), phone_key))).alias("phone_keys"),
        fold_text("city").alias("city_key"),
        fold_text("street").alias("street_key"),
        "lat",
        "lon",
        F.array_distinct(F.concat(F.array(F.concat_ws(":", "source", "source_record_id")), F.coalesce("linked_record_ids", F.array().cast("array<string>")))).alias("identity"),
    )


def block_keys(p: DataFrame) -> DataFrame:
    """(idx, key) of prepared records."""
    tagged = lambda tag, c: F.transform(c, lambda x: F.concat(F.lit(tag), x))
    one = lambda tag, c: F.array(F.concat(F.lit(tag), F.col(c)))
    place = F.array(F.concat_ws(":", F.lit("geo"), F.when(F.col("lon").isNotNull(), cell(F.col("lat")).cast("string")), cell(F.col("lon")).cast("string"), F.substring("norm", 1, 1)))
    keys = F.concat(tagged("id:", F.col("identity")), one("cnpj:", "tax"), one("dom:", "domain"), tagged("ph:", F.col("phone_keys")), tagged("tok:", F.col("tokens")), F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), place).otherwise(F.array().cast("array<string>")))
    return p.select("idx", F.explode(F.array_distinct(F.array_compact(keys))).alias("key"))


def numbers_in(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), " ")


def pair_terms(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """What several rules of pair_level ask of two records, each computed once: similarity of names, a shared token, distance."""
    sim = gram_similarity(a["norm"], a["grams"], b["norm"], b["grams"]) if "grams" in a else name_similarity(a["norm"], b["norm"])
    return {"_sim": sim, "_shared": F.arrays_overlap(a["tokens"], b["tokens"]), "_meters": haversine(a["lat"], a["lon"], b["lat"], b["lon"])}


def pair_level(a: dict[str, Column], b: dict[str, Column], terms: dict[str, Column] | None = None) -> Column:
    """EXACT, HIGH, MEDIUM, LOW or null for two prepared records given by their columns."""
    sim, shared, meters = (terms or pair_terms(a, b)).values()
    no = F.lit(None).cast("string")
    fits = cities_fit(a["city_key"], b["city_key"])
    street = (a["street_key"] != "") & (a["street_key"] == b["street_key"])
    near = lambda m: F.coalesce(meters <= m, F.lit(False)) | street
    same_set = (F.size(F.array_except(a["tokens"], b["tokens"])) == 0) & (F.size(F.array_except(b["tokens"], a["tokens"])) == 0)
    return (
        F.when(F.arrays_overlap(a["identity"], b["identity"]), "EXACT")
        .when(a["tax"] == b["tax"], "EXACT")
        .when(a["tax"] != b["tax"], no)
        .when(~fits, no)
        .when(a["domain"] == b["domain"], F.when((sim >= 0.3) | shared, "HIGH").otherwise("MEDIUM"))
        .when(F.arrays_overlap(a["phone_keys"], b["phone_keys"]), F.when((sim >= 0.35) | shared, "HIGH").otherwise("MEDIUM"))
        .when((a["norm"] == b["norm"]) & (F.size(a["tokens"]) >= 1), F.when(F.coalesce(meters > 1500, F.lit(False)), "LOW").otherwise("HIGH"))
        .when(~shared, no)
        .when(numbers_in(a["norm"]) != numbers_in(b["norm"]), "LOW")
        .when(same_set & (sim >= 0.8) & near(150), "HIGH")
        .when((sim >= 0.6) & near(300), "MEDIUM")
        .when(sim >= 0.7, "LOW")
    )


def _sides(names: list[str]) -> list[dict[str, Column]]:
    return [{c: F.col(f"{s}_{c}") for c in names} for s in ("a", "b")]


def _side(p: DataFrame, s: str, names: list[str], *own: str) -> DataFrame:
    return p.select(*own, F.col("idx").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in names])


def _levels(both: DataFrame, sides: list[dict[str, Column]]) -> DataFrame:
    terms = pair_terms(*sides)
    level = pair_level(*sides, {c: F.col(c) for c in terms})
    # Exploded, not filtered: a filter would go below the terms and compute all of them again at each use.
    return both.withColumns(terms).select("a", "b", F.explode(F.array_compact(F.array(level))).alias("level"))


def classify(p: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, level) of the pairs that have any evidence."""
    names = [c for c in p.columns if c != "idx"]
    both = pairs.join(_side(p, "a", names), "a").join(_side(p, "b", names), "b")
    return _levels(both, _sides(names))


def block_levels(p: DataFrame, keys: DataFrame, cap: int = BLOCK_CAP) -> DataFrame:
    """What classify gives of candidate_pairs, with shuffles that grow with the records and not with the pairs.

    Records go to their blocks with all that a level asks, and a pair is judged in the first block that both are in, so pairs
    are neither made distinct nor joined with their records. p may be stored before: it is small as a file and large as rows, so joins are hinted.
    """
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n").between(2, cap)).select("key")
    blocks = keys.join(sizes.hint("merge"), "key").groupBy("idx").agg(F.collect_set("key").alias("blocks"))  # a record's own keys
    rows = stored(p.withColumn("grams", trigram_numbers("norm")).join(blocks.hint("merge"), "idx"))
    names = [c for c in rows.columns if c != "idx"]
    key = F.explode("blocks").alias("key")
    both = _side(rows.select("*", key), "a", names, "key").join(_side(rows.select("*", key), "b", names, "key").hint("merge"), "key")
    a, b = _sides(names)
    # Without one of these a pair has no level; names are compared only if it can have one.
    shared = (a["domain"] == b["domain"]) | F.arrays_overlap(a["phone_keys"], b["phone_keys"]) | (a["norm"] == b["norm"]) | F.arrays_overlap(a["tokens"], b["tokens"])
    loose = F.coalesce(a["tax"] == b["tax"], F.lit(True)) & F.coalesce(cities_fit(a["city_key"], b["city_key"]), F.lit(True)) & F.coalesce(shared, F.lit(False))
    may = loose | F.coalesce(a["tax"] == b["tax"], F.lit(False)) | F.arrays_overlap(a["identity"], b["identity"])
    first = F.col("key") == F.array_min(F.array_intersect(a["blocks"], b["blocks"]))
    return _levels(both.where("a < b").where(may).where(first), [a, b])


def _joined(p: DataFrame, levels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The sure links, their components (node, component), and (idx, cluster) of components in which no guard can speak, (idx, cluster, weakest) of the others."""
    rank = F.when(F.col("level") == "EXACT", 3).when(F.col("level") == "HIGH", 2)
    sure = stored(levels.where(rank.isNotNull()).select("a", "b", rank.alias("rank")))
    parts = connected(sure)
    info = parts.join(p.select(F.col("idx").alias("node"), "tax", "city_key"), "node").groupBy("component").agg(F.countDistinct("tax").alias("taxes"), F.countDistinct(F.nullif("city_key", F.lit(""))).alias("cities"))
    open_ = stored(info.where("taxes > 1 or cities > 1").select("component"))
    easy = parts.join(open_, "component", "left_anti").select(F.col("node").alias("idx"), F.col("component").alias("cluster"))
    side = lambda s: p.select(F.col("idx").alias(s), F.col("identity").alias(f"{s}_identity"))
    own = sure.join(parts.select(F.col("node").alias("a"), "component"), "a").join(open_, "component").join(side("a"), "a").join(side("b"), "b")
    own = own.select("component", "a", "b", "rank", F.arrays_overlap("a_identity", "b_identity").alias("same_record"))
    return sure, parts, easy, guarded_clusters(p.select("idx", "tax", F.col("city_key").alias("city")), own)


def clusters(p: DataFrame, levels: DataFrame) -> DataFrame:
    """(idx, cluster) of all prepared records: EXACT and HIGH links join, guards permitting; cluster is its smallest idx."""
    _, _, easy, hard = _joined(p, levels)
    known = easy.unionByName(hard.select("idx", "cluster"))
    return p.select("idx").join(known, "idx", "left").select("idx", F.coalesce("cluster", "idx").alias("cluster"))


def review_pairs(levels: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, level) of the pairs between different clusters: MEDIUM and LOW ones, and, as MEDIUM, sure links, which the guards then refused."""
    side = lambda s: members.select(F.col("idx").alias(s), F.col("cluster").alias(f"_{s}"))
    level = F.when(F.col("level").isin("EXACT", "HIGH"), "MEDIUM").otherwise(F.col("level"))
    return levels.join(side("a"), "a").join(side("b"), "b").where("_a <> _b").select("a", "b", level.alias("level"))


def merged(p: DataFrame, levels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(idx, component, cluster, confidence) of all records, and the pairs (a, b, level) to review.

    component is the smallest idx that sure links reach, whatever the guards say; confidence is the weakest level that
    joined the cluster, null for a record alone.
    """
    sure, parts, easy, hard = _joined(p, levels)
    # Without guards, a cluster is as weak as HIGH unless its EXACT links alone connect it.
    exact = connected(sure.where("rank = 3")).select(F.col("node").alias("idx"), F.col("component").alias("exact"))
    whole = easy.join(exact, "idx", "left").groupBy("cluster").agg((F.countDistinct(F.coalesce("exact", -F.col("idx") - 1)) == 1).alias("whole"))
    soft = easy.join(whole, "cluster").select("idx", "cluster", F.when(F.col("whole"), 3).otherwise(2).alias("weakest"))
    known = soft.unionByName(hard)
    level = F.when(F.col("weakest") == 3, "EXACT").when(F.col("weakest") == 2, "HIGH")
    own = p.select("idx").join(known, "idx", "left").join(parts.withColumnRenamed("node", "idx"), "idx", "left")
    members = own.select("idx", F.coalesce("component", "idx").alias("component"), F.coalesce("cluster", "idx").alias("cluster"), level.alias("confidence"))
    return members, review_pairs(levels, members)


def compare_key(field: str, c: Column) -> Column:
    if field in ("phone", "whatsapp"):
        return F.coalesce(phone_key(c), F.regexp_replace(c, "[^0-9]", ""))
    if field == "cnpj":
        return F.coalesce(tax_id(c), c)
    if field == "website":
        return F.coalesce(website_domain(c), fold_text(c))
    return F.coalesce(email(c), F.lower(F.trim(c))) if field == "email" else fold_text(c)


def fuse(records: DataFrame, members: DataFrame, priorities: dict[str, list[str]], bonus: Column | None = None) -> DataFrame:
    """One row per cluster and field: value, source, alternatives, conflict. records need idx, source, confidence and the fields.

    A value's score is its source's place in the field's priority list times 10, its confidence times 3, and the bonus;
    the first in source order wins ties. In long form, so that one aggregate serves all fields.
    """
    order = F.array_position(F.array(*map(F.lit, SOURCE_ORDER)), F.col("source"))
    fields = [f for f in FIELDS if f in records.columns]
    confidence = F.coalesce(F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])[F.col("confidence")], F.lit(1))
    rows = records.join(members, "idx")
    long = rows.select("cluster", "idx", "source", order.alias("place"), confidence.alias("conf"), (bonus if bonus is not None else F.lit(0)).alias("bonus"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.nullif(F.trim(F.col(f)), F.lit("")).alias("value"), compare_key(f, F.col(f)).alias("key")) for f in fields])).alias("f"))
    long = long.select("cluster", "idx", "source", "place", "conf", "bonus", "f.*").where("value is not null")
    weight = F.lit(0)
    for f in fields:
        ranks = priorities.get(f, [])
        at = F.array_position(F.array(*map(F.lit, ranks)), F.col("source")) if ranks else F.lit(0)
        weight = F.when(F.col("field") == f, F.when(at > 0, (len(ranks) - at + 1) * 10).otherwise(0)).otherwise(weight)
    best = F.struct((weight + F.col("conf") * 3 + F.col("bonus")).alias("score"), (-F.col("place")).alias("place"), (-F.col("idx")).alias("first"))
    out = long.groupBy("cluster", "field").agg(F.max_by(F.struct("value", "source", "key"), best).alias("chosen"), F.collect_set(F.struct("key", "value", "source")).alias("all"))
    others = F.array_sort(F.filter("all", lambda x: x["key"] != F.col("chosen")["key"]))
    return out.select("cluster", "field", F.col("chosen")["value"].alias("value"), F.col("chosen")["source"].alias("source"), others.alias("alternatives"), (F.col("field").isin(*CONFLICT_FIELDS) & (F.size(others) > 0)).alias("conflict"))


def completeness(flags: dict[str, Column]) -> Column:
    return sum((F.when(F.coalesce(flags[k], F.lit(False)), w).otherwise(0) for k, w in COMPLETENESS.items() if k in flags), F.lit(0))


def completeness_label(score: Column) -> Column:
    return F.when(score >= 75, "COMPLETO").when(score >= 45, "PARCIAL").otherwise("FRACO")


def rank_score(complete: Column, confidence: Column, sources: Column) -> Column:
    weight = F.when(confidence == "HIGH", 3).when(confidence == "MEDIUM", 2).otherwise(1)
    return round_half_up(complete * 0.6 + weight * 8 + F.least(F.lit(4), sources) * 4).cast("long")


def visibility(sources: Column, site: Column, socials: Column, video: Column, blog: Column, mail: Column, hours: Column, size_points: Column) -> Column:
    yes = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    total = F.least(F.lit(36), 12 * (sources - 1)) + yes(site, 20) + F.least(F.lit(32), 8 * socials) + yes(video, 5) + yes(blog, 5) + yes(mail, 3) + yes(hours, 3) + size_points
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


LEVELS = {3: "EXACT_MATCH", 2: "LIKELY_MATCH", 1: "POSSIBLE_DUPLICATE", 0: "NO_MATCH"}


def match_keys(df: DataFrame, least: int = 1) -> DataFrame:
    """(id, rank, key) of rows with id, tax, domain, phone, email, name and city: two rows that share a key of a rank match at that rank (LEVELS).

    A tax id or a domain is enough alone (3); of phone, e-mail and name with city two are likely one business (2), one is a
    hint (1). Pairs of the three are keys too, so the best level of two rows is the best key that they share. Nulls and an
    empty name make no key. Keys of a rank below `least` are left out.
    """
    part = lambda c: F.when(F.col(c).isNotNull(), F.array(F.lit(c), c))
    named = F.when((F.col("name") != "") & F.col("city").isNotNull(), F.array(F.lit("name"), "name", "city"))
    loose = [part("phone"), part("email"), named]
    both = [F.concat(x, y) for i, x in enumerate(loose) for y in loose[i + 1 :]]  # null where either is
    keys = {3: [part("tax"), part("domain")], 2: both, 1: loose}
    each = [F.when(k.isNotNull(), F.struct(F.lit(rank).alias("rank"), k.alias("key"))) for rank, ks in keys.items() if rank >= least for k in ks]
    return df.select("id", F.explode(F.array_compact(F.array(*each))).alias("k")).select("id", "k.*")


def import_matches(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, match_id, level) of each incoming row's best match, the smallest id of several as good; match_id is null and the level NO_MATCH without any.

    Of the existing rows of a key only the smallest id goes into the join, so a placeholder that thousands share costs a
    row for each incoming one and makes no pairs.
    """
    first = match_keys(existing).groupBy("rank", "key").agg(F.min("id").alias("match_id"))
    found = match_keys(incoming).join(first, ["rank", "key"])
    best = found.groupBy("id").agg(F.min(F.struct((-F.col("rank")).alias("rank"), "match_id")).alias("b"))
    level = F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.coalesce(-F.col("b")["rank"], F.lit(0)))
    return incoming.select("id").join(best, "id", "left").select("id", F.col("b")["match_id"].alias("match_id"), level.alias("level"))
