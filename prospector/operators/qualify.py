"""Lead qualification: seven dimensions, each a list of items worth parts of its weight; confidence in five levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_text, round_half_up

# Weights of the dimensions, size adjustments, thresholds.
WEIGHTS = {"fit": 25.0, "visual_need": 20.0, "digital_presence": 15.0, "opportunity": 10.0, "contactability": 10.0, "data_quality": 10.0, "recency": 10.0}
SIZE = {"MEI": -10, "ME": 0, "EPP": 5, "DEMAIS": 10, "MICRO_LOCAL": -5, "PEQUENA": 0, "MEDIA": 5, "GRANDE_REGIONAL": 10}
LEVELS = [(7.0, "VERY_HIGH"), (5.0, "HIGH"), (3.0, "MEDIUM"), (1.5, "LOW")]
NETWORKS = {"instagram": "Instagram", "tiktok": "TikTok", "youtube": "YouTube", "facebook": "Facebook", "linkedin": "LinkedIn"}
QUALIFIED_SCORE, QUALIFIED_LEVELS = 60, ("MEDIUM", "HIGH", "VERY_HIGH")

#: Columns that `qualified` reads.
SCHEMA = (
    "segment_fit int, ticket string, size string, visual int, recurring boolean, street string, house_number string, city string, lat double, lon double, website string, site_status string, "
    "socials array<string>, opened_months double, units int, has_video boolean, keywords int, events boolean, launches boolean, phone_valid boolean, phone_from_registry boolean, whatsapp string, "
    "email_kind string, contact_page boolean, named_contact boolean, sources int, cnpj string, cnpj_active boolean, domain_match string, conflicts int, medium_duplicate boolean, verified_days double, data_days double, text_only boolean"
)


def _part(c: Column, value: Column | float) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), value).otherwise(0.0)


def _has(c: str) -> Column:
    return F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")).isNotNull(), F.lit(False))


def _number(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def has_profile(network: str) -> Column:
    return F.coalesce(F.array_contains("socials", network), F.lit(False))


def channels() -> Column:
    """The site and the profiles of known networks, in order."""
    return F.array_compact(F.array(F.when(_has("website"), "site"), *[F.when(has_profile(n), label) for n, label in NETWORKS.items()]))


def has_presence() -> Column:
    return _has("website") | has_profile("instagram") | has_profile("facebook")


def shows_video() -> Column:
    return has_profile("youtube") | has_profile("tiktok") | F.coalesce("has_video", F.lit(False))


def items() -> dict[str, list[tuple[str, Column]]]:
    """(reason, part of the weight) for each dimension."""
    c = F.col
    social = has_profile
    size = F.coalesce(F.create_map(*[x for k, v in SIZE.items() for x in (F.lit(k), F.lit(v))])[c("size")], F.lit(0))
    located = c("lat").isNotNull() & c("lon").isNotNull()
    fresh = lambda d, steps, rest: reduce(lambda acc, s: F.when(d <= s[0], s[1]).otherwise(acc), reversed(steps), F.lit(rest))
    return {
        "fit": [("segment", _number("segment_fit") / 100 * 0.85), ("ticket", F.when(c("ticket") == "HIGH", 0.15).when(c("ticket") == "MEDIUM", 0.08).otherwise(0.0)), ("size", size / 100)],
        "visual_need": [("visual", _number("visual") / 100 * 0.8), ("recurring", _part(c("recurring"), 0.1)), ("venue", _part((c("visual") >= 70) & (_has("street") | located), 0.1))],
        "digital_presence": [("site", _part(_has("website"), 0.3)), ("site_status", F.when(~_has("website") | c("site_status").isNull(), 0.0).when(c("site_status") == "ACTIVE", 0.1).otherwise(-0.15))]
        + [(n, _part(social(n), p)) for n, p in (("instagram", 0.3), ("tiktok", 0.15), ("youtube", 0.15), ("facebook", 0.1), ("linkedin", 0.05))]
        + [("channels", _part(F.size(channels()) >= 3, 0.1))],
        "opportunity": [
            ("opened", _part(c("opened_months") <= 18, 0.4)),
            ("units", _part(c("units") >= 2, 0.3)),
            ("video", F.when(shows_video(), 0.15).when(has_presence(), F.when(c("site_status") == "ACTIVE", 0.3).otherwise(0.2)).otherwise(0.0)),
            ("keywords", F.least(F.lit(0.25), _number("keywords") * 0.1)),
            ("events", _part(c("events"), 0.1)),
            ("launches", _part(c("launches"), 0.15)),
        ],
        "contactability": [
            ("phone", _part(c("phone_valid"), F.when(F.coalesce(c("phone_from_registry"), F.lit(False)), 0.2).otherwise(0.35))),
            ("whatsapp", _part(_has("whatsapp"), 0.25)),
            ("email", F.when(c("email_kind") == "own", 0.2).when(c("email_kind") == "registry", 0.05).when(c("email_kind").isNotNull(), 0.1).otherwise(0.0)),
            ("instagram", _part(social("instagram"), 0.1)),
            ("contact_page", _part(c("contact_page"), 0.1)),
            ("named_contact", _part(c("named_contact"), 0.05)),
        ],
        "data_quality": [
            ("sources", F.when(c("sources") >= 3, 0.6).when(c("sources") == 2, 0.45).otherwise(0.2)),
            ("tax_id", F.when(_has("cnpj") & F.coalesce(c("cnpj_active"), F.lit(False)), 0.15).when(_has("cnpj"), 0.08).otherwise(0.0)),
            ("address", F.when(_has("street") & _has("house_number"), 0.1).when(_has("street"), 0.05).otherwise(0.0)),
            ("coordinates", _part(located, 0.05)),
            ("domain", F.when(c("domain_match") == "HIGH", 0.1).when(c("domain_match") == "LOW", -0.15).otherwise(0.0)),
            ("conflicts", -F.least(F.lit(0.3), _number("conflicts") * 0.1)),
            ("duplicate", _part(c("medium_duplicate"), -0.1)),
        ],
        "recency": [("recency", F.when(c("verified_days").isNotNull(), fresh(c("verified_days"), [(30, 1.0), (90, 0.8), (180, 0.6), (365, 0.4)], 0.2)).when(c("data_days").isNotNull(), fresh(c("data_days"), [(90, 0.6), (365, 0.4)], 0.1)).otherwise(0.4))],
    }


def confidence_points() -> Column:
    c = F.col
    located = _has("street") & (_has("house_number") | (c("lat").isNotNull() & c("lon").isNotNull()))
    return (
        F.when(c("sources") >= 3, 4.0).when(c("sources") == 2, 3.0).otherwise(1.0)
        + _part(_has("cnpj"), 1.0)
        + F.when(c("site_status") == "ACTIVE", 2.0).when(_has("website"), 0.5).otherwise(0.0)
        + _part(c("phone_valid"), 1.0)
        + _part(located, 1.0)
        - _part(c("domain_match") == "LOW", 1.0)
        - F.least(F.lit(2), _number("conflicts"))
        - _part(c("text_only") & (c("sources") <= 1), 1.0)
        - _part(c("medium_duplicate"), 0.5)
        - _part(c("verified_days").isNull() & (c("data_days") > 730), 1.0)
    )


def confidence_level(points: Column) -> Column:
    out = F.lit("VERY_LOW")
    for least, name in reversed(LEVELS):
        out = F.when(points >= least, name).otherwise(out)
    return out


def qualified(df: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """df with dimensions (map of points), factors (every item that counts, in order), lead_score (0-100), reasons (top 8 by points, earlier items first on ties), confidence and qualified.

    A column disqualified, where df has one, names the rule by which a lead is discarded; such a lead is never qualified.
    """
    found = items()
    part = {d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), reduce(lambda a, b: a + b, [v for _, v in found[d]]))) for d in weights}
    points = {d: round_half_up(part[d] * w, 1) for d, w in weights.items()}
    listed = [(d, name, v) for d in weights for name, v in found[d]]
    factors = F.array(*[F.struct(round_half_up(v * weights[d], 1).alias("points"), F.lit(d).alias("dimension"), F.lit(name).alias("item"), F.lit(i).alias("place")) for i, (d, name, v) in enumerate(listed)])
    out = df.withColumns({"dimensions": F.create_map(*[x for d in weights for x in (F.lit(d), points[d])]), "confidence": confidence_level(confidence_points()), "factors": F.filter(factors, lambda x: x["points"] != 0)})
    total = reduce(lambda a, b: a + b, [F.col("dimensions")[d] for d in weights])
    first = lambda x, y: F.when(x["points"] > y["points"], -1).when(x["points"] < y["points"], 1).when(x["place"] < y["place"], -1).otherwise(1)
    reasons = F.slice(F.array_sort(F.filter("factors", lambda x: x["points"] > 0), first), 1, 8)
    out = out.withColumns({"lead_score": round_half_up(total / sum(weights.values()) * 100).cast("long"), "reasons": reasons})
    stays = F.col("disqualified").isNull() if "disqualified" in df.columns else F.lit(True)
    return out.withColumn("qualified", stays & (F.col("lead_score") >= QUALIFIED_SCORE) & F.col("confidence").isin(*QUALIFIED_LEVELS))


def segment_evidence(activity_level: Column | None, by_tag: Column | None, by_name: Column | None, searched: Column) -> Column:
    """Points of one segment: activity code 30 + 3 x level, tag 20 + 3 x level, name 10, the searched niche 5 more."""
    zero = F.lit(0)
    code = F.when(activity_level.isNotNull(), 30 + 3 * activity_level).otherwise(0) if activity_level is not None else zero
    tag = F.when(by_tag.isNotNull(), 20 + 3 * by_tag).otherwise(0) if by_tag is not None else zero
    name = F.when(by_name, 10).otherwise(0) if by_name is not None else zero
    total = F.greatest(code, tag, name)
    return F.when(total > 0, total + F.when(searched, 5).otherwise(0)).otherwise(0)


def segment_of(evidence: dict[str, Column]) -> Column:
    """The segment with the most points; the first on ties, null without any."""
    best = F.array_max(F.array(*[F.struct(p.alias("points"), F.lit(-i).alias("first"), F.lit(s).alias("segment")) for i, (s, p) in enumerate(evidence.items())]))
    return F.when(best["points"] > 0, best["segment"])


def exclusion(name: Column, category: Column, activity: Column, patterns: list[str], categories: list[str], prefixes: list[str]) -> Column:
    """Why a record is left out: category, activity or name; null if it stays. "key=*" is any value of a category key."""
    wild = [c[:-1] for c in categories if c.endswith("=*")]
    listed = category.isin(*categories) if categories else F.lit(False)
    for w in wild:
        listed = listed | category.startswith(w)
    code = reduce(lambda a, b: a | b, [activity.startswith(p) for p in prefixes], F.lit(False))
    named = fold_text(name).rlike("|".join(patterns)) if patterns else F.lit(False)
    return F.when(listed, "category").when(code, "activity").when(named, "name")


def field_status(value: Column, verified: Column, inferred: Column) -> Column:
    return F.when(value.isNull(), "UNKNOWN").when(inferred, "INFERRED").when(verified, "CONFIRMED").otherwise("INFERRED")
