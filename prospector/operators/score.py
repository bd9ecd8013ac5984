"""Rule-driven prospect score: rules fire with evidence, points add up by category, categories by weight."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import round_half_up

# Default points and weights.
POINTS = {"no_website": 15, "weak_social_presence": 10, "business_contact_available": 5, "visual_segment": 10, "recurring_content_need": 10, "local_business": 5, "multi_unit": 10, "new_business": 10, "high_offer_fit": 15, "weak_marketing_signals": 10}
CATEGORY = {"no_website": "digital_presence", "weak_social_presence": "digital_presence", "business_contact_available": "digital_presence", "visual_segment": "content_need", "recurring_content_need": "content_need", "local_business": "local_proximity", "multi_unit": "size", "new_business": "fit", "high_offer_fit": "fit", "weak_marketing_signals": "marketing_opportunity"}
WEIGHTS = {"digital_presence": 0.20, "content_need": 0.25, "purchase_capacity": 0.15, "fit": 0.20, "size": 0.10, "local_proximity": 0.10, "marketing_opportunity": 0.0}


@dataclass(frozen=True)
class Rule:
    key: str
    category: str
    points: float
    enabled: bool = True


RULES = tuple(Rule(k, CATEGORY[k], p) for k, p in POINTS.items())


def evaluators(as_of: Column) -> dict[str, Column]:
    """Which rules fire, over columns website, phone, email, whatsapp, opened_at, estimated_size, industry_id, city, state, tags, socials (count), website_flags (array<boolean>), visual, recurring, has_offer."""
    has = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")).isNotNull(), F.lit(False))
    big = F.col("estimated_size").isin("MEDIA", "GRANDE_REGIONAL")
    socials = F.coalesce("socials", F.lit(0))
    months = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("opened_at").cast("timestamp"))) / (86_400_000_000.0 * 30))
    return {
        "no_website": ~has("website"),
        "weak_social_presence": F.when(has("website"), socials == 0).otherwise(socials <= 1),
        "business_contact_available": has("phone") | has("email") | has("whatsapp"),
        "visual_segment": F.col("visual"),
        "recurring_content_need": F.col("recurring"),
        "local_business": has("city") & has("state") & ~F.coalesce(F.col("estimated_size") == "GRANDE_REGIONAL", F.lit(False)),
        "multi_unit": F.array_contains("tags", "MULTI_UNIT") | big,
        "new_business": months <= 12,
        "high_offer_fit": has("industry_id") & F.col("has_offer"),
        "weak_marketing_signals": F.size(F.filter("website_flags", lambda x: x == F.lit(False))) >= 2,
    }


def prospect_score(df: DataFrame, fires: dict[str, Column], rules: tuple[Rule, ...] = RULES, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """df with score, level, category_scores (map) and factors (rules that fired). Unknown and disabled rules count nowhere."""
    live = [r for r in rules if r.enabled and r.key in fires]
    hit = {r.key: F.coalesce(fires[r.key], F.lit(False)) for r in live}
    add = lambda xs: reduce(lambda a, b: a + b, xs, F.lit(0.0))
    by = {}
    for c in weights:
        most = sum(r.points for r in live if r.category == c)
        by[c] = round_half_up(100 * add([F.when(hit[r.key], float(r.points)).otherwise(0.0) for r in live if r.category == c]) / most).cast("long") if most else F.lit(0).cast("long")
    total = sum(weights.values()) or 1.0
    out = df.withColumns({f"_{c}": v for c, v in by.items()})
    score = round_half_up(add([F.col(f"_{c}") * w for c, w in weights.items()]) / total).cast("long")
    factors = F.array_compact(F.array(*[F.when(hit[r.key], F.struct(F.lit(r.key).alias("rule"), F.lit(r.category).alias("category"), F.lit(float(r.points)).alias("points"))) for r in live]))
    scored = out.withColumns({"score": score, "category_scores": F.create_map(*[x for c in weights for x in (F.lit(c), F.col(f"_{c}"))]), "factors": factors}).drop(*[f"_{c}" for c in weights])
    return scored.withColumn("level", level(F.col("score")))


def level(score: Column) -> Column:
    return F.when(score >= 80, "MUITO_ALTO").when(score >= 60, "ALTO").when(score >= 40, "MEDIO").otherwise("BAIXO")


def data_quality(flags: dict[str, Column]) -> Column:
    """flags: tax_id, phone, email, website, name, address, decision_maker, presence_checked."""
    points = {"tax_id": 20, "phone": 15, "email": 10, "website": 15, "name": 10, "address": 10, "decision_maker": 10, "presence_checked": 10}
    return sum((F.when(F.coalesce(flags[k], F.lit(False)), p).otherwise(0) for k, p in points.items() if k in flags), F.lit(0))
