"""What qualified leads say: tags, signals, alerts, why a lead is shown, and the figures of a whole search by segment, neighbourhood, source and rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import round_half_up
from .qualify import NETWORKS, SCHEMA, SIZE, WEIGHTS, _has, channels, has_presence, has_profile, qualified, shows_video

#: Columns that `told` reads besides those of `qualify.SCHEMA`. profiles: network to address; disqualified: why a lead is discarded.
TOLD = (
    "segment string, segment_label string, segment_status string, segment_evidence string, subcategory string, pitch string, phone string, email string, profiles map<string,string>, opened_at date, "
    "video_platforms array<string>, opportunity_words array<string>, conflict_fields array<string>, duplicate_names array<string>, domain string, source_labels array<string>, disqualified string"
)

# The texts that users read.
CONFIDENCE = {"VERY_LOW": "muito baixa", "LOW": "baixa", "MEDIUM": "média", "HIGH": "alta", "VERY_HIGH": "muito alta"}
DIMENSIONS = {"fit": "fit", "visual_need": "necessidade visual", "digital_presence": "presença digital", "opportunity": "oportunidade", "contactability": "contato", "data_quality": "dados", "recency": "recência"}
NO_SEGMENT = "Segmento não identificado nas fontes — avalie manualmente."
INSTAGRAM = "Atividade/frequência do Instagram não é medida (sem API permitida) — confira o perfil antes da abordagem."
NO_PRESENCE = "Nenhuma presença digital encontrada nas fontes — menor sinal de investimento em marketing."
NO_CHANNEL = "Nenhum canal de contato comercial público encontrado."
UNKNOWN_SEGMENT = "Não identificado"


def _text(*parts: Column | str) -> Column:
    """Parts in a row, nulls as nothing."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _number(c: Column) -> Column:
    """25 for 25.0, 12.5 for 12.5."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def _list(c: Column | str) -> Column:
    return F.coalesce(F.array_join(c, ", "), F.lit(""))


def _those(*cases: tuple[Column, Column | str]) -> Column:
    """The values of the cases that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), v) for c, v in cases]))


def _videos() -> Column:
    on_site = _text("vídeo no site (", F.coalesce(F.nullif(_list("video_platforms"), F.lit("")), F.lit("player")), ")")
    return _those((has_profile("youtube"), "YouTube"), (has_profile("tiktok"), "TikTok"), (F.col("has_video"), on_site))


def _new() -> Column:
    return F.col("opened_months") <= 18


def _reachable() -> Column:
    return F.coalesce("phone_valid", F.lit(False)) | _has("whatsapp") | _has("email") | has_profile("instagram") | has_profile("facebook")


def signals() -> Column:
    """array of struct(key, label, status, evidence)."""
    said = lambda k, label, status, evidence: F.struct(F.lit(k).alias("key"), F.lit(label).alias("label"), F.lit(status).alias("status"), F.coalesce(evidence, F.lit("")).alias("evidence"))
    gap, words = ~shows_video() & has_presence(), F.array_distinct("opportunity_words")
    looked = F.when(F.col("site_status") == "ACTIVE", "homepage analisada sem vídeo; sem YouTube/TikTok").otherwise("sem YouTube/TikTok nas fontes")
    return _those(
        (_has("website"), said("has_website", "Website encontrado", "CONFIRMED", F.col("website"))),
        *[(has_profile(n), said(f"has_{n}", f"{label} encontrado", "CONFIRMED", F.try_element_at("profiles", F.lit(n)))) for n, label in NETWORKS.items()],
        (_new(), said("new_business", "Negócio aberto recentemente", "CONFIRMED", _text("abertura ", F.date_format("opened_at", "MM/yyyy")))),
        (F.col("units") >= 2, said("multiple_locations", "Múltiplas unidades", "CONFIRMED", _text(F.col("units"), " endereços com o mesmo nome/domínio"))),
        (shows_video(), said("video_active", "Já publica vídeo", "CONFIRMED", _list(_videos()))),
        (gap, said("low_video_presence", "Sem vídeo aparente", "INFERRED", looked)),
        (F.size("opportunity_words") > 0, said("opportunity_keywords", "Menciona lançamento/evento/reservas", "INFERRED", _list(words))),
    )


def tags() -> Column:
    """Sorted names of what holds for a lead."""
    c, gap = F.col, ~shows_video() & has_presence()
    return F.array_sort(
        _those(
            (c("ticket") == "HIGH", "high_ticket"), (c("recurring"), "recurring_content"), (c("visual") >= 80, "high_visual_potential"), (_has("website"), "has_website"),
            *[(has_profile(n), f"has_{n}") for n in NETWORKS], (F.size(channels()) >= 3, "strong_digital_presence"), (_new(), "new_business"), (c("units") >= 2, "multiple_locations"),
            (shows_video(), "video_active"), (gap, "low_video_presence"), (gap & (c("visual") >= 70), "needs_video"), (~_reachable(), "no_contact"), (c("sources") >= 2, "multi_source"),
            (_has("cnpj") & c("cnpj_active"), "registry_confirmed"), (c("qualified"), "qualified"), (c("segment").isNotNull(), F.concat(F.lit("segment:"), c("segment"))),
        )
    )


def alerts() -> Column:
    """What to look at before calling: gaps and contradictions, then the items that took points off; each text once."""
    c = F.col
    down = _has("website") & (c("site_status") != "ACTIVE")
    fields, count = _list("conflict_fields"), F.coalesce("conflicts", F.lit(0))
    stale = c("verified_days").isNull() & (c("data_days") > 365)
    said = _those(
        (c("segment_status") == "INFERRED", _text("Segmento deduzido só pelo nome (", c("segment_evidence"), ") — confirme a atividade.")),
        (c("segment").isNull(), NO_SEGMENT),
        (down, _text("Website não respondeu (", c("site_status"), ").")),
        (has_profile("instagram"), INSTAGRAM),
        (F.size(channels()) == 0, NO_PRESENCE),
        (_has("phone") & ~F.coalesce("phone_valid", F.lit(False)), _text("Telefone em formato inválido: ", c("phone"))),
        (~_reachable(), NO_CHANNEL),
        (c("domain_match") == "LOW", _text("Website ", c("domain"), " não parece ser desta empresa — confirme antes de usar.")),
        (count > 0, _text("Fontes divergem em: ", fields, ".")),
        (stale, _text("Dado com mais de 1 ano (", round_half_up(c("data_days")).cast("long"), " dias) e nunca verificado.")),
    )
    lost = {
        "size": (_text("Porte ", c("size")), _text("ajuste de porte do ICP: ", F.element_at(F.create_map(*[F.lit(x) for kv in SIZE.items() for x in kv]), c("size")))),
        "site_status": (F.lit("Site fora do ar"), _text("análise do site: ", c("site_status"))),
        "domain": (F.lit("Domínio não corresponde ao nome"), c("domain")),
        "conflicts": (_text(count, " conflito(s) entre fontes"), fields),
        "duplicate": (F.lit("Possível duplicata"), _list(F.slice("duplicate_names", 1, 2))),
    }
    minus = F.filter("factors", lambda x: x["points"] < 0)
    line = lambda x: reduce(lambda acc, kv: F.when(x["item"] == kv[0], _text(kv[1][0], " (", _number(x["points"]), ") — ", kv[1][1])).otherwise(acc), lost.items(), F.lit(None).cast("string"))
    return F.array_distinct(F.concat(said, F.array_compact(F.transform(minus, line))))


def why(weights: dict[str, float] = WEIGHTS) -> Column:
    """A few sentences: what the lead is, its signals, channels and contacts, who confirms it, and how the score adds up."""
    c = F.col
    label = _text(c("segment_label"), F.when(_has("subcategory"), _text(" (", c("subcategory"), ")")), F.when(c("segment_status") == "INFERRED", " — segmento deduzido pelo nome"))
    own = F.slice(F.transform(F.filter("signals", lambda x: ~x["key"].startswith("has_")), lambda x: _text(F.lower(x["label"]), " (", x["evidence"], ")")), 1, 3)
    contacts = _those((_has("phone"), "telefone"), (_has("whatsapp"), "WhatsApp"), (_has("email"), "e-mail"), (has_profile("instagram"), "Instagram"))
    some = lambda xs, then, otherwise: F.when(F.size(xs) > 0, then).otherwise(otherwise)
    names = F.coalesce("source_labels", F.array().cast("array<string>"))
    level = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), c("confidence"))
    score = F.concat_ws(" + ", *[_text(f"{DIMENSIONS[d]} ", _number(c("dimensions")[d]), "/", _number(F.lit(float(w)))) for d, w in weights.items()])
    told = F.concat_ws(
        " ",
        _text("Apareceu por ser ", F.when(c("segment").isNotNull(), label).otherwise("segmento não identificado"), ": ", c("pitch"), "."),
        some(own, _text("Sinais: ", F.array_join(own, "; "), "."), F.lit(None).cast("string")),
        some(channels(), _text("Presença digital: ", _list(channels()), F.when(~shows_video(), ", sem vídeo aparente"), "."), "Sem presença digital encontrada."),
        some(contacts, _text("Contato público: ", _list(contacts), "."), "Nenhum contato comercial público encontrado."),
        _text("Confirmado por ", F.size(names), " fonte(s) (", F.coalesce(F.nullif(_list(names), F.lit("")), F.lit("—")), "); confiança ", level, "."),
        _text("Score ", c("lead_score"), "/100 = ", score, "."),
    )
    return F.when(c("disqualified").isNotNull(), _text("Descartado na validação: ", c("disqualified"), ".")).otherwise(told)


def told(df: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """df, with the columns of `qualify.SCHEMA` and TOLD, as `qualified` gives it, with tags, signals, alerts and why. Each row on its own: no shuffle; nulls in any column are missing values."""
    out = qualified(df, weights).withColumns({"tags": tags(), "signals": signals(), "alerts": alerts()})
    return out.withColumn("why", why(weights))


def summary(leads: DataFrame, neighborhoods: int = 50) -> DataFrame:
    """(kind, name, n, qualified, mean_score, mean_confidence) of a search's leads, long form.

    leads: segment, neighborhood, sources (array), lead_score, confidence, qualified, discarded (the rule; null where a lead
    stays). kind: all, confidence (every level, zeros included), segment, neighborhood (the first so many by qualified, then
    by number), source (a lead counts once for each of its own) and discarded (by rule; only n). Means to one decimal, of
    levels 1 to 5 for confidence; 0 for all of none. A lead makes a row for each group that it is in, added up before the shuffle.
    """
    kept, level = F.col("discarded").isNull(), F.array_position(F.array(*[F.lit(x) for x in CONFIDENCE]), F.col("confidence"))
    group = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"))
    by_source = F.transform(F.array_distinct(F.array_compact(F.coalesce("sources", F.array().cast("array<string>")))), lambda s: group("source", s))
    stays = F.concat(F.array(group("all", F.lit("")), group("confidence", F.col("confidence")), group("segment", F.coalesce("segment", F.lit(UNKNOWN_SEGMENT)))), by_source)
    figures = [F.count("score").alias("n"), F.count_if("good").alias("qualified"), F.avg("score").alias("s"), F.avg("level").alias("c")]
    measures = [F.coalesce("lead_score", F.lit(0)).alias("score"), F.coalesce("qualified", F.lit(False)).alias("good"), level.alias("level")]
    rows = leads.select(F.explode(F.when(kept, stays).otherwise(F.array(group("discarded", F.col("discarded"))))).alias("g"), *measures).select("g.*", "score", "good", "level")
    levels = leads.sparkSession.createDataFrame([("confidence", x) for x in CONFIDENCE] + [("all", "")], "kind string, name string")
    none = levels.select("kind", "name", F.lit(None).cast("long").alias("score"), F.lit(False).alias("good"), F.lit(None).cast("long").alias("level"))
    counted = rows.unionByName(none).groupBy("kind", "name").agg(*figures)
    hood = F.nullif(F.trim("neighborhood"), F.lit(""))
    near = leads.where(kept & hood.isNotNull()).select(F.lit("neighborhood").alias("kind"), hood.alias("name"), *measures).groupBy("kind", "name").agg(*figures)
    near = near.orderBy(F.desc("qualified"), F.desc("n"), "name").limit(neighborhoods)
    mean = lambda c: F.when(F.col("kind") != "discarded", F.coalesce(round_half_up(F.col(c), 1), F.lit(0.0)))
    shown = lambda c: F.when(F.col("kind") != "discarded", F.col(c))
    return counted.unionByName(near).select("kind", "name", "n", shown("qualified").alias("qualified"), mean("s").alias("mean_score"), mean("c").alias("mean_confidence"))
