"""What leads and searches say: rules at their edges, missing values, empty tables."""

from pyspark.sql import functions as F

from prospector.operators import narrative, qualify

KINDS = [x.split(" ") for x in f"{qualify.SCHEMA}, {narrative.TOLD}".split(", ")]


def rows_of(spark, *rows):
    return spark.createDataFrame([tuple(r.get(c) for c, _ in KINDS) for r in rows], ", ".join(" ".join(k) for k in KINDS))


def test_rules_of_dimensions_at_their_edges(spark):
    """The site is a channel, profiles of videos are video, an address needs no city, a number without a street is no place, any answer but ACTIVE is a site that is down."""
    given = [
        {"website": "w", "socials": ["instagram", "facebook"]},
        {"socials": ["youtube"]},
        {"socials": ["linkedin"]},
        {"street": "s", "house_number": "1"},
        {"house_number": "1", "lat": 1.0, "lon": 1.0},
        {"website": "w", "site_status": "TIMEOUT"},
        {"site_status": "ACTIVE"},
        {"street": "s", "visual": 70},
    ]
    df = rows_of(spark, *[{**r, "segment": str(i)} for i, r in enumerate(given)])
    got = {int(r["segment"]): r["dimensions"] for r in qualify.qualified(df).collect()}
    digital, opportunity, data, visual = ([got[i][d] for i in range(len(given))] for d in ("digital_presence", "opportunity", "data_quality", "visual_need"))
    assert digital == [12.0, 2.3, 0.8, 0.0, 0.0, 2.3, 0.0, 0.0]
    assert opportunity == [2.0, 1.5, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0]
    assert data == [2.0, 2.0, 2.0, 3.0, 2.5, 2.0, 2.0, 2.5] and visual[7] == 13.2
    points = {int(r["segment"]): r["p"] for r in df.select("segment", qualify.confidence_points().alias("p")).collect()}
    assert [points[i] for i in (3, 4, 5, 6)] == [2.0, 1.0, 1.5, 3.0]


def test_reasons_keep_the_order_of_items_on_ties(spark):
    got = qualify.qualified(rows_of(spark, {"whatsapp": "1", "opened_months": 40.0, "phone_valid": True, "phone_from_registry": True, "email_kind": "own"})).first()
    assert [(x["item"], x["points"]) for x in got["reasons"]] == [("recency", 4.0), ("whatsapp", 2.5), ("phone", 2.0), ("email", 2.0), ("sources", 2.0)]


def test_a_lead_of_which_nothing_is_known(spark):
    got = narrative.told(rows_of(spark, {})).first()
    assert got["tags"] == ["no_contact"] and got["signals"] == []
    assert got["alerts"] == [narrative.NO_SEGMENT, narrative.NO_PRESENCE, narrative.NO_CHANNEL]
    assert got["why"] == (
        "Apareceu por ser segmento não identificado: . Sem presença digital encontrada. Nenhum contato comercial público encontrado. Confirmado por 0 fonte(s) (—); confiança muito baixa. "
        "Score 6/100 = fit 0/25 + necessidade visual 0/20 + presença digital 0/15 + oportunidade 0/10 + contato 0/10 + dados 2/10 + recência 4/10."
    )


def test_what_is_said_of_a_lead(spark):
    lead = {"segment": "gym", "segment_label": "Academia", "segment_status": "INFERRED", "segment_evidence": "x", "pitch": "p", "website": "w", "site_status": "DOWN", "phone": "12", "units": 3, "opportunity_words": ["a", "b", "a"], "keywords": 3, "size": "MEI", "segment_fit": 80, "data_days": 400.5, "disqualified": None}
    got = narrative.told(rows_of(spark, lead)).first()
    assert [s["key"] for s in got["signals"]] == ["has_website", "multiple_locations", "low_video_presence", "opportunity_keywords"] and got["signals"][3]["evidence"] == "a, b"
    assert got["alerts"] == [
        "Segmento deduzido só pelo nome (x) — confirme a atividade.", "Website não respondeu (DOWN).", "Telefone em formato inválido: 12", narrative.NO_CHANNEL, "Dado com mais de 1 ano (401 dias) e nunca verificado.",
        "Porte MEI (-2.5) — ajuste de porte do ICP: -10", "Site fora do ar (-2.2) — análise do site: DOWN",
    ]
    assert "Sinais: múltiplas unidades (3 endereços com o mesmo nome/domínio); sem vídeo aparente (sem YouTube/TikTok nas fontes); menciona lançamento/evento/reservas (a, b)." in got["why"]
    gone = narrative.told(rows_of(spark, {**lead, "disqualified": "motivo"})).first()
    assert gone["why"] == "Descartado na validação: motivo." and not gone["qualified"] and gone["lead_score"] == got["lead_score"]


def test_summaries(spark):
    kind = "segment string, neighborhood string, sources array<string>, lead_score long, confidence string, qualified boolean, discarded string"
    rows = [("a", " Sul ", ["x", "y", "x", None], 71, "HIGH", True, None), ("a", "Sul", ["x"], 70, "LOW", False, None), (None, "", None, None, "LOW", None, None), ("b", "Norte", ["y"], 90, "HIGH", True, "closed"), ("b", None, [], 1, None, False, "closed")]
    got = {(r["kind"], r["name"]): tuple(r)[2:] for r in narrative.summary(spark.createDataFrame(rows, kind)).collect()}
    assert got[("all", "")] == (3, 1, 47.0, 2.7) and got[("discarded", "closed")] == (2, None, None, None)
    assert got[("segment", "a")] == (2, 1, 70.5, 3.0) and got[("segment", "Não identificado")][:2] == (1, 0)
    assert got[("source", "x")] == (2, 1, 70.5, 3.0) and got[("source", "y")] == (1, 1, 71.0, 4.0)
    assert got[("neighborhood", "Sul")][:2] == (2, 1) and got[("confidence", "VERY_HIGH")] == (0, 0, 0.0, 0.0) and len(got) == 12
    empty = narrative.summary(spark.createDataFrame([], kind)).collect()
    assert {r["kind"]: r["n"] for r in empty} == {"all": 0, "confidence": 0} and len(empty) == 6
    assert narrative.told(rows_of(spark)).count() == 0


def test_factors_are_what_counts(spark):
    got = qualify.qualified(rows_of(spark, {"size": "MEI", "street": "s"})).select(F.transform("factors", lambda x: F.concat_ws(":", x["item"], x["points"])).alias("f")).first()
    assert got["f"] == ["size:-2.5", "sources:2.0", "address:0.5", "recency:4.0"]
