"""Queries of what a search's results say: the score and story of every lead, and the figures of the whole search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import narrative, qualify, score, score_tables, stored_tables
from ..operators.graph import new_path
from ..sources import files
from .catalogue import query
from .leads import RULES_SQL, now, pick, pick_sql, prospects

TEXT = "array<string>"

LEADS_SQL = f"""x AS (SELECT c_custkey AS k, c_custkey % 101 AS segment_fit, c_custkey % 97 AS visual, {pick_sql('c_custkey', 'HIGH', 'MEDIUM', None)} AS ticket, {pick_sql('c_custkey', 'MEI', 'DEMAIS', None, 'EPP')} AS size,
  c_custkey % 2 = 0 AS recurring, c_custkey % 4 <> 0 AS street, c_custkey % 3 = 0 AS house, c_custkey % 5 = 0 AS placed, c_acctbal > 0 AS site, {pick_sql('c_custkey', 'ACTIVE', 'DOWN', None, 'TIMEOUT', None)} AS site_status,
  CASE c_custkey % 7 WHEN 0 THEN ['instagram', 'facebook'] WHEN 1 THEN ['youtube'] WHEN 2 THEN ['tiktok', 'linkedin', 'instagram'] ELSE CAST([] AS VARCHAR[]) END AS socials, c_custkey % 30 AS months, c_custkey % 3 AS units, c_custkey % 11 = 0 AS video,
  c_custkey % 4 AS words, c_custkey % 13 = 0 AS events, c_custkey % 17 = 0 AS launches, c_custkey % 6 <> 0 AS phone, c_custkey % 6 > 1 AS phone_valid, c_custkey % 8 = 0 AS registry, c_custkey % 10 = 0 AS whatsapp, {pick_sql('c_custkey', None, 'own', 'registry', 'other')} AS email,
  c_custkey % 9 = 0 AS contact_page, c_custkey % 12 = 0 AS named, c_custkey % 4 AS sources, c_custkey % 3 = 1 AS cnpj, c_custkey % 2 = 1 AS active, {pick_sql('c_custkey', None, 'HIGH', 'LOW')} AS domain_match, CASE WHEN c_custkey % 5 = 2 THEN 2 ELSE 0 END AS conflicts,
  c_custkey % 19 = 0 AS twin, CASE WHEN c_custkey % 4 = 1 THEN c_custkey * 7 % 500 END AS verified, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 11 % 1000 END AS aged, c_custkey % 2 = 0 AS text_only,
  CASE WHEN c_custkey % 6 <> 5 THEN c_mktsegment END AS segment, c_custkey % 5 = 1 AS guessed, CASE WHEN c_custkey % 23 = 0 THEN 'motivo' END AS disqualified FROM customer),
y AS (SELECT *, ['Base', 'Mapa', 'Lista'][1:sources] AS labels, list_contains(socials, 'instagram') AS ig, list_contains(socials, 'facebook') AS fb, list_contains(socials, 'youtube') AS yt, list_contains(socials, 'tiktok') AS tt, list_contains(socials, 'linkedin') AS li FROM x),
z AS (SELECT *, yt OR tt OR video AS moving, site OR ig OR fb AS presence, phone_valid OR whatsapp OR email IS NOT NULL OR ig OR fb AS reachable,
  list_filter([CASE WHEN site THEN 'site' END, CASE WHEN ig THEN 'Instagram' END, CASE WHEN tt THEN 'TikTok' END, CASE WHEN yt THEN 'YouTube' END, CASE WHEN fb THEN 'Facebook' END, CASE WHEN li THEN 'LinkedIn' END], lambda v: v IS NOT NULL) AS channels FROM y),
i AS (SELECT *, [{{'d': 'fit', 'i': 'segment', 'v': segment_fit / 100e0 * 0.85e0}}, {{'d': 'fit', 'i': 'ticket', 'v': CASE ticket WHEN 'HIGH' THEN 0.15e0 WHEN 'MEDIUM' THEN 0.08e0 ELSE 0e0 END}},
  {{'d': 'fit', 'i': 'size', 'v': CASE size WHEN 'MEI' THEN -10 WHEN 'DEMAIS' THEN 10 WHEN 'EPP' THEN 5 ELSE 0 END / 100e0}}, {{'d': 'visual_need', 'i': 'visual', 'v': visual / 100e0 * 0.8e0}}, {{'d': 'visual_need', 'i': 'recurring', 'v': 0.1e0 * recurring::INT}},
  {{'d': 'visual_need', 'i': 'venue', 'v': 0.1e0 * (visual >= 70 AND (street OR placed))::INT}}, {{'d': 'digital_presence', 'i': 'site', 'v': 0.3e0 * site::INT}},
  {{'d': 'digital_presence', 'i': 'site_status', 'v': CASE WHEN NOT site OR site_status IS NULL THEN 0e0 WHEN site_status = 'ACTIVE' THEN 0.1e0 ELSE -0.15e0 END}}, {{'d': 'digital_presence', 'i': 'instagram', 'v': 0.3e0 * ig::INT}},
  {{'d': 'digital_presence', 'i': 'tiktok', 'v': 0.15e0 * tt::INT}}, {{'d': 'digital_presence', 'i': 'youtube', 'v': 0.15e0 * yt::INT}}, {{'d': 'digital_presence', 'i': 'facebook', 'v': 0.1e0 * fb::INT}}, {{'d': 'digital_presence', 'i': 'linkedin', 'v': 0.05e0 * li::INT}},
  {{'d': 'digital_presence', 'i': 'channels', 'v': 0.1e0 * (len(channels) >= 3)::INT}}, {{'d': 'opportunity', 'i': 'opened', 'v': 0.4e0 * (months <= 18)::INT}}, {{'d': 'opportunity', 'i': 'units', 'v': 0.3e0 * (units >= 2)::INT}},
  {{'d': 'opportunity', 'i': 'video', 'v': CASE WHEN moving THEN 0.15e0 WHEN presence AND site_status = 'ACTIVE' THEN 0.3e0 WHEN presence THEN 0.2e0 ELSE 0e0 END}}, {{'d': 'opportunity', 'i': 'keywords', 'v': least(0.25e0, words * 0.1e0)}},
  {{'d': 'opportunity', 'i': 'events', 'v': 0.1e0 * events::INT}}, {{'d': 'opportunity', 'i': 'launches', 'v': 0.15e0 * launches::INT}}, {{'d': 'contactability', 'i': 'phone', 'v': CASE WHEN NOT phone_valid THEN 0e0 WHEN registry THEN 0.2e0 ELSE 0.35e0 END}},
  {{'d': 'contactability', 'i': 'whatsapp', 'v': 0.25e0 * whatsapp::INT}}, {{'d': 'contactability', 'i': 'email', 'v': CASE email WHEN 'own' THEN 0.2e0 WHEN 'registry' THEN 0.05e0 WHEN 'other' THEN 0.1e0 ELSE 0e0 END}}, {{'d': 'contactability', 'i': 'instagram', 'v': 0.1e0 * ig::INT}},
  {{'d': 'contactability', 'i': 'contact_page', 'v': 0.1e0 * contact_page::INT}}, {{'d': 'contactability', 'i': 'named_contact', 'v': 0.05e0 * named::INT}}, {{'d': 'data_quality', 'i': 'sources', 'v': CASE WHEN sources >= 3 THEN 0.6e0 WHEN sources = 2 THEN 0.45e0 ELSE 0.2e0 END}},
  {{'d': 'data_quality', 'i': 'tax_id', 'v': CASE WHEN cnpj AND active THEN 0.15e0 WHEN cnpj THEN 0.08e0 ELSE 0e0 END}}, {{'d': 'data_quality', 'i': 'address', 'v': CASE WHEN street AND house THEN 0.1e0 WHEN street THEN 0.05e0 ELSE 0e0 END}}, {{'d': 'data_quality', 'i': 'coordinates', 'v': 0.05e0 * placed::INT}},
  {{'d': 'data_quality', 'i': 'domain', 'v': CASE domain_match WHEN 'HIGH' THEN 0.1e0 WHEN 'LOW' THEN -0.15e0 ELSE 0e0 END}}, {{'d': 'data_quality', 'i': 'conflicts', 'v': -least(0.3e0, conflicts * 0.1e0)}}, {{'d': 'data_quality', 'i': 'duplicate', 'v': -0.1e0 * twin::INT}},
  {{'d': 'recency', 'i': 'recency', 'v': CASE WHEN verified IS NOT NULL THEN CASE WHEN verified <= 30 THEN 1e0 WHEN verified <= 90 THEN 0.8e0 WHEN verified <= 180 THEN 0.6e0 WHEN verified <= 365 THEN 0.4e0 ELSE 0.2e0 END WHEN aged IS NOT NULL THEN CASE WHEN aged <= 90 THEN 0.6e0 WHEN aged <= 365 THEN 0.4e0 ELSE 0.1e0 END ELSE 0.4e0 END}}] AS items,
  CASE WHEN sources >= 3 THEN 4e0 WHEN sources = 2 THEN 3e0 ELSE 1e0 END + cnpj::INT + CASE WHEN site_status = 'ACTIVE' THEN 2e0 WHEN site THEN 0.5e0 ELSE 0e0 END + phone_valid::INT + (street AND (house OR placed))::INT - coalesce(domain_match = 'LOW', FALSE)::INT - least(2, conflicts)
    - (text_only AND sources <= 1)::INT - 0.5e0 * twin::INT - coalesce(verified IS NULL AND aged > 730, FALSE)::INT AS sure FROM z),
weighed AS (SELECT *, list_transform([{{'d': 'fit', 'w': 25e0}}, {{'d': 'visual_need', 'w': 20e0}}, {{'d': 'digital_presence', 'w': 15e0}}, {{'d': 'opportunity', 'w': 10e0}}, {{'d': 'contactability', 'w': 10e0}}, {{'d': 'data_quality', 'w': 10e0}}, {{'d': 'recency', 'w': 10e0}}],
  lambda g: {{'d': g.d, 'w': g.w, 'p': floor(greatest(0e0, least(1e0, list_reduce(list_transform(list_filter(items, lambda t: t.d = g.d), lambda t: t.v), lambda a, b: a + b))) * g.w * 10 + 0.5e0) / 10}}) AS dims FROM i),
scored AS (SELECT *, CAST(floor(list_reduce(list_transform(dims, lambda g: g.p), lambda a, b: a + b) / 100e0 * 100 + 0.5e0) AS BIGINT) AS lead_score, CASE WHEN sure >= 7 THEN 'VERY_HIGH' WHEN sure >= 5 THEN 'HIGH' WHEN sure >= 3 THEN 'MEDIUM' WHEN sure >= 1.5e0 THEN 'LOW' ELSE 'VERY_LOW' END AS confidence FROM weighed),
lead AS (SELECT *, disqualified IS NULL AND lead_score >= 60 AND sure >= 3 AS qualified FROM scored)"""


def leads(t):
    """A lead for each customer; columns of `qualify.SCHEMA` and `narrative.TOLD`."""
    k, c = F.col("c_custkey"), F.col
    words = lambda *w: F.array(*[F.lit(x) for x in w]).cast(TEXT)
    given = {
        "segment_fit": k % 101, "visual": k % 97, "ticket": pick(k, "HIGH", "MEDIUM", None), "size": pick(k, "MEI", "DEMAIS", None, "EPP"), "recurring": k % 2 == 0, "street": F.when(k % 4 != 0, "Rua"), "house_number": F.when(k % 3 == 0, "7"),
        "lat": F.when(k % 5 == 0, 1.0), "lon": F.when(k % 5 == 0, 2.0), "website": F.when(c("c_acctbal") > 0, "w.com"), "site_status": pick(k, "ACTIVE", "DOWN", None, "TIMEOUT", None), "opened_months": k % 30, "units": k % 3, "has_video": k % 11 == 0,
        "socials": F.when(k % 7 == 0, words("instagram", "facebook")).when(k % 7 == 1, words("youtube")).when(k % 7 == 2, words("tiktok", "linkedin", "instagram")), "keywords": k % 4, "events": k % 13 == 0, "launches": k % 17 == 0,
        "phone": F.when(k % 6 != 0, "3611"), "phone_valid": k % 6 > 1, "phone_from_registry": k % 8 == 0, "whatsapp": F.when(k % 10 == 0, "z"), "email_kind": pick(k, None, "own", "registry", "other"), "email": F.when(k % 4 != 0, "a@b"), "contact_page": k % 9 == 0,
        "named_contact": k % 12 == 0, "sources": k % 4, "cnpj": F.when(k % 3 == 1, "1"), "cnpj_active": k % 2 == 1, "domain_match": pick(k, None, "HIGH", "LOW"), "conflicts": F.when(k % 5 == 2, 2).otherwise(0), "medium_duplicate": k % 19 == 0,
        "verified_days": F.when(k % 4 == 1, k * 7 % 500), "data_days": F.when(k % 3 == 0, k * 11 % 1000), "text_only": k % 2 == 0, "segment": F.when(k % 6 != 5, c("c_mktsegment")), "segment_label": F.when(k % 6 != 5, c("c_mktsegment")),
        "segment_status": F.when(k % 5 == 1, "INFERRED").otherwise("CONFIRMED"), "segment_evidence": F.lit("nome"), "subcategory": F.when(k % 8 == 3, "sub"), "pitch": F.lit("rende vídeo"), "profiles": F.create_map(F.lit("instagram"), F.lit("@i")),
        "opened_at": F.lit("1996-03-15"), "video_platforms": F.when(k % 22 == 0, words("vimeo")), "opportunity_words": F.slice(words("festa", "show", "festa"), F.lit(1), (k % 4).cast("int")), "conflict_fields": words("phone", "street"),
        "duplicate_names": words("A", "B", "C"), "domain": F.lit("w.com"), "source_labels": F.slice(words("Base", "Mapa", "Lista"), F.lit(1), (k % 4).cast("int")), "disqualified": F.when(k % 23 == 0, "motivo"),
    }
    kinds = [x.split(" ") for x in f"{qualify.SCHEMA}, {narrative.TOLD}".split(", ")]
    return t("customer").select("c_custkey", "c_nationkey", *[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds])


@query(f"""WITH {LEADS_SQL}, said AS (SELECT *, list_filter([CASE WHEN yt THEN 'YouTube' END, CASE WHEN tt THEN 'TikTok' END, CASE WHEN video THEN 'vídeo no site (' || CASE WHEN k % 22 = 0 THEN 'vimeo' ELSE 'player' END || ')' END], lambda v: v IS NOT NULL) AS videos, CASE WHEN words = 1 THEN 'festa' ELSE 'festa, show' END AS hits FROM lead),
s AS (SELECT *, list_filter([CASE WHEN site THEN {{'k': 'has_website', 'l': '', 'e': 'w.com'}} END, CASE WHEN ig THEN {{'k': 'has_instagram', 'l': '', 'e': '@i'}} END, CASE WHEN tt THEN {{'k': 'has_tiktok', 'l': '', 'e': ''}} END, CASE WHEN yt THEN {{'k': 'has_youtube', 'l': '', 'e': ''}} END,
  CASE WHEN fb THEN {{'k': 'has_facebook', 'l': '', 'e': ''}} END, CASE WHEN li THEN {{'k': 'has_linkedin', 'l': '', 'e': ''}} END, CASE WHEN months <= 18 THEN {{'k': 'new_business', 'l': 'negócio aberto recentemente', 'e': 'abertura 03/1996'}} END,
  CASE WHEN units >= 2 THEN {{'k': 'multiple_locations', 'l': 'múltiplas unidades', 'e': units || ' endereços com o mesmo nome/domínio'}} END, CASE WHEN moving THEN {{'k': 'video_active', 'l': 'já publica vídeo', 'e': array_to_string(videos, ', ')}} END,
  CASE WHEN NOT moving AND presence THEN {{'k': 'low_video_presence', 'l': 'sem vídeo aparente', 'e': CASE WHEN site_status = 'ACTIVE' THEN 'homepage analisada sem vídeo; sem YouTube/TikTok' ELSE 'sem YouTube/TikTok nas fontes' END}} END,
  CASE WHEN words > 0 THEN {{'k': 'opportunity_keywords', 'l': 'menciona lançamento/evento/reservas', 'e': hits}} END], lambda v: v IS NOT NULL) AS sig,
  list_filter(list_transform(items, lambda t: {{'i': t.i, 'p': floor(t.v * list_filter(dims, lambda g: g.d = t.d)[1].w * 10 + 0.5e0) / 10}}), lambda t: t.p < 0) AS lost FROM said)
SELECT k AS c_custkey, lead_score, confidence, qualified,
  array_to_string(list_sort(list_filter([CASE WHEN ticket = 'HIGH' THEN 'high_ticket' END, CASE WHEN recurring THEN 'recurring_content' END, CASE WHEN visual >= 80 THEN 'high_visual_potential' END, CASE WHEN site THEN 'has_website' END, CASE WHEN ig THEN 'has_instagram' END, CASE WHEN tt THEN 'has_tiktok' END, CASE WHEN yt THEN 'has_youtube' END, CASE WHEN fb THEN 'has_facebook' END,
    CASE WHEN li THEN 'has_linkedin' END, CASE WHEN len(channels) >= 3 THEN 'strong_digital_presence' END, CASE WHEN months <= 18 THEN 'new_business' END, CASE WHEN units >= 2 THEN 'multiple_locations' END, CASE WHEN moving THEN 'video_active' END, CASE WHEN NOT moving AND presence THEN 'low_video_presence' END,
    CASE WHEN NOT moving AND presence AND visual >= 70 THEN 'needs_video' END, CASE WHEN NOT reachable THEN 'no_contact' END, CASE WHEN sources >= 2 THEN 'multi_source' END, CASE WHEN cnpj AND active THEN 'registry_confirmed' END, CASE WHEN qualified THEN 'qualified' END, 'segment:' || segment], lambda v: v IS NOT NULL)), '|') AS tags,
  array_to_string(list_transform(sig, lambda v: v.k || '=' || v.e), '|') AS signals,
  array_to_string(list_filter([CASE WHEN guessed THEN 'Segmento deduzido só pelo nome (nome) — confirme a atividade.' END, CASE WHEN segment IS NULL THEN 'Segmento não identificado nas fontes — avalie manualmente.' END, CASE WHEN site AND site_status <> 'ACTIVE' THEN 'Website não respondeu (' || site_status || ').' END,
    CASE WHEN ig THEN 'Atividade/frequência do Instagram não é medida (sem API permitida) — confira o perfil antes da abordagem.' END, CASE WHEN len(channels) = 0 THEN 'Nenhuma presença digital encontrada nas fontes — menor sinal de investimento em marketing.' END, CASE WHEN phone AND NOT phone_valid THEN 'Telefone em formato inválido: 3611' END,
    CASE WHEN NOT reachable THEN 'Nenhum canal de contato comercial público encontrado.' END, CASE WHEN domain_match = 'LOW' THEN 'Website w.com não parece ser desta empresa — confirme antes de usar.' END, CASE WHEN conflicts > 0 THEN 'Fontes divergem em: phone, street.' END, CASE WHEN verified IS NULL AND aged > 365 THEN 'Dado com mais de 1 ano (' || aged || ' dias) e nunca verificado.' END]
    || list_transform(lost, lambda t: CASE t.i WHEN 'size' THEN 'Porte ' || size WHEN 'site_status' THEN 'Site fora do ar' WHEN 'domain' THEN 'Domínio não corresponde ao nome' WHEN 'conflicts' THEN conflicts || ' conflito(s) entre fontes' ELSE 'Possível duplicata' END || ' (' || regexp_replace(CAST(t.p AS VARCHAR), '\\.0$', '') || ') — '
      || CASE t.i WHEN 'size' THEN 'ajuste de porte do ICP: -10' WHEN 'site_status' THEN 'análise do site: ' || site_status WHEN 'domain' THEN 'w.com' WHEN 'conflicts' THEN 'phone, street' ELSE 'A, B' END), lambda v: v IS NOT NULL), '|') AS alerts,
  CASE WHEN disqualified IS NOT NULL THEN 'Descartado na validação: motivo.' ELSE 'Apareceu por ser ' || CASE WHEN segment IS NULL THEN 'segmento não identificado' ELSE segment || CASE WHEN k % 8 = 3 THEN ' (sub)' ELSE '' END || CASE WHEN guessed THEN ' — segmento deduzido pelo nome' ELSE '' END END || ': rende vídeo.'
    || coalesce(' Sinais: ' || nullif(array_to_string(list_transform(list_filter(sig, lambda v: v.l <> '')[1:3], lambda v: v.l || ' (' || v.e || ')'), '; '), '') || '.', '')
    || CASE WHEN len(channels) > 0 THEN ' Presença digital: ' || array_to_string(channels, ', ') || CASE WHEN moving THEN '.' ELSE ', sem vídeo aparente.' END ELSE ' Sem presença digital encontrada.' END
    || coalesce(' Contato público: ' || nullif(array_to_string(list_filter([CASE WHEN phone THEN 'telefone' END, CASE WHEN whatsapp THEN 'WhatsApp' END, CASE WHEN email IS NOT NULL THEN 'e-mail' END, CASE WHEN ig THEN 'Instagram' END], lambda v: v IS NOT NULL), ', '), '') || '.', ' Nenhum contato comercial público encontrado.')
    || ' Confirmado por ' || len(labels) || ' fonte(s) (' || CASE WHEN len(labels) = 0 THEN '—' ELSE array_to_string(labels, ', ') END || '); confiança ' || CASE confidence WHEN 'VERY_LOW' THEN 'muito baixa' WHEN 'LOW' THEN 'baixa' WHEN 'MEDIUM' THEN 'média' WHEN 'HIGH' THEN 'alta' ELSE 'muito alta' END
    || '. Score ' || lead_score || '/100 = ' || array_to_string(list_transform(dims, lambda g: CASE g.d WHEN 'fit' THEN 'fit' WHEN 'visual_need' THEN 'necessidade visual' WHEN 'digital_presence' THEN 'presença digital' WHEN 'opportunity' THEN 'oportunidade' WHEN 'contactability' THEN 'contato' WHEN 'data_quality' THEN 'dados' ELSE 'recência' END
      || ' ' || regexp_replace(CAST(g.p AS VARCHAR), '\\.0$', '') || '/' || CAST(g.w AS INT)), ' + ') || '.' END AS why
FROM s""")
def lead_stories(t):
    """Score, confidence, tags, signals, alerts and the sentences of why every lead is shown."""
    out = narrative.told(leads(t))
    said = F.transform("signals", lambda x: F.concat_ws("=", x["key"], x["evidence"]))
    return out.select("c_custkey", "lead_score", "confidence", "qualified", F.array_join("tags", "|").alias("tags"), F.array_join(said, "|").alias("signals"), F.array_join("alerts", "|").alias("alerts"), "why")


@query(f"""WITH {LEADS_SQL}, r AS (SELECT lead.*, trim(n_name) AS hood, CASE confidence WHEN 'VERY_LOW' THEN 1 WHEN 'LOW' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'HIGH' THEN 4 ELSE 5 END AS level FROM lead JOIN customer ON c_custkey = k JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT 'all' AS kind, '' AS name, * FROM r WHERE disqualified IS NULL UNION ALL SELECT 'confidence', confidence, * FROM r WHERE disqualified IS NULL UNION ALL SELECT 'segment', coalesce(segment, 'Não identificado'), * FROM r WHERE disqualified IS NULL
  UNION ALL SELECT 'source', unnest(labels), * FROM r WHERE disqualified IS NULL UNION ALL SELECT 'neighborhood', hood, * FROM r WHERE disqualified IS NULL),
c AS (SELECT kind, name, count(*) AS n, count(*) FILTER (WHERE qualified) AS qualified, floor(avg(lead_score) * 10 + 0.5e0) / 10 AS mean_score, floor(avg(level) * 10 + 0.5e0) / 10 AS mean_confidence FROM g GROUP BY 1, 2),
e AS (SELECT 'confidence' AS kind, unnest(['VERY_LOW', 'LOW', 'MEDIUM', 'HIGH', 'VERY_HIGH']) AS name UNION ALL SELECT 'all', '')
SELECT kind, name, n, qualified, mean_score, mean_confidence FROM c WHERE kind <> 'neighborhood' UNION ALL SELECT * FROM (SELECT * FROM c WHERE kind = 'neighborhood' ORDER BY qualified DESC, n DESC, name LIMIT 10)
UNION ALL SELECT kind, name, 0, 0, 0, 0 FROM e ANTI JOIN c USING (kind, name) UNION ALL SELECT 'discarded', disqualified, count(*), NULL, NULL, NULL FROM r WHERE disqualified IS NOT NULL GROUP BY disqualified""")
def search_summary(t):
    """Figures of a search: all, by level of confidence, segment, source and rule of the discarded, and the best neighbourhoods."""
    own = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("neighborhood"))
    scored = qualify.qualified(leads(t)).join(own, "c_nationkey")
    return narrative.summary(scored.select("segment", "neighborhood", F.col("source_labels").alias("sources"), "lead_score", "confidence", "qualified", F.col("disqualified").alias("discarded")), neighborhoods=10)


@query(f"""WITH {RULES_SQL}, c AS (SELECT *, c_custkey % 5 = 0 AS again, 15 * no_website::INT + 10 * weak_social_presence::INT + 5 * business_contact_available::INT AS d, 10 * new_business::INT + 15 * high_offer_fit::INT AS t FROM e),
p AS (SELECT *, CASE WHEN again THEN 100 * recurring_content_need::INT ELSE floor(100.0 * (10 * visual_segment::INT + 10 * recurring_content_need::INT) / 20 + 0.5) END AS content FROM c)
SELECT c_custkey AS company_id, CAST(floor(floor(100.0 * d / 30 + 0.5) * 0.2 + content * 0.25 + floor(100.0 * t / 25 + 0.5) * 0.2 + 10 * multi_unit::INT + 10 * local_business::INT + 0.5 + 1e-9) AS BIGINT) AS score, again,
  CAST(d + (CASE WHEN again THEN 0 ELSE 10 END) * visual_segment::INT + 10 * recurring_content_need::INT + 5 * local_business::INT + 10 * multi_unit::INT + t + 10 * weak_marketing_signals::INT AS BIGINT) AS points FROM p""")
def stored_scores(t):
    """Scores and factors of all companies, then again of every fifth with a rule switched off, read back from the table: no factor of that rule is left on these."""
    rows = prospects(t).withColumn("company_id", F.col("c_custkey"))
    spark, path = rows.sparkSession, new_path(rows.sparkSession)
    fires = score.evaluators(now())
    fewer = tuple(score.Rule(r.key, r.category, r.points, r.key != "visual_segment") for r in score.RULES)
    kept = lambda df, rules, day: score.prospect_score(df, fires, rules).withColumns({"data_quality": F.lit(0), "computed_at": F.expr(f"timestamp_ntz'2026-03-0{day} 00:00:00'")})
    score_tables.keep_scores(spark, path, kept(rows, score.RULES, 1), 16)
    score_tables.keep_scores(spark, path, kept(rows.where("company_id % 5 = 0"), fewer, 2), 16)
    table = stored_tables.read(spark, path)
    points = score_tables.factors(table).groupBy("company_id").agg(F.sum("points").cast("long").alias("points"))
    again = table.select("company_id", "score", (F.col("computed_at") > F.expr("timestamp_ntz'2026-03-01 12:00:00'")).alias("again"))
    return again.join(points, "company_id", "left").select("company_id", "score", "again", F.coalesce("points", F.lit(0)).cast("long").alias("points"))


@query("""SELECT c_name AS nome, '' AS razao_social, '' AS cnpj, CASE WHEN c_custkey % 3 = 0 THEN 'ATIVA' ELSE '' END AS situacao_cadastral, c_mktsegment AS categoria, 'Rua' AS logradouro, CAST(c_custkey AS VARCHAR) AS numero, '' AS bairro, trim(n_name) AS cidade, 'CE' AS uf, '' AS cep,
  CASE WHEN c_custkey % 2 = 0 THEN '88' || c_custkey ELSE '' END AS telefone, CASE WHEN c_custkey % 2 = 0 THEN '3611' ELSE '88' || c_custkey || ' | 3611' END AS outros_telefones, '' AS whatsapp, '' AS email, '' AS website, CASE WHEN c_custkey % 4 = 0 THEN '@i' ELSE '' END AS instagram, '' AS facebook, '' AS tiktok, '' AS linkedin,
  CAST(c_custkey % 90 AS VARCHAR) AS latitude, CASE WHEN c_custkey % 2 = 0 THEN '-40.5' ELSE '' END AS longitude, array_to_string(['Base', 'Mapa'][1:c_custkey % 3], ' + ') AS fontes, 'HIGH' AS confianca, CAST(c_custkey % 101 AS VARCHAR) AS completude, 'PARCIAL' AS qualidade,
  CASE WHEN c_custkey % 6 = 0 THEN 'phone, street' ELSE '' END AS conflitos, CASE WHEN c_custkey % 7 = 0 THEN 'sim' ELSE 'não' END AS ja_no_banco,
  'https://www.google.com/maps/search/?api=1&query=' || replace(replace(replace(c_name || ', Rua ' || c_custkey || ', ' || trim(n_name) || ' - CE', '#', '%23'), ',', '%2C'), ' ', '%20') AS google_maps FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def discovery_export(t):
    """The rows of a search's export file."""
    k, empty = F.col("c_custkey"), F.lit(None).cast("string")
    phone = F.concat(F.lit("88"), k.cast("string"))
    own = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.trim("n_name").alias("city"))
    given = {
        "name": F.col("c_name"), "cnpj_status": F.when(k % 3 == 0, "ATIVA"), "category": F.col("c_mktsegment"), "street": F.lit("Rua"), "house_number": k.cast("string"), "city": F.col("city"), "state": F.lit("CE"), "phone": F.when(k % 2 == 0, phone), "phones": F.array(phone, F.lit("3611")),
        "profiles": F.when(k % 4 == 0, F.create_map(F.lit("instagram"), F.lit("@i"))).otherwise(F.create_map().cast("map<string,string>")), "lat": (k % 90).cast("double"), "lon": F.when(k % 2 == 0, -40.5), "source_labels": F.slice(F.array(F.lit("Base"), F.lit("Mapa")), F.lit(1), (k % 3).cast("int")),
        "confidence": F.lit("HIGH"), "completeness": k % 101, "quality_label": F.lit("PARCIAL"), "conflict_fields": F.when(k % 6 == 0, F.array(F.lit("phone"), F.lit("street"))), "company_id": F.when(k % 7 == 0, k),
    }
    rows = t("customer").join(own, "c_nationkey").select(*[v.alias(n) for n, v in given.items()], *[empty.alias(n) for n in ("legal_name", "cnpj", "neighborhood", "postcode", "whatsapp", "email", "website")])
    return files.discovery_rows(rows)
