"""More queries in the roles of `catalogue`: search results, merged businesses, imports, the ledger of contacts, niches, links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, ids, links, text
from ..functions.ids import phone_key
from ..operators import business, imports, ledger, niches, score, search, tables
from .catalogue import AS_OF, companies, n, query

NOW_SQL = f"TIMESTAMP '{AS_OF}'"
TEXT = "array<string>"


def now():
    return F.expr(f"timestamp_ntz'{AS_OF}'")


def none(kind: str = "string"):
    return F.lit(None).cast(kind)


def pick(c, *values):
    """The value at c modulo their number."""
    out = F.lit(values[-1]) if values[-1] is not None else none()
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(c % len(values) == i, F.lit(v) if v is not None else none()).otherwise(out)
    return out


def pick_sql(c: str, *values) -> str:
    q = lambda v: "NULL" if v is None else f"'{v}'"
    return f"CASE {c} % {len(values)} " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values)) + " END"


# A search's results: a business for each customer.
RESULTS_SQL = f"""results AS (SELECT c_custkey AS key, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN lower(n_name) || ' - centro' ELSE n_name END AS city, {pick_sql('c_custkey', 'ATIVA', 'BAIXADA', None, 'SUSPENSA', 'INAPTA', None, 'ATIVA')} AS cnpj_status,
  {pick_sql('c_custkey', 'HIGH', 'MEDIUM', 'LOW')} AS confidence, 'Bairro ' || (c_custkey % 11) AS neighborhood, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal / 10000.0 END AS lat, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 100) / 100.0 END AS lon,
  {pick_sql('c_custkey', 'places_overture', 'local_db')} AS source, {pick_sql('c_custkey', 'Padaria Sol', 'Restaurante', 'Oficina Lua')} AS name, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'Rua' END AS street, CASE WHEN c_custkey % 6 = 0 THEN '8836110000' END AS phone,
  {pick_sql('c_custkey', 'open', None, 'closed')} AS operating_status, CAST(c_custkey % 37 AS INT) AS lead_score, CAST(c_custkey % 11 AS INT) AS rank_score, CAST(c_custkey % 101 AS INT) AS completeness, c_custkey % 3 = 0 AS in_pipeline, CASE WHEN c_custkey % 8 = 0 THEN 'x.com' END AS website
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def results(t) -> DataFrame:
    k = F.col("c_custkey")
    c = companies(t)
    return c.select(
        k.alias("key"), F.when(k % 5 == 1, F.concat(F.lower("n_name"), F.lit(" - centro"))).when(k % 5 != 0, F.col("n_name")).alias("city"), pick(k, "ATIVA", "BAIXADA", None, "SUSPENSA", "INAPTA", None, "ATIVA").alias("cnpj_status"),
        pick(k, "HIGH", "MEDIUM", "LOW").alias("confidence"), F.concat(F.lit("Bairro "), (k % 11).cast("string")).alias("neighborhood"), F.when(k % 4 != 0, F.col("c_acctbal") / 10000.0).alias("lat"), F.when(k % 4 != 0, (k % 100) / 100.0).alias("lon"),
        pick(k, "places_overture", "local_db").alias("source"), pick(k, "Padaria Sol", "Restaurante", "Oficina Lua").alias("name"), F.when(k % 13 != 0, F.lit("Rua")).alias("street"), F.when(k % 6 == 0, "8836110000").alias("phone"), none().alias("whatsapp"), none().alias("email"),
        F.array().cast(TEXT).alias("socials"), pick(k, "open", None, "closed").alias("operating_status"), (k % 37).cast("int").alias("lead_score"), (k % 11).cast("int").alias("rank_score"), (k % 101).cast("int").alias("completeness"), (k % 3 == 0).alias("in_pipeline"), F.when(k % 8 == 0, "x.com").alias("website"),
        none().alias("legal_name"), none().alias("category"), pick(k, "NEEDS_REVIEW", "PARTIAL").alias("quality_label"), F.array().cast(TEXT).alias("contacts"),
    )


AREAS_SQL = "areas AS (SELECT n_name AS area, n_nationkey / 50.0 AS south, n_nationkey / 50.0 + 0.01 AS north, 0.1 AS west, 0.9 AS east FROM nation WHERE n_nationkey % 2 = 0)"


def areas(t) -> DataFrame:
    k = F.col("n_nationkey")
    return t("nation").where(k % 2 == 0).select(F.col("n_name").alias("area"), (k / 50.0).alias("south"), (k / 50.0 + 0.01).alias("north"), F.lit(0.1).alias("west"), F.lit(0.9).alias("east"))


INSIDE_SQL = "lat BETWEEN south - 0.003 AND north + 0.003 AND lon BETWEEN west - 0.003 AND east + 0.003"
HOOD_SQL = "(contains('bairro 1', lower(neighborhood)) OR contains(lower(neighborhood), 'bairro 1'))"
OUTCOME_SQL = f"""CASE WHEN city IS NOT NULL AND NOT (contains(lower(regexp_replace(city, '[^A-Za-z0-9]+', ' ', 'g')), 'nation 1')) THEN 'city'
  WHEN city IS NULL AND lat IS NOT NULL AND lon IS NOT NULL AND source <> 'local_db' AND NOT (lat BETWEEN -0.01 AND 0.51 AND lon BETWEEN -0.01 AND 0.61) THEN 'outside_area'
  WHEN cnpj_status IS NOT NULL AND cnpj_status NOT IN ('ATIVA', 'SUSPENSA') THEN 'cnpj_status' WHEN confidence = 'LOW' THEN 'low_confidence'
  WHEN NOT ({HOOD_SQL} OR EXISTS (SELECT 1 FROM areas WHERE {INSIDE_SQL})) THEN 'neighborhood'
  WHEN operating_status = 'closed' OR cnpj_status IN ('BAIXADA', 'INAPTA', 'NULA') THEN 'closed' WHEN name = 'Restaurante' THEN 'generic_name' WHEN phone IS NULL AND website IS NULL AND street IS NULL THEN 'insufficient_data' ELSE 'kept' END"""


def filtered(t) -> DataFrame:
    """results with the first filter that removes each, or kept."""
    rows = search.in_neighborhoods(results(t), "key", ["Bairro 1"], areas(t))
    invalid = search.validation_failure()
    filters = {
        "city": search.other_city(F.col("city"), "Nation 1"), "outside_area": search.outside_area(F.col("city"), F.col("lat"), F.col("lon"), F.array("source"), (0.0, 0.0, 0.5, 0.6)), "cnpj_status": search.other_status(F.col("cnpj_status"), search.PRECISE_STATUSES),
        "low_confidence": F.col("confidence") == "LOW", "neighborhood": ~F.col("in_neighborhood"), **{r: F.coalesce(invalid == r, F.lit(False)) for r in ("closed", "generic_name", "insufficient_data")},
    }
    return rows.withColumn("outcome", F.coalesce(tables.removed_by(filters), F.lit("kept")))


@query(f"WITH {RESULTS_SQL}, {AREAS_SQL} SELECT {OUTCOME_SQL} AS outcome, count(*) AS n FROM results GROUP BY 1")
def search_filters(t):
    """City, area, status, confidence, neighbourhood and validation, in order: each row is counted where it goes first."""
    return filtered(t).groupBy("outcome").agg(n())


@query(f"WITH {RESULTS_SQL}, {AREAS_SQL} SELECT key, area FROM results JOIN areas ON {INSIDE_SQL}")
def points_in_areas(t):
    """Points in boxes of a table of areas, as an equi-join on grid cells."""
    return geo.in_areas(results(t), areas(t), "key", "area")


@query(f"""WITH {RESULTS_SQL}, {AREAS_SQL}, marked AS (SELECT key, {OUTCOME_SQL} AS outcome, lead_score FROM results),
r AS (SELECT o_custkey AS key, o_orderpriority AS source, o_orderstatus <> 'P' AS valid, o_orderkey AS place FROM orders), f AS (SELECT key, min(place) AS first FROM r WHERE valid GROUP BY key)
SELECT source, count(*) AS returned, count(*) FILTER (WHERE NOT valid) AS invalid, count(*) FILTER (WHERE valid) AS valid, count(*) FILTER (WHERE valid AND place <> first) AS duplicate,
  count(*) FILTER (WHERE valid AND outcome <> 'kept') AS filtered, count(DISTINCT r.key) FILTER (WHERE valid AND outcome = 'kept') AS accepted, count(DISTINCT r.key) FILTER (WHERE valid AND outcome = 'kept' AND lead_score > 10) AS qualified
FROM r LEFT JOIN f ON r.key = f.key LEFT JOIN marked ON r.key = marked.key GROUP BY source""")
def source_funnel(t):
    rows = t("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("source"), (F.col("o_orderstatus") != "P").alias("valid"), F.col("o_orderkey").alias("place"))
    marked = filtered(t)
    return search.source_funnel(rows, marked.where("outcome <> 'kept'"), marked.where("lead_score > 10"))


@query(f"WITH {RESULTS_SQL}, top AS (SELECT key FROM results ORDER BY lead_score DESC, rank_score DESC, completeness DESC, key LIMIT 40) SELECT enrichment, count(*) AS n, sum(lead_score) AS total FROM (SELECT *, CASE WHEN key IN (SELECT key FROM top) THEN 'PENDING' ELSE 'SKIPPED' END AS enrichment FROM results) GROUP BY 1")
def enrichment_budget(t):
    return search.with_budget(results(t), search.result_order("relevance"), 40).groupBy("enrichment").agg(n(), F.sum("lead_score").alias("total"))


@query(f"WITH {RESULTS_SQL} SELECT key, name, completeness, rank_score FROM results ORDER BY completeness DESC, rank_score DESC, key LIMIT 30")
def results_by_completeness(t):
    return results(t).orderBy(*search.result_order("completeness")).limit(30).select("key", "name", "completeness", "rank_score")


@query(f"WITH {RESULTS_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS view, count(*) AS n FROM results WHERE {w}" for k, w in {"new": "NOT in_pipeline", "existing": "in_pipeline", "review": "key % 2 = 0", "no_phone": "phone IS NULL", "no_website": "website IS NULL", "with_owner": "FALSE", "text": "key % 3 = 0"}.items()))
def result_views(t):
    r = results(t).select("key", "in_pipeline", "quality_label", "phone", "whatsapp", "website", "contacts", "name", "legal_name", "street", "neighborhood", "category")
    kinds = ["new", "existing", "review", "no_phone", "no_website", "with_owner"]
    counts = [search.view(r, k).agg(n()).select(F.lit(k).alias("view"), "n") for k in kinds] + [search.view(r, "", "padária").agg(n()).select(F.lit("text").alias("view"), "n")]
    return reduce(DataFrame.unionByName, counts)


@query("SELECT CASE WHEN s = 0 THEN 'SOURCE_TIMEOUT' WHEN s = 1 THEN 'SOURCE_PARTIAL_RESULTS' ELSE 'SOURCE_SUCCESS' END AS status, count(*) AS runs, (SELECT count(*) FROM customer) AS results, 'PARTIAL' AS outcome FROM (SELECT s_suppkey % 7 AS s FROM supplier) GROUP BY 1")
def search_outcome(t):
    """Source runs, each with its own status: a failed one is a row, not the end of the search."""
    s = F.col("s_suppkey") % 7
    runs = t("supplier").select(F.when(s == 0, "SOURCE_TIMEOUT").when(s == 1, "SOURCE_PARTIAL_RESULTS").otherwise("SOURCE_SUCCESS").alias("status"), F.lit(1).alias("k"))
    found = t("customer").agg(n("results"))
    end = search.outcome(runs, F.lit(1)).select("outcome")
    return runs.groupBy("status").agg(n("runs")).join(found.join(end.withColumn("k", F.lit(1)), F.lit(True)).drop("k"), F.lit(True))


LOCAL_SQL = "(SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'sao joao' WHEN c_custkey % 3 = 1 THEN 'São João' ELSE 'Sobral' END AS city, CASE WHEN c_custkey % 2 = 0 THEN 'CE' ELSE 'PI' END AS state FROM customer)"


@query(f"SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 OR c_acctbal > 9000 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, c_custkey % 9 = 0 AS official FROM {LOCAL_SQL} WHERE city <> 'Sobral' AND state = 'CE' AND (c_mktsegment = 'BUILDING' OR c_nationkey = 3 OR contains(lower(c_name), '077'))")
def local_base_scan(t):
    """The own base by city (with accents or without), state and niche, as source records."""
    k = F.col("c_custkey")
    base = t("customer").select(
        k.alias("id"), F.col("c_name").alias("trade_name"), none().alias("legal_name"), pick(k, "sao joao", "São João", "Sobral").alias("city"), pick(k, "CE", "PI").alias("state"), F.col("c_mktsegment").alias("industry_id"), F.col("c_nationkey").cast("string").alias("activity"),
        F.array().cast(TEXT).alias("secondary_activities"), F.when(F.col("c_acctbal") > 9000, "1").alias("cnpj"),
    )
    own = search.local_scan(base, "São João", "CE", search.niche_match("BUILDING", ["3"], ["x", "077 "]))
    origins = t("customer").where("c_custkey % 9 = 0").select(k.alias("id"), F.lit("OFFICIAL").alias("kind"), k.cast("string").alias("record_id"))
    socials = t("customer").select(k.alias("id"), F.lit("instagram").alias("network"), F.lit("u").alias("url"), (k % 2 == 0).alias("found"))
    contacts = t("customer").select(k.alias("id"), F.lit("OWNER").alias("role"))
    return search.local_records(own, origins, socials, contacts).select("id", "confidence", F.array_contains("origins", "OFFICIAL").alias("official"))


# Businesses that are a customer and, where there is one, a supplier of the same key.
def sources(t) -> DataFrame:
    def side(df, key, name, src, off):
        k = F.col(key)
        return df.select(
            (k * 2 + off).alias("idx"), k.alias("k"), F.lit(src).alias("source"), k.cast("string").alias("source_record_id"), F.when((k % 3 == 0) & F.lit(off == 0), k.cast("string")).alias("company_id"), F.lit("MEDIUM").alias("confidence"),
            F.when(k % 4 == 0, "text_search").otherwise("tag").alias("matched_by"), F.when(F.lit(off == 0), pick(k, None, "ATIVA", "BAIXADA")).alias("cnpj_status"), (k % 10 == off).alias("has_decision_maker"), F.lit(False).alias("in_pipeline"),
            F.col(name).alias("name"), F.concat(F.lit("88"), F.lpad((k * (1 + 2 * off)).cast("string"), 9, "9")).alias("phone"), F.when(k % 5 == 0, "Rua A").alias("street"), F.when(k % 7 == 0, F.concat(F.lit("a@b"), k.cast("string"), F.lit(".com"))).alias("email"),
            F.when(F.lit(off == 1), "open").otherwise(pick(k, None, "closed")).alias("operating_status"), F.when(F.lit(off == 1), "5611").alias("activity"), none("date").alias("opened_at"), none().alias("company_size"), none().alias("description"), none().alias("opening_hours"),
            F.when(k % 2 == 0, "2026-01-02 00:00:00").otherwise("not a time").alias("first_seen_at"), F.when(F.lit(off == 0), "2026-02-01 00:00:00").otherwise("2026-03-01 00:00:00").alias("collected_at"), none().alias("verified_at"), none().alias("data_as_of"),
        )

    return side(t("customer"), "c_custkey", "c_name", "local_db", 0).unionByName(side(t("supplier"), "s_suppkey", "s_name", "places_overture", 1))


@query("""WITH b AS (SELECT c_custkey AS k, s_suppkey IS NOT NULL AS two FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey), x AS (SELECT *, k % 3 = 0 AS known, two AND k > 0 AS conflict, two AS dm2,
  10 + CASE WHEN k % 5 = 0 THEN 15 ELSE 0 END + 15 + CASE WHEN k % 7 = 0 THEN 10 ELSE 0 END + CASE WHEN k % 10 = 0 OR (two AND k % 10 = 1) THEN 10 ELSE 0 END AS complete FROM b)
SELECT CASE WHEN known THEN 'db:' || k ELSE 'u:local_db:' || k END AS key, CASE WHEN known THEN 'EXISTING' ELSE 'NEW' END AS status, CASE WHEN two THEN 'HIGH' WHEN k % 4 = 0 THEN 'LOW' ELSE 'MEDIUM' END AS confidence,
  CAST(complete AS INT) AS completeness, CASE WHEN complete >= 75 THEN 'COMPLETO' WHEN complete >= 45 THEN 'PARCIAL' ELSE 'FRACO' END AS completeness_label, CASE WHEN conflict OR k % 3 = 2 THEN 'NEEDS_REVIEW' ELSE 'PARTIAL' END AS quality_label FROM x""")
def merged_records(t):
    """Key, status, confidence, completeness and quality label of businesses made of one or two source records."""
    from ..operators import resolve

    rows = sources(t)
    members = rows.select("idx", F.col("k").alias("cluster"))
    order = ["places_overture", "local_db"]
    fused = resolve.fuse(rows.select("idx", "source", "confidence", "name", "phone", "street", "email"), members, {"name": order, "phone": order, "street": order, "email": order})
    no_links = members.select(F.col("cluster"), F.col("cluster").alias("other"), F.lit("LOW").alias("level")).limit(0)
    return business.merged_records(rows, members, fused, no_links).select("key", "status", "confidence", "completeness", "completeness_label", "quality_label")


@query("""SELECT c_custkey AS cluster, CASE WHEN s_suppkey IS NOT NULL THEN '5611' END AS activity, CASE WHEN c_custkey % 2 = 1 THEN 'closed' WHEN s_suppkey IS NOT NULL THEN 'open' END AS operating_status,
  TIMESTAMP '2026-02-01 00:00:00' AS first_seen_at, CASE WHEN s_suppkey IS NOT NULL THEN TIMESTAMP '2026-03-01 00:00:00' ELSE TIMESTAMP '2026-02-01 00:00:00' END AS last_seen_at, s_suppkey IS NOT NULL AND c_custkey > 0 AS two_phones FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def qualification_inputs(t):
    """First values in source order, any closed before silence, earliest and latest valid moments, distinct phones."""
    rows = sources(t).withColumn("cluster", F.col("k")).withColumn("first_seen_at", F.lit("not a time")).withColumn("phones", F.array("phone"))
    got = business.qualification_inputs(rows)
    chosen = rows.groupBy("cluster").agg(F.max("phone").alias("phone"))
    phones = business.kept_phones(rows, chosen).select("cluster", (F.size("phones") > 1).alias("two_phones"))
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return got.join(phones, "cluster").select("cluster", "activity", "operating_status", ntz("first_seen_at"), ntz("last_seen_at"), "two_phones")


@query("""WITH p AS (SELECT l_partkey % 50 AS ca, l_suppkey % 60 AS cb, CASE WHEN l_returnflag = 'A' THEN 'MEDIUM' ELSE 'LOW' END AS level FROM lineitem), d AS (SELECT least(ca, cb) AS x, greatest(ca, cb) AS y, max(level) AS level FROM p WHERE ca <> cb GROUP BY 1, 2)
SELECT x AS cluster, y AS other, level FROM d UNION ALL SELECT y, x, level FROM d""")
def duplicate_links(t):
    """Links between businesses to review, in both directions, the strongest evidence first."""
    pairs = t("lineitem").select((F.col("l_partkey") % 50).alias("a"), (F.col("l_suppkey") % 60 + 1000).alias("b"), F.when(F.col("l_returnflag") == "A", "MEDIUM").otherwise("LOW").alias("level"))
    k = lambda off, count: t("part").select((F.col("p_partkey") % count + off).alias("idx"), (F.col("p_partkey") % count).alias("cluster")).distinct()
    return business.duplicate_links(pairs, k(0, 50).union(k(1000, 60)))


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 3 <> 0 THEN c_name WHEN s_suppkey IS NOT NULL THEN 'new ' || c_custkey END AS name, CASE WHEN s_suppkey IS NOT NULL THEN 's' || c_custkey || '.com' ELSE 'c' || c_custkey || '.com' END AS website, (s_suppkey IS NOT NULL)::BIGINT AS n_conflicts FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def enrichment_applied(t):
    """Patches fill empty fields; of two values the source that ranks higher wins, and the loser is kept as a conflict."""
    k = F.col("c_custkey")
    own = t("customer").select(k.alias("key"), F.lit("local_db").alias("source"), F.lit(2).alias("conf"), F.when(k % 3 != 0, F.col("c_name")).alias("name"), F.concat(F.lit("c"), k.cast("string"), F.lit(".com")).alias("website"))
    s = F.col("s_suppkey")
    patch = t("supplier").select(s.alias("key"), F.lit("website_discovery").alias("source"), F.lit(2).alias("conf"), F.concat(F.lit("new "), s.cast("string")).alias("name"), F.concat(F.lit("s"), s.cast("string"), F.lit(".com")).alias("website"))
    out = business.apply_enrichment(own, patch, ["name", "website"], {"website": ["website_discovery", "local_db"], "name": ["local_db", "website_discovery"]})
    return out.select("key", "name", "website", F.size("conflicts").cast("long").alias("n_conflicts"))


@query("SELECT count(*) FILTER (WHERE c_custkey % 4 = 0) AS processed, count(*) FILTER (WHERE c_custkey % 4 = 0 AND c_custkey % 8 = 0) AS with_website, 0::BIGINT AS with_email, count(*) FILTER (WHERE c_custkey % 4 <> 0) AS remaining FROM customer")
def enrichment_stats(t):
    k = F.col("c_custkey")
    return business.enrichment_stats(t("customer").select(F.when(k % 4 == 0, F.array(F.lit("done"))).alias("tags"), F.when(k % 8 == 0, "w").alias("website"), none().alias("email")), "done")


@query("SELECT c_custkey AS key, CAST(c_acctbal AS DOUBLE) AS rank_score FROM customer WHERE c_custkey % 4 <> 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def enrichment_batch(t):
    k = F.col("c_custkey")
    rows = t("customer").select(k.alias("key"), F.col("c_acctbal").alias("rank_score"), F.when(k % 4 == 0, F.array(F.lit("done"))).alias("tags"))
    return business.enrichment_batch(rows, "done").select("key", "rank_score")


@query("SELECT event_type AS source, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def enriched_by_source(t):
    return business.enriched_by_source(t("events").groupBy("user_id").agg(F.collect_set("event_type").alias("enriched_by")))


FORMS = ["tax", "domain", "phone", "email", "name", "city"]


@query("""WITH i AS (SELECT o_orderkey AS id, 'd' || o_custkey AS domain, o_custkey FROM orders), e AS (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)
SELECT id, c_custkey IS NULL AND row_number() OVER (PARTITION BY o_custkey ORDER BY id) = 1 AS accepted, CASE WHEN c_custkey IS NOT NULL THEN 'EXACT_MATCH' ELSE 'NO_MATCH' END AS level FROM i LEFT JOIN e ON o_custkey = c_custkey""")
def import_pool(t):
    """Rows of a file join the pool as they are accepted: of several alike the first comes in."""
    rest = lambda: [none().alias(c) for c in ("tax", "phone", "email")] + [F.lit("").alias(c) for c in ("name", "city")]
    side = lambda df, key, dom: df.select(F.col(key).alias("id"), F.concat(F.lit("d"), F.col(dom).cast("string")).alias("domain"), *rest()).select("id", *FORMS)
    return imports.import_pool(side(t("orders"), "o_orderkey", "o_custkey"), side(t("customer").where("c_custkey % 4 = 0"), "c_custkey", "c_custkey"))


@query("""SELECT CASE WHEN c_custkey IS NULL THEN 'CREATED' WHEN s_suppkey % 5 = 1 THEN 'EXISTING' WHEN s_suppkey % 5 = 0 OR s_suppkey % 3 = 0 THEN 'COMPLEMENTED' ELSE 'CREATED_TAGGED' END AS outcome, count(*) AS n FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey GROUP BY 1""")
def discovery_import(t):
    """A discovery's results going into the base: complemented, created, or created with a tag."""
    def side(df, key, off):
        k = F.col(key)
        return df.select((k + off).alias("id"), F.when(k % 5 == 0, k.cast("string")).alias("tax"), none().alias("domain"), F.concat(F.lit("88"), k.cast("string")).alias("phone"), F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit("@x.com"))).alias("email"), F.lit("").alias("name"), F.lit("").alias("city"), none().alias("website"), F.array().cast(TEXT).alias("tags"), k.alias("_k"))

    base = side(t("customer"), "c_custkey", 0).drop("_k")
    found = side(t("supplier"), "s_suppkey", 10_000_000)
    known = t("customer").select(F.col("c_custkey").alias("_k"), F.col("c_custkey").alias("_c"))
    found = found.join(known, "_k", "left").withColumn("company_id", F.when(F.col("_k") % 5 == 1, F.col("_c"))).drop("_k", "_c")
    return imports.discovery_import(found, base, ["website", "email"])[1].groupBy("outcome").agg(n())


@query("SELECT c_custkey AS id, coalesce(s_suppkey IS NOT NULL AND c_custkey % 2 = 0, FALSE) AS refused FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def company_creation(t):
    """A new business is refused where an existing one surely matches."""
    rest = lambda: [none().alias(c) for c in ("domain", "phone", "email")] + [F.lit("").alias(c) for c in ("name", "city")]
    new = t("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).alias("tax"), *rest())
    old = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").cast("string").alias("tax"), *rest())
    return imports.create_company(new, old).select("id", "refused")


@query("SELECT p_partkey FROM part WHERE p_size % 4 = 1 OR p_size % 4 = 3")
def map_reconcile(t):
    s = F.col("p_size") % 4
    rows = t("part").select("p_partkey", F.when(s == 1, F.array(F.lit("local_db"), F.lit("osm_overpass"))).when(s == 3, F.array(F.lit("osm_photon"))).when(s == 2, F.array(F.lit("local_db"))).alias("sources"))
    return imports.reconcile(rows).select("p_partkey")


@query("SELECT source, count(*) AS n, sum(v) AS total FROM (SELECT 'local_db' AS source, c_custkey AS v FROM customer UNION ALL SELECT 'places_overture', s_suppkey + 1 FROM supplier) GROUP BY 1")
def baseline_refresh(t):
    """One source's records replaced in a stored snapshot."""
    row = lambda df, key, source, off: df.select(F.lit(source).alias("source"), (F.col(key) + off).alias("v"))
    old = row(t("customer"), "c_custkey", "local_db", 0).union(row(t("part"), "p_partkey", "places_overture", 0))
    return imports.onto_baseline(old, row(t("supplier"), "s_suppkey", "places_overture", 1), "places_overture").groupBy("source").agg(n(), F.sum("v").alias("total"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def children_of_written_parents(t):
    done = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return imports.children_of(done, t("lineitem"), "l_orderkey").groupBy("l_orderkey").agg(n())


RESPONSE_SQL = f"""o AS (SELECT o_orderkey AS outreach_id, o_custkey AS company_id, o_orderdate AS moment, {pick_sql('o_orderkey', 'INTERESTED', 'OPT_OUT', 'NO_INTEREST', 'MEETING_REQUESTED', None, 'ASKED_PRICE')} AS r FROM orders)"""


@query(f"""WITH {RESPONSE_SQL}, m AS (SELECT company_id, arg_max(CASE WHEN r = 'MEETING_REQUESTED' THEN 'MEETING' ELSE 'REPLIED' END, (moment, outreach_id)) AS stage FROM o WHERE r IN ('INTERESTED', 'MEETING_REQUESTED', 'ASKED_PRICE') GROUP BY 1)
SELECT coalesce(m.stage, 'CONTACTED') AS stage, count(*) AS companies, count(*) FILTER (WHERE c_custkey IN (SELECT company_id FROM o WHERE r = 'OPT_OUT')) AS suppressed FROM customer LEFT JOIN m ON c_custkey = company_id GROUP BY 1""")
def responses_recorded(t):
    """Responses set the stage of a company by its last telling one; an opt-out suppresses it."""
    k = F.col("o_orderkey")
    outreach = t("orders").select(k.alias("outreach_id"), F.col("o_custkey").alias("company_id"))
    answers = t("orders").select(k.alias("outreach_id"), pick(k, "INTERESTED", "OPT_OUT", "NO_INTEREST", "MEETING_REQUESTED", None, "ASKED_PRICE").alias("response_type"), F.col("o_orderdate").alias("responded_at")).where("response_type is not null")
    _, moved, stopped = ledger.record_responses(outreach, answers, t("customer").select(F.col("c_custkey").alias("company_id"), F.lit("CONTACTED").alias("stage")))
    both = moved.join(stopped.select("company_id", F.lit(True).alias("s")), "company_id", "left")
    return both.groupBy("stage").agg(n("companies"), F.count_if(F.coalesce("s", F.lit(False))).alias("suppressed"))


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'DONE' WHEN o_orderkey % 3 = 1 THEN 'OPT_OUT' ELSE 'PENDING' END AS status, count(*) AS n, count(DISTINCT o_custkey) AS companies FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def followups_completed(t):
    k = F.col("o_orderkey")
    due = t("orders").where("o_orderstatus = 'O'").select(k.alias("followup_id"), F.col("o_custkey").alias("company_id"), F.lit("PENDING").alias("status"), none("timestamp_ntz").alias("completed_at"))
    done = t("orders").where("o_orderkey % 3 < 2").select(k.alias("followup_id"), pick(k, "DONE", "OPT_OUT", None).alias("status"), F.col("o_orderdate").alias("completed_at"))
    out, _ = ledger.complete_followups(due, done)
    return out.groupBy("status").agg(n(), F.countDistinct("company_id").alias("companies"))


@query("SELECT reason, count(*) AS n FROM (SELECT c_custkey, 'old' AS reason FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT o_custkey, min('bulk ' || o_orderstatus) FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1) GROUP BY 1")
def suppression_append(t):
    old = t("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("company_id"), F.lit("all").alias("channel"), F.lit("old").alias("reason"))
    new = t("orders").select(F.col("o_custkey").alias("company_id"), F.lit("all").alias("channel"), F.concat(F.lit("bulk "), "o_orderstatus").alias("reason"))
    return ledger.append_suppression(old, new).groupBy("reason").agg(n())


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '1990-01-01 00:00:00' WHEN c_custkey IN (SELECT s_suppkey FROM supplier) THEN {NOW_SQL} END AS deleted_at FROM customer")
def soft_deleted(t):
    rows = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.expr("timestamp_ntz'1990-01-01 00:00:00'")).alias("deleted_at"))
    return ledger.soft_delete(rows, t("supplier").select(F.col("s_suppkey").alias("c_custkey")), "c_custkey", "deleted_at", now())


@query(f"SELECT 'user' AS actor, 'IMPORT' AS action, 'company' AS entity, CAST(s_suppkey AS VARCHAR) AS entity_id, '{{\"s_suppkey\":' || s_suppkey || ',\"s_name\":\"' || s_name || '\"}}' AS metadata, {NOW_SQL} AS created_at FROM supplier")
def audit_rows(t):
    return ledger.audit(t("supplier"), "user", "IMPORT", "company", "s_suppkey", ["s_suppkey", "s_name"], now())


@query("""WITH r AS (SELECT p_partkey AS id, p_type AS activity, p_brand AS cat, p_name FROM part),
c AS (SELECT 'activity' AS kind, 'ECONOMY' AS code, 'a' AS segment, 1 AS level UNION ALL SELECT 'activity', 'PROMO', 'b', 2 UNION ALL SELECT 'category', 'Brand#5', 'c', 2 UNION ALL SELECT 'category', 'Brand#13', 'a', 0),
e AS (SELECT id, segment, 30 + 3 * level AS p, 0 AS place FROM r JOIN c ON kind = 'activity' AND code = activity UNION ALL SELECT id, segment, 20 + 3 * level, 1 FROM r JOIN c ON kind = 'category' AND code = cat
 UNION ALL SELECT id, CASE WHEN contains(' ' || p_name || ' ', ' widget ') THEN 'b' ELSE 'd' END, 10, 2 FROM r WHERE contains(' ' || p_name || ' ', ' widget ') OR contains(' ' || p_name || ' ', ' bolt ')), s AS (SELECT id, segment, p + CASE WHEN segment = 'c' THEN 5 ELSE 0 END AS p, place FROM e)
SELECT id, segment, CAST(p AS BIGINT) AS points FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, place) AS k FROM (SELECT id, segment, max(p) AS p, min(place) AS place FROM s GROUP BY 1, 2)) WHERE k = 1""")
def taxonomy_match(t):
    """Activity codes, categories and names against the niche catalogue; the best evidence decides."""
    spark = t("part").sparkSession
    codes = spark.createDataFrame([("activity", "ECONOMY", "a", 1), ("activity", "PROMO", "b", 2), ("category", "Brand#5", "c", 2), ("category", "Brand#13", "a", 0)], "kind string, code string, segment string, level int")
    names = spark.createDataFrame([("bolt", "d"), ("widget", "b")], "fragment string, segment string")
    rows = t("part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("activity"), F.array("p_brand").alias("category_keys"), F.col("p_name").alias("name"))
    return niches.match_segments(rows, codes, names, "c").select("id", "segment", "points")


@query("""WITH g AS (SELECT o_custkey AS key, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS p, list(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS s FROM orders GROUP BY 1)
SELECT key, list_concat(p, s[1:2]) AS terms, s[3:] AS terms_left, p AS codes, s AS codes_left FROM g""")
def niche_expansion(t):
    """What a balanced search of a niche asks for, and what is left to add."""
    g = t("orders").groupBy(F.col("o_custkey").alias("key")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("primary"), F.array_sort(F.collect_set("o_orderstatus")).alias("secondary"))
    empty = [F.array().cast(TEXT).alias(c) for c in ("synonyms", "tags", "related_tags", "broad_tags", "name_keywords")]
    rows = g.select("*", F.col("primary").alias("activities"), F.col("secondary").alias("related_activities"), *empty)
    return niches.expand(rows, "BALANCED").select("key", "terms", "terms_left", "codes", "codes_left")


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'cold') THEN 'cold' WHEN contains(p_name, 'small') OR contains(p_name, 'large') THEN 'sized' END AS sub FROM part")
def subsegments(t):
    return t("part").select("p_partkey", niches.subsegment(F.col("p_name"), {"cold": r"\bcold\b", "sized": r"small|large"}).alias("sub"))


@query("SELECT coalesce(s_suppkey, c_custkey) AS key, coalesce(s_name, c_name) AS label, coalesce(s_nationkey, c_nationkey) AS fit FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey")
def profile_override(t):
    """An override of the ideal customer profile: its rows replace those of the default."""
    return niches.merge_config(t("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("label"), F.col("c_nationkey").alias("fit")), t("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("label"), F.col("s_nationkey").alias("fit")), "key", ["label", "fit"])


@query("""WITH m AS (SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'Rua ' || c_custkey END AS street, CASE WHEN c_custkey % 3 = 0 THEN n_name END AS city FROM customer JOIN nation ON c_nationkey = n_nationkey), q AS (SELECT *, CASE WHEN street IS NOT NULL THEN 'name_address' WHEN city IS NOT NULL THEN 'name_city' ELSE 'name_only' END AS strategy, concat_ws(', ', name, street, city) AS query FROM m)
SELECT c_custkey, strategy, query, 'https://www.google.com/maps/search/?api=1&query=' || replace(replace(replace(query, '#', '%23'), ',', '%2C'), ' ', '%20') AS search_url FROM q""")
def map_links(t):
    k = F.col("c_custkey")
    street = F.when(k % 2 == 0, "Rua")
    m = links.map_links(F.col("c_name"), street, F.when(street.isNotNull(), k.cast("string")), none(), F.when(k % 3 == 0, F.col("n_name")), none(), none("double"), none("double"))
    return companies(t).select("c_custkey", m["strategy"].alias("strategy"), m["query"].alias("query"), m["search_url"].alias("search_url"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN 0 WHEN c_custkey % 3 = 1 THEN 1 WHEN c_custkey % 5 = 1 THEN 2 WHEN c_custkey % 7 = 1 THEN 3 ELSE 4 END AS level FROM customer")
def personalisation_level(t):
    k = F.col("c_custkey")
    has = lambda m: F.when(k % m != 1, "x")
    return t("customer").select("c_custkey", links.personalisation_level(has(2), F.lit("c"), has(3), has(5), has(7)).alias("level"))


@query(f"""WITH m AS (SELECT o_orderkey, floor((epoch_us({NOW_SQL}) - epoch_us(o_orderdate)) / 60000000.0 + 0.5) AS mi FROM orders), h AS (SELECT *, floor(mi / 60 + 0.5) AS ho FROM m), d AS (SELECT *, floor(ho / 24 + 0.5) AS da FROM h), o AS (SELECT *, floor(da / 30 + 0.5) AS mo FROM d), y AS (SELECT *, floor(mo / 12 + 0.5) AS ye FROM o),
u AS (SELECT o_orderkey, CASE WHEN abs(mi) < 60 THEN mi WHEN abs(ho) < 24 THEN ho WHEN abs(da) < 30 THEN da WHEN abs(mo) < 12 THEN mo ELSE ye END AS v, CASE WHEN abs(mi) < 60 THEN 'minuto' WHEN abs(ho) < 24 THEN 'hora' WHEN abs(da) < 30 THEN 'dia' WHEN abs(mo) < 12 THEN 'mês' ELSE 'ano' END AS unit, mi FROM y)
SELECT o_orderkey, CASE WHEN abs(mi) < 1 THEN 'agora' ELSE CASE WHEN v >= 0 THEN 'há ' ELSE 'em ' END || CAST(abs(v) AS BIGINT) || ' ' || CASE WHEN abs(v) = 1 THEN unit WHEN unit = 'mês' THEN 'meses' ELSE unit || 's' END END AS said FROM u""")
def relative_times(t):
    return t("orders").select("o_orderkey", links.relative_time(F.col("o_orderdate"), now()).alias("said"))


@query("SELECT page_id, NOT (page_id % 2 = 0 AND regexp_matches(url, '^https?://[^/]*/en')) AS allowed FROM pages")
def robots_allowed(t):
    rules = F.when(F.col("page_id") % 2 == 0, "# r\nUser-agent: other\nDisallow: /\n\nUser-Agent: *\nDisallow: /en\nDisallow:").when(F.col("page_id") % 3 == 0, "User-agent: bot\r\nDisallow: /zz\r\nUser-agent: *\r\nDisallow: /")
    return t("pages").select("page_id", links.path_allowed(rules, F.regexp_extract("url", "^https?://[^/]*(.*)$", 1), "bot").alias("allowed"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '^www\\.', '') AS domain FROM pages")
def import_domain(t):
    return t("pages").select("page_id", ids.import_domain("url").alias("domain"))


@query("SELECT c_custkey, round(lat - 10 / 111.32, 9) AS south, round(lat + 10 / 111.32, 9) AS north, round(lon - 10 / (111.32 * cos(radians(lat))), 9) AS west, round(lon + 10 / (111.32 * cos(radians(lat))), 9) AS east FROM (SELECT c_custkey, c_acctbal / 1000 AS lat, c_custkey / 100.0 AS lon FROM customer)")
def box_around(t):
    b = geo.box_around(F.col("c_acctbal") / 1000, F.col("c_custkey") / 100.0, 10.0)
    return t("customer").select("c_custkey", *[F.round(b[c], 9).alias(c) for c in ("south", "north", "west", "east")])


@query("SELECT DISTINCT a.c_custkey FROM customer a WHERE a.c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey = 3)")
def co_members(t):
    """Those who share a group with one member, a semi-join of the membership with itself."""
    own = t("customer").where("c_custkey = 3").select("c_nationkey")
    return t("customer").join(own, "c_nationkey", "left_semi").select("c_custkey")


@query("SELECT o_custkey AS id, max(o_orderkey) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent, max(o_orderkey) FILTER (WHERE o_orderpriority LIKE '5%') AS low FROM orders GROUP BY 1")
def channel_pivot(t):
    """Child rows as a map by key, of which two keys are read."""
    one = t("orders").groupBy("o_custkey", "o_orderpriority").agg(F.max("o_orderkey").alias("m"))
    rows = one.groupBy(F.col("o_custkey").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct(F.substring("o_orderpriority", 1, 1), "m"))).alias("by"))
    return rows.select("id", F.try_element_at("by", F.lit("1")).alias("urgent"), F.try_element_at("by", F.lit("5")).alias("low"))


@query("SELECT o_custkey AS id, list_sort(list_distinct(list_concat(list(o_orderstatus), list(substr(o_orderpriority, 1, 1))))) AS tags FROM orders GROUP BY 1")
def lists_joined(t):
    """Lists put together without nulls and repeats."""
    g = t("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderstatus").alias("a"), F.collect_set(F.substring("o_orderpriority", 1, 1)).alias("b"))
    return g.select("id", F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.array("a", "b"))))).alias("tags"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS entry FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate > TIMESTAMP '1996-01-01 00:00:00' GROUP BY 1")
def cache_lookup(t):
    """The newest stored answer of each key that has a usable status and hasn't run out."""
    live = t("orders").where("o_orderstatus in ('F', 'O')").where(F.col("o_orderdate") > F.expr("timestamp_ntz'1996-01-01 00:00:00'"))
    return live.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("entry"))


@query("SELECT p_partkey, p_brand FROM part WHERE p_size > 3 AND (p_brand = 'Brand#5' OR p_partkey % 4 = 0) AND (p_partkey % 3 = 0 OR p_type = 'PROMO') ORDER BY (p_brand = 'Brand#5') DESC, p_name, p_partkey LIMIT 3")
def recommended_offers(t):
    """Active ones of the niche or of none, global or own; those of the niche first, three at most."""
    c = F.col
    match = c("p_brand") == "Brand#5"
    rows = t("part").where((c("p_size") > 3) & (match | (c("p_partkey") % 4 == 0)) & ((c("p_partkey") % 3 == 0) | (c("p_type") == "PROMO")))
    return rows.orderBy(match.desc(), "p_name", "p_partkey").limit(3).select("p_partkey", "p_brand")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey % 2 = 0 ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20")
def search_history(t):
    return t("orders").where("o_custkey % 2 = 0").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(20).limit(20).select("o_orderkey", "o_orderdate")


@query("SELECT c_custkey, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS total FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_name DESC, c_custkey LIMIT 25")
def page_with_total(t):
    rows = t("customer").where("c_mktsegment = 'BUILDING'")
    page = rows.orderBy(F.desc("c_name"), "c_custkey").limit(25).withColumn("k", F.lit(1))
    return page.join(rows.agg(n("total"), F.lit(1).alias("k")), "k").select("c_custkey", "total")


@query("""SELECT c_custkey, c_name, n_name, r_name, (SELECT list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS outreach, (SELECT list(DISTINCT o_orderpriority ORDER BY o_orderpriority) FROM orders WHERE o_custkey = c_custkey) AS channels, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS due
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey = 7""")
def company_detail(t):
    """One company with its look-ups and its children, each in its order."""
    own = companies(t).where("c_custkey = 7")
    o = t("orders").where("o_custkey = 7")
    made = F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("at"), "o_orderkey"))), lambda x: x["o_orderkey"])
    children = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(made.alias("outreach"), F.array_sort(F.collect_set("o_orderpriority")).alias("channels"), F.count_if(F.col("o_orderstatus") == "O").alias("due"))
    return own.join(children, "c_custkey", "left").select("c_custkey", "c_name", "n_name", "r_name", "outreach", "channels", "due")


@query("SELECT 'neighbourhood' AS kind, name, n FROM (SELECT n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, name LIMIT 10) UNION ALL SELECT 'segment', c_mktsegment, count(*) FROM customer GROUP BY 2")
def top_rollups(t):
    """Counts by neighbourhood, the largest only, and by segment."""
    by = lambda df, c, kind: df.groupBy(F.col(c).alias("name")).agg(n()).select(F.lit(kind).alias("kind"), "name", "n")
    top = by(companies(t), "n_name", "neighbourhood").orderBy(F.desc("n"), "name").limit(10)
    return top.unionByName(by(t("customer"), "c_mktsegment", "segment"))


@query("""WITH last AS (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200) SELECT l_returnflag AS source, count(*) AS requests, count(DISTINCT l_orderkey) AS searches, round(avg(l_quantity), 6) AS latency, CAST(floor(count(*) FILTER (WHERE l_linestatus = 'F') / count(*) * 100 + 0.5) AS BIGINT) AS success
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM last) GROUP BY 1""")
def performance_of_last_searches(t):
    """Per source over the last searches only."""
    last = t("orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200).select(F.col("o_orderkey").alias("l_orderkey"))
    rows = t("lineitem").join(F.broadcast(last), "l_orderkey", "left_semi")  # 200 rows
    good = F.count_if(F.col("l_linestatus") == "F")
    return rows.groupBy(F.col("l_returnflag").alias("source")).agg(n("requests"), F.countDistinct("l_orderkey").alias("searches"), F.round(F.avg("l_quantity"), 6).alias("latency"), tables.ratio(good, F.count("*")).cast("long").alias("success"))


RULES_SQL = f"""f AS (SELECT c_custkey, c_acctbal >= 0 AS site, c_custkey % 3 AS socials, c_custkey % 7 = 1 OR c_custkey % 11 = 1 OR c_custkey % 13 = 1 AS contact, c_custkey % 2 = 0 AS offer, {pick_sql('c_custkey', 'ME', None, 'MEDIA', 'GRANDE_REGIONAL')} AS size, c_custkey % 6 <> 0 AS industry,
  c_custkey % 5 <> 0 AS city, c_custkey % 8 <> 0 AS state, c_custkey % 9 = 0 AS units, c_custkey % 10 < 7 AS visual, c_custkey % 4 = 1 AS recurring, CASE c_custkey % 4 WHEN 0 THEN TIMESTAMP '1998-01-01 00:00:00' WHEN 1 THEN TIMESTAMP '1990-06-01 00:00:00' WHEN 2 THEN {NOW_SQL} - INTERVAL 389 DAY ELSE {NOW_SQL} - INTERVAL 390 DAY END AS opened,
  CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 0 END AS lacks FROM customer),
e AS (SELECT c_custkey, NOT site AS no_website, CASE WHEN site THEN socials = 0 ELSE socials <= 1 END AS weak_social_presence, contact AS business_contact_available, visual AS visual_segment, recurring AS recurring_content_need,
  city AND state AND coalesce(size <> 'GRANDE_REGIONAL', TRUE) AS local_business, units OR coalesce(size IN ('MEDIA', 'GRANDE_REGIONAL'), FALSE) AS multi_unit, floor((epoch_us({NOW_SQL}) - epoch_us(opened)) / (86400000000.0 * 30)) <= 12 AS new_business, industry AND offer AS high_offer_fit, lacks >= 2 AS weak_marketing_signals FROM f)"""


def prospects(t) -> DataFrame:
    """A company's signals for each of the ten rules."""
    k = F.col("c_custkey")
    flags = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<boolean>")
    ago = lambda days: F.expr(f"timestamp_ntz'{AS_OF}' - INTERVAL {days} DAY")
    opened = F.when(k % 4 == 0, F.expr("timestamp_ntz'1998-01-01 00:00:00'")).when(k % 4 == 1, F.expr("timestamp_ntz'1990-06-01 00:00:00'")).when(k % 4 == 2, ago(389)).otherwise(ago(390))
    return t("customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, "w").otherwise("").alias("website"), F.when(k % 7 == 1, "1").alias("phone"), F.when(k % 11 == 1, "a@b").otherwise("").alias("email"), F.when(k % 13 == 1, "2").alias("whatsapp"), opened.alias("opened_at"), pick(k, "ME", None, "MEDIA", "GRANDE_REGIONAL").alias("estimated_size"),
        F.when(k % 6 != 0, "i").alias("industry_id"), F.when(k % 5 != 0, "c").otherwise("").alias("city"), F.when(k % 8 != 0, "CE").alias("state"), F.when(k % 9 == 0, F.array(F.lit("MULTI_UNIT"))).otherwise(F.array().cast(TEXT)).alias("tags"), (k % 3).cast("int").alias("socials"),
        F.when(k % 5 == 0, flags(True, True)).when(k % 5 == 1, flags(False, None, False)).when(k % 5 == 2, flags(False, True)).when(k % 5 == 3, flags(False, False, False)).otherwise(flags()).alias("website_flags"), (k % 10 < 7).alias("visual"), (k % 4 == 1).alias("recurring"), (k % 2 == 0).alias("has_offer"),
    )


@query(f"WITH {RULES_SQL} SELECT * FROM e")
def rule_evaluators(t):
    """Which of the ten rules of the prospect score fire for each company."""
    return prospects(t).select("c_custkey", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in score.evaluators(now()).items()])


@query(f"""WITH {RULES_SQL}, c AS (SELECT c_custkey, floor(100.0 * (15 * no_website::INT + 10 * weak_social_presence::INT + 5 * business_contact_available::INT) / 30 + 0.5) AS digital, floor(100.0 * (10 * visual_segment::INT + 10 * recurring_content_need::INT) / 20 + 0.5) AS content,
  100 * multi_unit::INT AS size, 100 * local_business::INT AS near, floor(100.0 * (10 * new_business::INT + 15 * high_offer_fit::INT) / 25 + 0.5) AS fit,
  no_website::INT + weak_social_presence::INT + business_contact_available::INT + visual_segment::INT + recurring_content_need::INT + local_business::INT + multi_unit::INT + new_business::INT + high_offer_fit::INT + weak_marketing_signals::INT AS n_factors FROM e),
s AS (SELECT *, CAST(floor(digital * 0.2 + content * 0.25 + fit * 0.2 + size * 0.1 + near * 0.1 + 0.5 + 1e-9) AS BIGINT) AS score FROM c)
SELECT c_custkey, score, CASE WHEN score >= 80 THEN 'MUITO_ALTO' WHEN score >= 60 THEN 'ALTO' WHEN score >= 40 THEN 'MEDIO' ELSE 'BAIXO' END AS level, n_factors FROM s""")
def prospect_scores(t):
    """Score, level and number of factors of every company by all ten rules."""
    return score.prospect_score(prospects(t), score.evaluators(now())).select("c_custkey", "score", "level", F.size("factors").alias("n_factors"))


@query("SELECT c_custkey, CAST(20 * (c_custkey % 2 = 0)::INT + 15 * (c_acctbal > 0)::INT + 10 * (c_custkey % 3 = 0)::INT + 15 * (c_custkey % 5 = 0)::INT + 10 * (c_custkey % 7 <> 0)::INT + 10 * (c_mktsegment = 'BUILDING')::INT + 10 * (c_custkey % 11 = 0)::INT + 10 * (c_custkey % 4 = 0)::INT AS INT) AS quality FROM customer")
def data_quality_score(t):
    k = F.col("c_custkey")
    flags = {"tax_id": k % 2 == 0, "phone": F.col("c_acctbal") > 0, "email": k % 3 == 0, "website": k % 5 == 0, "name": F.when(k % 7 != 0, True), "address": F.col("c_mktsegment") == "BUILDING", "decision_maker": k % 11 == 0, "presence_checked": k % 4 == 0}
    return t("customer").select("c_custkey", score.data_quality(flags).alias("quality"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE '889' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS phone, CASE WHEN c_custkey % 4 = 1 THEN '889' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS chosen FROM customer")
def conflict_resolution(t):
    """A conflict is settled only by one of its own values."""
    k = F.col("c_custkey")
    number = F.concat(F.lit("889"), F.lpad(k.cast("string"), 8, "0"))
    rows = t("customer").select(k.alias("id"), F.when(k % 4 != 0, number).alias("phone"), F.when(k % 4 == 1, F.array(F.struct(number.alias("value")))).otherwise(F.array(F.struct(F.lit("x").alias("value")))).alias("alternatives"))
    return rows.select("id", phone_key("phone").alias("phone"), tables.resolve_conflict(rows, F.col("phone")).alias("chosen"))
