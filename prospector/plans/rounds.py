"""Queries of work done by rounds and of rules with many branches: guarded clusters, incremental resolution, polygons, brands, health of sources, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import areas, brands, health, niches, refresh, resolve
from ..operators.guarded import guarded_clusters
from .catalogue import n, people, query
from .leads import none, pick

TEXT = "array<string>"

NODES_SQL = """nodes AS (SELECT c_custkey AS idx, c_custkey // 8 AS g, CASE WHEN c_custkey % 3 = 0 THEN 't' || (c_nationkey % 2) ELSE '' END AS tax,
  CASE c_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'sobral' WHEN 2 THEN 'municipio de sobral' ELSE 'fortaleza' END AS city FROM customer)"""


@query(f"""WITH RECURSIVE {NODES_SQL}, links AS (
  SELECT x.g, x.idx AS a, y.idx AS b, CASE WHEN (x.idx * 7 + y.idx) % 4 = 0 THEN 3 ELSE 2 END AS rank, (x.idx + y.idx) % 6 = 0 AS same FROM nodes x JOIN nodes y ON x.g = y.g AND y.idx - x.idx IN (1, 3)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY rank DESC, a, b) AS i FROM links), s AS (
  SELECT g, CAST(0 AS BIGINT) AS i, list(idx ORDER BY idx) AS ids, list(idx ORDER BY idx) AS lab, list(tax ORDER BY idx) AS tax, list(city ORDER BY idx) AS city, list(0 ORDER BY idx) AS weak FROM nodes GROUP BY g
  UNION ALL
  SELECT g, i, ids, CASE WHEN ok THEN list_transform(lab, lambda l: CASE WHEN l = y THEN x ELSE l END) ELSE lab END, tax, city,
    CASE WHEN ok THEN list_transform(range(1, len(ids) + 1), lambda j: CASE WHEN list_contains(own, j) THEN list_min(list_append(list_filter(list_transform(own, lambda k: weak[k]), lambda w: w > 0), rank)) ELSE weak[j] END) ELSE weak END
  FROM (SELECT *, x <> y AND len(taxes) <= 1 AND (same OR len(list_filter(cities, lambda m: len(list_filter(cities, lambda k: NOT contains(m, k) AND NOT contains(k, m))) > 0)) = 0) AS ok
    FROM (SELECT *, list_distinct(list_filter(list_transform(own, lambda j: tax[j]), lambda v: v <> '')) AS taxes, list_filter(list_transform(own, lambda j: city[j]), lambda v: v <> '') AS cities
      FROM (SELECT *, list_filter(range(1, len(ids) + 1), lambda j: lab[j] = x OR lab[j] = y) AS own
        FROM (SELECT s.*  EXCLUDE (i), r.i, r.rank, r.same, least(lab[list_position(ids, a)], lab[list_position(ids, b)]) AS x, greatest(lab[list_position(ids, a)], lab[list_position(ids, b)]) AS y FROM s JOIN ranked r ON r.g = s.g AND r.i = s.i + 1))))
), done AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY i DESC) = 1 AND len(ids) > 1)
SELECT idx, cluster, nullif(w, 0) AS weakest FROM (SELECT unnest(ids) AS idx, unnest(lab) AS cluster, unnest(weak) AS w FROM done)""")
def guarded_links(t):
    """Links of groups of companies in order of rank, none joined that would hold two tax ids or cities that don't fit; all guards speak."""
    k, c = F.col("c_custkey"), F.col("c_nationkey")
    tax = F.when(k % 3 == 0, F.concat(F.lit("t"), (c % 2).cast("string")))
    nodes = t("customer").select(k.cast("long").alias("idx"), tax.alias("tax"), pick(c, "", "sobral", "municipio de sobral", "fortaleza").alias("city"))
    ids = nodes.select("idx", F.floor(F.col("idx") / 8).alias("component"))
    step = ids.select(F.col("idx").alias("a"), "component", F.explode(F.array(F.lit(1), F.lit(3))).alias("d")).withColumn("idx", F.col("a") + F.col("d"))
    links = step.join(ids, ["idx", "component"]).select("component", "a", F.col("idx").alias("b"))
    links = links.select("*", F.when((F.col("a") * 7 + F.col("b")) % 4 == 0, 3).otherwise(2).alias("rank"), ((F.col("a") + F.col("b")) % 6 == 0).alias("same_record"))
    return guarded_clusters(nodes, links)


@query("""WITH m AS (
  SELECT c_custkey * 2 AS idx, c_custkey AS target FROM customer
  UNION ALL SELECT s_suppkey * 2 + 1, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey + 1 ELSE s_suppkey END FROM supplier WHERE s_suppkey % 5 <> 1
  UNION ALL SELECT 10000000000 + s_suppkey, s_suppkey FROM supplier WHERE s_suppkey % 4 = 2
) SELECT idx, min(idx) OVER (PARTITION BY target) AS cluster FROM m""")
def refreshed_clusters(t):
    """Suppliers that moved to another company's number and name, others that are gone, and new records, resolved against the stored rest: records of one number and name are one."""
    rows = people(t)
    s = F.col("s_suppkey")
    spelled = lambda c: F.concat(F.lit("zor"), F.translate(F.lpad(c.cast("string"), 9, "0"), "0123456789", "bcdfghjklm"))
    number = lambda c: F.array(F.concat(F.lit("889"), F.lpad(c.cast("string"), 8, "0")))
    at = lambda idx, own, c: {"idx": idx, "source": F.lit("places_overture"), "source_record_id": own, "name": spelled(c), "phones": number(c), "city": F.lit(""), "linked_record_ids": F.array().cast(TEXT)}
    shape = lambda df, given: df.select(*[(given[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
    moved = shape(t("supplier").where("s_suppkey % 3 = 0 and s_suppkey % 5 <> 1"), at(s * 2 + 1, s.cast("string"), s + 1))
    new = shape(t("supplier").where("s_suppkey % 4 = 2"), at(s + 10_000_000_000, F.concat(F.lit("new"), s.cast("string")), s))
    gone = t("supplier").where("s_suppkey % 5 = 1").select((s * 2 + 1).alias("idx"))
    before = refresh.resolved(resolve.prepare(rows))
    return refresh.refreshed(before, resolve.prepare(moved.unionByName(new)), gone).members.select("idx", "cluster")


@query("""WITH p AS (SELECT c_custkey, (c_custkey * 0.618034::DOUBLE) % 10 AS lon, (c_custkey * 0.414214::DOUBLE) % 10 AS lat FROM customer), a AS (
  SELECT n_nationkey AS area, n_nationkey % 5 * 2 + 1.0 AS x, n_nationkey // 5 * 2 + 1.0 AS y, 0.9 + 0.2 * (n_nationkey % 4) AS r FROM nation)
SELECT c_custkey, area FROM p JOIN a ON abs(lon - x) + abs(lat - y) < r AND NOT (abs(lon - x) < 0.3 AND abs(lat - y) < 0.3)""")
def points_in_polygons(t):
    """Companies in the areas of nations: diamonds with a square hole, which overlap."""
    k = F.col("c_custkey").cast("double")
    points = t("customer").select("c_custkey", (k * 0.618034 % 10).alias("lon"), (k * 0.414214 % 10).alias("lat"))
    a = F.col("n_nationkey")
    x, y, r = a % 5 * 2 + F.lit(1.0), F.floor(a / 5) * 2 + F.lit(1.0), F.lit(0.9) + F.lit(0.2) * (a % 4)
    ring = lambda pts: F.array(*[F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in [*pts, pts[0]]])
    zero, hole = F.lit(0.0), [(F.lit(u), F.lit(v)) for u, v in ((0.3, 0.3), (-0.3, 0.3), (-0.3, -0.3), (0.3, -0.3))]
    shapes = t("nation").select(a.alias("area"), F.array(ring([(r, zero), (zero, r), (-r, zero), (zero, -r)]), ring(hole)).alias("rings"))
    return areas.in_polygons(points, shapes, "c_custkey", "area")


@query("""WITH RECURSIVE p AS (SELECT c_custkey AS ord, c_custkey // 6 AS g, CASE WHEN c_custkey % 5 <> 0 THEN -3.6::DOUBLE + (c_custkey * 7 % 11) * 0.0012::DOUBLE END AS lat, 'rua ' || (c_custkey % 2) || ' ' || (c_custkey % 3) AS address FROM customer),
q AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY ord) AS i FROM p), s AS (
  SELECT g, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(lat DOUBLE, address VARCHAR)[]) AS kept FROM q GROUP BY g
  UNION ALL
  SELECT s.g, q.i, CASE WHEN len(list_filter(kept, lambda k: CASE WHEN k.lat IS NOT NULL AND q.lat IS NOT NULL THEN 2 * 6371000 * asin(abs(sin(radians(k.lat - q.lat) / 2))) < 200 ELSE k.address = q.address END)) > 0 THEN kept ELSE list_append(kept, {'lat': q.lat, 'address': q.address}) END
  FROM s JOIN q ON q.g = s.g AND q.i = s.i + 1
), n AS (SELECT g, len(kept) AS n FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY i DESC) = 1)
SELECT ord, n AS locations FROM p JOIN n USING (g) WHERE n >= 2""")
def brand_units(t):
    """Units of brands of six companies each, by their sites: those near an earlier one that counts don't count, and without coordinates the address decides."""
    k = F.col("c_custkey")
    places = t("customer").select(
        k.alias("ord"), none().alias("name"), F.concat(F.lit("www.brand"), F.floor(k / 6).cast("string"), F.lit(".com.br")).alias("website"), F.when(k % 5 != 0, F.lit(-3.6) + (k * 7 % 11) * F.lit(0.0012)).alias("lat"), F.lit(-40.3).alias("lon"),
        F.concat(F.lit("Rua "), (k % 2).cast("string")).alias("street"), (k % 3).cast("string").alias("house_number"),
    )
    return brands.brand_locations(places)


@query("""WITH o AS (SELECT o_custkey, count(*) AS runs, avg(CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE 1.0 END) AS rate FROM orders GROUP BY 1),
s AS (SELECT c_custkey AS k, coalesce(runs, 0) AS runs, rate, CASE WHEN c_custkey % 5 = 0 THEN 'OPEN' ELSE 'CLOSED' END AS state, c_custkey * 13 % 240 AS open_s FROM customer LEFT JOIN o ON c_custkey = o_custkey)
SELECT k AS source, CASE WHEN state = 'OPEN' AND open_s >= 120 THEN 'HALF_OPEN' ELSE state END AS state,
  CASE WHEN k % 11 = 0 THEN 'NOT_CONFIGURED' WHEN k % 7 = 0 THEN 'DISABLED' WHEN runs = 0 THEN 'HEALTHY' WHEN state = 'OPEN' AND open_s < 120 THEN 'DOWN' WHEN state = 'OPEN' OR rate < 0.8 OR k % 9 = 0 THEN 'DEGRADED' WHEN k % 8 = 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health
FROM s""")
def source_status(t):
    """Health of every source: switches first, then no runs, the breaker with the end of its cool-down, recent failures and partial results."""
    o = t("orders").groupBy("o_custkey").agg(n("runs"), F.avg(F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(1.0)).alias("rate"))
    k = F.col("c_custkey")
    rows = t("customer").join(o, k == F.col("o_custkey"), "left").withColumns({"state": F.when(k % 5 == 0, "OPEN").otherwise("CLOSED"), "open_s": k * 13 % 240})
    said = health.status(k % 7 != 0, k % 11 != 0, F.col("runs"), F.col("state"), F.col("open_s"), F.col("rate"), F.when(k % 9 == 0, 1).otherwise(0), F.when(k % 8 == 0, health.PARTIAL))
    return rows.select(k.alias("source"), health.half_open(F.col("state"), F.col("open_s")).alias("state"), said.alias("health"))


@query("""WITH g AS (SELECT o_custkey AS k, count(*) AS found, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS p, list(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS s FROM orders GROUP BY 1),
c AS (SELECT *, CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 0.0 WHEN 2 THEN 12.5 WHEN 3 THEN 29.0 WHEN 4 THEN 60.0 ELSE 100.0 END AS radius, CASE WHEN k % 4 = 0 THEN [] ELSE p END AS terms, CASE WHEN k % 3 = 0 THEN [] ELSE s END AS codes, CASE WHEN k % 7 = 0 THEN s ELSE [] END AS sources FROM g),
e AS (
  SELECT k, found, 1 AS place, 'radius' AS kind, CASE WHEN radius IS NULL OR radius = 0 THEN '15' WHEN radius = 12.5 THEN '25' WHEN radius = 29 THEN '58' ELSE '100' END AS said FROM c WHERE radius IS NULL OR radius < 100
  UNION ALL SELECT k, found, 2, 'keywords', array_to_string(terms[1:5], '|') FROM c WHERE len(terms) > 0
  UNION ALL SELECT k, found, 3, 'cnaes', array_to_string(codes, '|') FROM c WHERE len(codes) > 0 AND k % 5 <> 0
  UNION ALL SELECT k, found, 4, 'nearby_cities', '30' FROM c WHERE radius IS NULL OR radius < 30
  UNION ALL SELECT k, found, 5, 'sources', array_to_string(sources, '|') FROM c WHERE len(sources) > 0 OR k % 10 = 1
  UNION ALL SELECT k, found, 6, 'mode', 'BROAD' FROM c WHERE k % 2 = 0)
SELECT k AS search, row_number() OVER (PARTITION BY k ORDER BY place) AS place, kind, said FROM e WHERE found < 12""")
def search_suggestions(t):
    """What would widen each search that found fewer than its limit, in order."""
    g = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(n("found"), F.array_sort(F.collect_set("o_orderpriority")).alias("p"), F.array_sort(F.collect_set("o_orderstatus")).alias("s"))
    k = F.col("k")
    empty = F.array().cast(TEXT)
    radius = pick(k, None, "0", "12.5", "29", "60", "100").cast("double")
    said = niches.suggestions(
        F.col("found"), F.lit(12), radius, F.when(k % 4 == 0, empty).otherwise(F.col("p")), F.when(k % 3 == 0, empty).otherwise(F.col("s")), k % 5 == 0, F.when(k % 7 == 0, F.col("s")).otherwise(empty), k % 10 == 1, F.when(k % 2 == 0, "BALANCED").otherwise("BROAD")
    )
    rows: DataFrame = g.select(k.alias("search"), F.posexplode(said).alias("place", "s"))
    return rows.select("search", (F.col("place") + 1).cast("long").alias("place"), F.col("s")["kind"].alias("kind"), F.array_join(F.col("s")["values"], "|").alias("said"))
