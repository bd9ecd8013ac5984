"""Queries over the driver tables in the roles of the lead database: customer is a company, supplier a second source, nation
a city, region a state, c_mktsegment a niche, orders the outreach log, part the catalogue, events the request log, pages
the websites. Each query has its SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, html, ids, text
from ..operators import health, qualify, resolve, score, tables
from ..operators.graph import connected, stored

AS_OF = "1998-08-02 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of (t), t being a reader of tables by name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: table(spark, sf_dir, name))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return add


def n(name: str = "n"):
    return F.count("*").alias(name)


def cities(t) -> DataFrame:
    """nation with its region: a few rows by definition of the schema."""
    return F.broadcast(t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name"))


def companies(t) -> DataFrame:
    return t("customer").join(cities(t), F.col("c_nationkey") == F.col("n_nationkey"), "left")


# The signals of the prospect score, in terms of the tables.
SIGNALS_SQL = f"""
signals AS (
  SELECT c.c_custkey, c_name, n_name AS city, r_name AS state, c_mktsegment, c_acctbal, coalesce(o.n, 0) AS n_orders,
    c_acctbal < 0 AS no_website, coalesce(o.n, 0) <= 5 AS weak_social_presence, c_acctbal >= 1000 AS business_contact_available,
    c_mktsegment IN ('BUILDING', 'FURNITURE') AS visual_segment, c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') AS recurring_content_need, r_name IS NOT NULL AND c_acctbal < 9000 AS local_business,
    coalesce(o.n, 0) >= 15 AS multi_unit, coalesce(first_at >= TIMESTAMP '{AS_OF}' - INTERVAL 360 DAY, FALSE) AS new_business, c_mktsegment = 'AUTOMOBILE' AS high_offer_fit, coalesce(late, 0) >= 5 AS weak_marketing_signals
  FROM customer c LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderdate) AS first_at, count(*) FILTER (WHERE o_orderstatus = 'O') AS late FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey
), categories AS (
  SELECT *, CAST(floor(100.0 * (15 * no_website::INT + 10 * weak_social_presence::INT + 5 * business_contact_available::INT) / 30 + 0.5) AS BIGINT) AS digital_presence,
    CAST(floor(100.0 * (10 * visual_segment::INT + 10 * recurring_content_need::INT) / 20 + 0.5) AS BIGINT) AS content_need,
    CAST(floor(100.0 * (10 * new_business::INT + 15 * high_offer_fit::INT) / 25 + 0.5) AS BIGINT) AS fit,
    100 * multi_unit::INT AS size, 100 * local_business::INT AS local_proximity FROM signals
), scored AS (
  SELECT *, CAST(floor((digital_presence * 0.2::DOUBLE + content_need * 0.25::DOUBLE + 0 + fit * 0.2::DOUBLE + size * 0.1::DOUBLE + local_proximity * 0.1::DOUBLE) / 1.0 + 0.5) AS BIGINT) AS score FROM categories
)"""
LEVEL_SQL = "CASE WHEN score >= 80 THEN 'MUITO_ALTO' WHEN score >= 60 THEN 'ALTO' WHEN score >= 40 THEN 'MEDIO' ELSE 'BAIXO' END"


def scored(t) -> DataFrame:
    o = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.min("o_orderdate").alias("first_at"), F.count_if(F.col("o_orderstatus") == "O").alias("late"))
    df = companies(t).join(o, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("n_orders", F.coalesce("n_orders", F.lit(0)))
    seg, bal, orders = F.col("c_mktsegment"), F.col("c_acctbal"), F.col("n_orders")
    fires = {
        "no_website": bal < 0, "weak_social_presence": orders <= 5, "business_contact_available": bal >= 1000,
        "visual_segment": seg.isin("BUILDING", "FURNITURE"), "recurring_content_need": seg.isin("HOUSEHOLD", "FURNITURE"), "local_business": F.col("r_name").isNotNull() & (bal < 9000),
        "multi_unit": orders >= 15, "new_business": F.col("first_at") >= F.expr(f"timestamp_ntz'{AS_OF}' - interval 360 days"), "high_offer_fit": seg == "AUTOMOBILE", "weak_marketing_signals": F.coalesce("late", F.lit(0)) >= 5,
    }
    return score.prospect_score(df, fires)


@query(f"WITH {SIGNALS_SQL} SELECT c_custkey, c_name, city, state, score, {LEVEL_SQL} AS level FROM scored ORDER BY score DESC, c_custkey LIMIT 10")
def top_leads(t):
    out = scored(t).select("c_custkey", "c_name", F.col("n_name").alias("city"), F.col("r_name").alias("state"), "score", "level")
    return out.orderBy(F.desc("score"), "c_custkey").limit(10)


@query(f"""WITH {SIGNALS_SQL} SELECT c_custkey, score, {LEVEL_SQL} AS level, digital_presence, content_need, fit,
  no_website::INT + weak_social_presence::INT + business_contact_available::INT + visual_segment::INT + recurring_content_need::INT + local_business::INT + multi_unit::INT + new_business::INT + high_offer_fit::INT + weak_marketing_signals::INT AS n_factors FROM scored""")
def prospect_score_factors(t):
    c = F.col("category_scores")
    return scored(t).select("c_custkey", "score", "level", c["digital_presence"].alias("digital_presence"), c["content_need"].alias("content_need"), c["fit"].alias("fit"), F.size("factors").alias("n_factors"))


@query("SELECT c_custkey, c_name, n_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND n_name ILIKE '%nation\\_1%' ESCAPE '\\' AND c_acctbal IS NOT NULL ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 25")
def list_filtered_page(t):
    rows = companies(t).where((F.col("c_mktsegment") == "BUILDING") & tables.contains_text(["n_name"], "nation_1") & F.col("c_acctbal").isNotNull())
    return rows.select("c_custkey", "c_name", "n_name", "c_acctbal").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").offset(25).limit(25)


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE contains(lower(p_name), '1') OR contains(lower(p_brand), '23') OR contains(lower(p_type), 'brass')")
def text_search_or(t):
    return t("part").where(tables.contains_text(["p_name"], "1") | tables.contains_text(["p_brand"], "23") | tables.contains_text(["p_type"], "brass")).select("p_partkey", "p_name", "p_brand", "p_type")


@query("""SELECT (SELECT count(*) FROM customer) AS companies, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS negative, (SELECT count(*) FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) AS niches,
  count(*) AS contacted, count(*) FILTER (WHERE o_orderstatus = 'F') AS replies, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-07-01 00:00:00') AS recent, count(*) FILTER (WHERE o_orderstatus <> 'P') AS settled FROM orders""")
def dashboard_counts(t):
    """One pass over each table; the two one-row results stand side by side."""
    c = t("customer").agg(n("companies"), F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.count_if(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).alias("niches"), F.lit(1).alias("k"))
    o = t("orders").agg(n("contacted"), F.count_if(F.col("o_orderstatus") == "F").alias("replies"), F.count_if(F.col("o_orderdate") >= F.expr("timestamp_ntz'1998-07-01 00:00:00'")).alias("recent"), F.count_if(F.col("o_orderstatus") != "P").alias("settled"), F.lit(1).alias("k"))
    return c.join(o, "k").drop("k")


@query("SELECT o_orderpriority, count(*) AS n, CAST(CASE WHEN count(*) > 0 THEN floor(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) * 100 + 0.5) END AS BIGINT) AS reply_rate, CAST(CASE WHEN count(*) FILTER (WHERE o_totalprice > 1e9) > 0 THEN 1 END AS BIGINT) AS none_rate FROM orders GROUP BY 1")
def conversion_rates(t):
    replies, none = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_totalprice") > 1e9)
    return t("orders").groupBy("o_orderpriority").agg(n(), tables.ratio(replies, F.count("*")).cast("long").alias("reply_rate"), tables.ratio(none, none).cast("long").alias("none_rate"))


@query("SELECT o_orderstatus, count(*) AS n, CAST(coalesce(floor(avg(o_totalprice) FILTER (WHERE o_orderpriority LIKE '1%') + 0.5), 0) AS BIGINT) AS mean_urgent FROM orders GROUP BY 1")
def status_histogram(t):
    urgent = F.avg(F.when(F.col("o_orderpriority").startswith("1"), F.col("o_totalprice")))
    return t("orders").groupBy("o_orderstatus").agg(n(), F.coalesce(F.floor(urgent + 0.5), F.lit(0)).cast("long").alias("mean_urgent"))


@query("SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN 'overdue' WHEN o_orderdate < TIMESTAMP '1998-01-02 00:00:00' THEN 'today' ELSE 'upcoming' END AS bucket, count(*) AS n, min(o_orderdate) AS first_due FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def queue_buckets(t):
    due = F.col("o_orderdate")
    day = lambda d: F.expr(f"timestamp_ntz'{d} 00:00:00'")
    bucket = F.when(due < day("1998-01-01"), "overdue").when(due < day("1998-01-02"), "today").otherwise("upcoming")
    return t("orders").where("o_orderstatus = 'O'").groupBy(bucket.alias("bucket")).agg(n(), F.min(due).alias("first_due"))


@query("SELECT o_orderkey, o_custkey, o_orderdate AS due FROM orders ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END ASC NULLS LAST, o_orderkey LIMIT 50")
def queue_order(t):
    due = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return t("orders").orderBy(due.asc_nulls_last(), "o_orderkey").limit(50).select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("due"))


@query("SELECT o_orderstatus, o_orderkey, c_name, CAST(r AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) o JOIN customer ON o_custkey = c_custkey WHERE r <= 20")
def kanban_top_n_per_stage(t):
    """Spark limits each stage before the shuffle (a window group limit), so a hot stage is no hot task."""
    w = W.partitionBy("o_orderstatus").orderBy(F.desc("o_orderdate"), "o_orderkey")
    top = t("orders").withColumn("place", F.row_number().over(w)).where("place <= 20")
    return top.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderstatus", "o_orderkey", "c_name", "place")


@query("""WITH picked AS (SELECT * FROM customer WHERE c_mktsegment = 'AUTOMOBILE' ORDER BY c_custkey LIMIT 100), sup AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P')
SELECT c_custkey, n_name, o_custkey IS NOT NULL AS suppressed FROM picked JOIN nation ON c_nationkey = n_nationkey LEFT JOIN sup ON c_custkey = o_custkey WHERE c_custkey % 7 <> 0""")
def campaign_audience(t):
    """The limit is on what is chosen, before exclusions; those already in the campaign (every seventh) go, suppressed ones are marked."""
    picked = companies(t).where("c_mktsegment = 'AUTOMOBILE'").orderBy("c_custkey").limit(100).select(F.col("c_custkey").alias("contact"), "n_name")
    stopped = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("contact"), F.lit("all").alias("channel"))
    already = t("customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("contact"))
    return tables.suppressed(picked.join(already, "contact", "left_anti"), stopped, "email").select(F.col("contact").alias("c_custkey"), "n_name", F.col("blocked").alias("suppressed"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY 1")
def suppression_anti_join(t):
    return t("customer").join(t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").groupBy("c_mktsegment").agg(n())


@query("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY 1")
def semi_join_lookup(t):
    keys = t("part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return t("lineitem").join(keys, "l_partkey", "left_semi").groupBy("l_returnflag").agg(n(), F.sum("l_quantity").alias("quantity"))


@query("SELECT o_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS parts FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) JOIN orders ON l_orderkey = o_orderkey WHERE r <= 3 AND o_orderstatus = 'P' GROUP BY 1")
def first_n_per_key(t):
    few = tables.first_per_key(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey")], 3)
    own = few.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("parts"))
    return t("orders").where("o_orderstatus = 'P'").join(own, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "parts")


@query("""SELECT l_orderkey, p_brand AS brand FROM (SELECT l_orderkey, p_brand, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, l_linenumber, p_brand) AS r FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE r = 1""")
def priority_first_match(t):
    each = t("lineitem").join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    order = F.struct(F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("rank"), "l_linenumber", "p_brand")
    return each.groupBy("l_orderkey").agg(F.min_by("p_brand", order).alias("brand"))


@query("SELECT a.n_name AS from_city, b.n_name AS to_city, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey GROUP BY 1, 2")
def double_dim_join(t):
    city = lambda key, name: F.broadcast(t("nation").select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name)))
    moves = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    moves = moves.join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    # Counted by key first: names join to a few hundred rows.
    few = moves.groupBy("c_nationkey", "s_nationkey").agg(n())
    return few.join(city("c_nationkey", "from_city"), "c_nationkey").join(city("s_nationkey", "to_city"), "s_nationkey").select("from_city", "to_city", "n")


@query("SELECT c_custkey, coalesce(k, 0) AS n_orders, coalesce(statuses, []) AS statuses, coalesce(any_open, FALSE) AS any_open FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS k, list(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS statuses, bool_or(o_orderstatus = 'O') AS any_open FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def embed_children(t):
    o = t("orders").groupBy("o_custkey").agg(n("k"), F.array_sort(F.collect_set("o_orderstatus")).alias("statuses"), F.bool_or(F.col("o_orderstatus") == "O").alias("any_open"))
    out = t("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", F.coalesce("k", F.lit(0)).alias("n_orders"), F.coalesce("statuses", F.array().cast("array<string>")).alias("statuses"), F.coalesce("any_open", F.lit(False)).alias("any_open"))


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN s_name ELSE c_name END AS name, CASE WHEN s_suppkey IS NOT NULL THEN s_nationkey ELSE c_nationkey END AS city FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def complement_merge(t):
    """Every third name is empty: it is filled where the second source has one; the city is refreshed."""
    old = t("customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"), F.col("c_nationkey").alias("city"))
    new = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("city"))
    return tables.complement(old, new, ["k"], ["name"], ["city"])


@query("SELECT c_custkey AS k, c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def upsert_by_key(t):
    return tables.upsert(t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), ["k"])


@query("SELECT s_suppkey AS k, s_name AS name, s_acctbal AS balance FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0")
def insert_ignore(t):
    return tables.insert_ignore(t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), ["k"])


@query("SELECT c_custkey AS k, c_name AS name, 'customer' AS source, c_mktsegment AS niche FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier', NULL FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def source_union_dedup(t):
    a = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.lit("customer").alias("source"), F.col("c_mktsegment").alias("niche"))
    return tables.union_first([a, t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit("supplier").alias("source"))], "k")


@query("SELECT CASE WHEN n_name NOT LIKE '%1%' THEN 'city' WHEN c_acctbal < 0 THEN 'status' WHEN c_mktsegment = 'MACHINERY' THEN 'niche' ELSE 'kept' END AS outcome, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def visible_filter_funnel(t):
    return tables.funnel(companies(t), {"city": ~F.contains("n_name", F.lit("1")), "status": F.col("c_acctbal") < 0, "niche": F.col("c_mktsegment") == "MACHINERY"})


@query("SELECT user_id AS source, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS failures, round(avg(value), 6) AS latency, CAST(floor(count(*) FILTER (WHERE event_type <> 'error') / count(*) * 100 + 0.5) AS BIGINT) AS success FROM events GROUP BY 1")
def source_performance(t):
    bad = F.count_if(F.col("event_type") == "error")
    return t("events").groupBy(F.col("user_id").alias("source")).agg(n("requests"), bad.alias("failures"), F.round(F.avg("value"), 6).alias("latency"), tables.ratio(F.count("*") - bad, F.count("*")).cast("long").alias("success"))


@query("SELECT count(*) AS results, count(*) FILTER (WHERE c_acctbal >= 0) AS with_site, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, count(DISTINCT c_nationkey) AS cities, CAST(floor(count(*) FILTER (WHERE c_acctbal >= 0) / count(*) * 100 + 0.5) AS BIGINT) AS presence FROM customer")
def search_summary(t):
    site = F.count_if(F.col("c_acctbal") >= 0)
    return t("customer").agg(n("results"), site.alias("with_site"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"), F.countDistinct("c_nationkey").alias("cities"), tables.ratio(site, F.count("*")).cast("long").alias("presence"))


@query("WITH x AS (SELECT (c_acctbal >= 0)::INT AS covered, CASE WHEN c_acctbal > 5000 THEN 100 WHEN c_acctbal > 0 THEN 60 ELSE 20 END AS complete, (c_mktsegment = 'BUILDING')::INT AS high FROM customer) SELECT CAST(floor(avg(covered) * 30 + avg(complete) * 0.35 + avg(high) * 20 + 15 + 0.5) AS BIGINT) AS quality FROM x")
def quality_index(t):
    bal = F.col("c_acctbal")
    complete = F.when(bal > 5000, 100).when(bal > 0, 60).otherwise(20)
    share = lambda c: F.avg(F.when(c, 1).otherwise(0))
    return t("customer").agg(F.floor(share(bal >= 0) * 30 + F.avg(complete) * 0.35 + share(F.col("c_mktsegment") == "BUILDING") * 20 + 15 + 0.5).cast("long").alias("quality"))


@query("SELECT CAST(GROUPING(c_mktsegment) * 2 + GROUPING(r_name) AS BIGINT) AS g, c_mktsegment AS segment, r_name AS region, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((c_mktsegment, r_name), (c_mktsegment), (r_name), ())")
def rollup_by_segment_region(t):
    out = companies(t).where("r_name is not null").cube("c_mktsegment", "r_name").agg(F.grouping_id().alias("g"), n(), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return out.select(F.col("g").cast("long").alias("g"), F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"), "n", "balance")


@query("""WITH x AS (SELECT d.doc_id, 15 * (source IS NOT NULL)::INT + 10 * (length(text) >= 100)::INT + 15 * (lang = 'en')::INT + 15 * (n_chars > 500)::INT + 10 * (contains(text, '@'))::INT + 15 * (contains(text, 'http'))::INT + 10 * (l.quality = 1)::INT + 10 * coalesce((l.toxic = 0)::INT, 0) AS s
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT doc_id, CAST(s AS INT) AS completeness, CASE WHEN s >= 75 THEN 'COMPLETO' WHEN s >= 45 THEN 'PARCIAL' ELSE 'FRACO' END AS label, CAST(floor(s * 0.6 + 16 + 8 + 0.5) AS BIGINT) AS rank FROM (SELECT doc_id, coalesce(s, 0) AS s FROM (SELECT d.doc_id, 15 * (source IS NOT NULL)::INT + 10 * (length(text) >= 100)::INT + 15 * (lang = 'en')::INT + 15 * (n_chars > 500)::INT + 10 * (contains(text, '@'))::INT + 15 * (contains(text, 'http'))::INT + 10 * coalesce((l.quality = 1)::INT, 0) + 10 * coalesce((l.toxic = 0)::INT, 0) AS s FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id))""")
def completeness_rank(t):
    c = F.col
    flags = {"cnpj": c("source").isNotNull(), "name": F.length("text") >= 100, "address": c("lang") == "en", "phone": c("n_chars") > 500, "email": F.contains("text", F.lit("@")), "website": F.contains("text", F.lit("http")), "social": c("quality") == 1, "decision_maker": c("toxic") == 0}
    df = t("documents").join(t("labels"), "doc_id", "left").withColumn("completeness", resolve.completeness(flags))
    return df.select("doc_id", "completeness", resolve.completeness_label(c("completeness")).alias("label"), resolve.rank_score(c("completeness"), F.lit("MEDIUM"), F.lit(2)).alias("rank"))


@query("""SELECT page_id, CAST(greatest(0, least(100, least(36, 12 * (page_id % 4)) + 20 * (url LIKE 'https%')::INT + least(32, 8 * (length(html) - length(replace(html, '<li>', ''))) // 4) + 5 * contains(html, '<video')::INT + 5 * contains(html, '/blog')::INT + 3 * contains(html, '@')::INT + 3 * contains(html, 'hours')::INT + 8)) AS BIGINT) AS visibility FROM pages""")
def visibility_score(t):
    c, has = F.col, lambda s: F.contains("html", F.lit(s))
    items = F.floor((F.length("html") - F.length(F.replace(c("html"), F.lit("<li>"), F.lit("")))) * 8 / 4)
    return t("pages").select("page_id", resolve.visibility(c("page_id") % 4 + 1, c("url").startswith("https"), items / 8, has("<video"), has("/blog"), has("@"), has("hours"), F.lit(8)).cast("long").alias("visibility"))


@query("""WITH p AS (SELECT c_custkey, CASE WHEN coalesce(k, 0) >= 3 THEN 4 WHEN k = 2 THEN 3 ELSE 1 END + (c_acctbal > 0)::INT + CASE WHEN c_mktsegment = 'BUILDING' THEN 2 WHEN c_acctbal > 500 THEN 0.5 ELSE 0 END + (c_acctbal > 100)::INT - least(2, c_custkey % 3) AS p FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) ON c_custkey = o_custkey)
SELECT CASE WHEN p >= 7 THEN 'VERY_HIGH' WHEN p >= 5 THEN 'HIGH' WHEN p >= 3 THEN 'MEDIUM' WHEN p >= 1.5 THEN 'LOW' ELSE 'VERY_LOW' END AS confidence, count(*) AS n FROM p GROUP BY 1""")
def lead_confidence_levels(t):
    o = t("orders").groupBy("o_custkey").agg(n("sources"))
    df = t("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    none = lambda kind: F.lit(None).cast(kind)
    bal = F.col("c_acctbal")
    df = df.select(
        F.coalesce("sources", F.lit(0)).alias("sources"), F.when(bal > 0, "x").alias("cnpj"), F.when(F.col("c_mktsegment") == "BUILDING", "ACTIVE").alias("site_status"), F.when(bal > 500, "w").alias("website"), (bal > 100).alias("phone_valid"),
        none("string").alias("street"), none("string").alias("house_number"), none("double").alias("lat"), none("double").alias("lon"), none("string").alias("domain_match"), (F.col("c_custkey") % 3).alias("conflicts"), F.lit(False).alias("text_only"), F.lit(False).alias("medium_duplicate"), none("double").alias("verified_days"), none("double").alias("data_days"),
    )
    return df.groupBy(qualify.confidence_level(qualify.confidence_points()).alias("confidence")).agg(n())


@query("""WITH e AS (SELECT p_partkey, CASE WHEN p_size >= 40 THEN 36 WHEN p_size >= 20 THEN 33 ELSE 0 END AS large, CASE WHEN p_type ILIKE '%BRASS%' THEN 26 + 5 ELSE 0 END AS metal, CASE WHEN p_brand LIKE '%1' THEN 10 ELSE 0 END AS named FROM part)
SELECT p_partkey, CASE WHEN greatest(large, metal, named) = 0 THEN NULL WHEN large = greatest(large, metal, named) THEN 'large' WHEN metal = greatest(large, metal, named) THEN 'metal' ELSE 'named' END AS segment FROM e""")
def segment_resolution(t):
    size = F.col("p_size")
    none = F.lit(False)
    evidence = {
        "large": qualify.segment_evidence(F.when(size >= 40, 2).when(size >= 20, 1), None, None, none),
        "metal": qualify.segment_evidence(None, F.when(F.contains(F.upper("p_type"), F.lit("BRASS")), 2), None, F.lit(True)),
        "named": qualify.segment_evidence(None, None, F.col("p_brand").endswith("1"), none),
    }
    return t("part").select("p_partkey", qualify.segment_of(evidence).alias("segment"))


GENERIC_SQL = "[" + ", ".join(f"'{w}'" for w in text.GENERIC_WORDS) + "]"
FOLD = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH f AS (SELECT c_custkey, {FOLD.format("x")} AS n FROM (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'Restaurante' WHEN 1 THEN 'Bar & Grill' WHEN 2 THEN '12 34' WHEN 3 THEN 'Pizzaria do Zé' WHEN 4 THEN 'Sem Nome' WHEN 5 THEN 'Bar e Pizzaria da Casa' ELSE c_name END AS x FROM customer))
SELECT c_custkey, n AS folded, length(n) < 3 OR regexp_full_match(n, '[0-9 ]+|sem nome|nome|desconhecido|unknown|teste?|test|xxx+|null|undefined') OR (len(w) BETWEEN 1 AND 2 AND len(list_filter(w, lambda x: NOT list_contains({GENERIC_SQL}, x))) = 0) AS generic
FROM (SELECT *, list_filter(string_split(n, ' '), lambda x: NOT list_contains(['de', 'da', 'do', 'das', 'dos', 'e', 'a', 'o', 'the', 'and'], x)) AS w FROM f)""")
def generic_name_flag(t):
    k = F.col("c_custkey") % 7
    name = F.when(k == 0, "Restaurante").when(k == 1, "Bar & Grill").when(k == 2, "12 34").when(k == 3, "Pizzaria do Zé").when(k == 4, "Sem Nome").when(k == 5, "Bar e Pizzaria da Casa").otherwise(F.col("c_name"))
    return t("customer").select("c_custkey", text.fold_text(name).alias("folded"), text.is_generic_name(name).alias("generic"))


@query(f"SELECT doc_id, sha256({FOLD.format("coalesce(text, '')")}) AS folded FROM documents")
def fold_text(t):
    """Every document, of any language or none; a null text is empty."""
    return t("documents").select("doc_id", F.sha2(text.fold_text("text"), 256).alias("folded"))


TRIGRAMS = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: substr('  ' || {0} || ' ', i, 3)))"


@query(f"""WITH s AS (SELECT s_suppkey, lower(s_name) AS a, lower(replace(c_name, '#', '')) AS b FROM supplier JOIN customer ON s_suppkey = c_custkey), g AS (SELECT *, {TRIGRAMS.format('a')} AS ta, {TRIGRAMS.format('b')} AS tb FROM s)
SELECT s_suppkey, round(len(list_intersect(ta, tb)) / (len(ta) + len(tb) - len(list_intersect(ta, tb))), 9) AS similarity FROM g""")
def name_trigram_similarity(t):
    both = t("supplier").join(t("customer"), F.col("s_suppkey") == F.col("c_custkey"))
    return both.select("s_suppkey", F.round(text.name_similarity(F.lower("s_name"), F.lower(F.replace("c_name", F.lit("#"), F.lit("")))), 9).alias("similarity"))


@query("""WITH k AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS key FROM documents), b AS (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 400)
SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM k x JOIN b ON x.key = b.key JOIN k y ON y.key = x.key AND x.doc_id < y.doc_id""")
def blocking_pairs(t):
    """Pairs by all distinct words of the whole text, with the method's own rule of 2 to 400 records a block only."""
    keys = t("documents").select(F.col("doc_id").alias("idx"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))).alias("key"))
    return resolve.candidate_pairs(keys)


def people(t) -> DataFrame:
    """customer and supplier as source records of one idx space."""
    none = lambda kind: F.lit(None).cast(kind)
    base = lambda df, key, name, src, off: df.select(
        (F.col(key) * 2 + off).alias("idx"), F.lit(src).alias("source"), F.col(key).cast("string").alias("source_record_id"), F.concat(F.lit("zor"), F.translate(F.regexp_extract(name, "([0-9]+)", 1), "0123456789", "bcdfghjklm")).alias("name"), none("string").alias("trade_name"),
        F.when(F.col(key) % 5 == 0, F.lpad(F.col(key).cast("string"), 14, "0")).alias("cnpj"), F.when(F.col(key) % 4 == 0, F.concat(F.lit("www.site"), F.col(key).cast("string"), F.lit(".com"))).alias("website"),
        F.array(F.concat(F.lit("889"), F.lpad(F.col(key).cast("string"), 8, "0"))).alias("phones"), F.lit("").alias("city"), none("string").alias("street"), none("double").alias("lat"), none("double").alias("lon"), F.array().cast("array<string>").alias("linked_record_ids"),
    )
    a = base(t("customer"), "c_custkey", "c_name", "local_db", 0)
    return a.unionByName(base(t("supplier"), "s_suppkey", "s_name", "places_overture", 1))


@query("""SELECT s_suppkey * 2 AS a, s_suppkey * 2 + 1 AS b, CASE WHEN s_suppkey % 5 = 0 THEN 'EXACT' ELSE 'HIGH' END AS level FROM supplier JOIN customer ON s_suppkey = c_custkey""")
def pair_classification(t):
    p = resolve.prepare(people(t))
    return resolve.block_levels(p, resolve.block_keys(p))


@query("""SELECT c_custkey * 2 AS idx, c_custkey * 2 AS cluster FROM customer UNION ALL SELECT s_suppkey * 2 + 1, CASE WHEN c_custkey IS NULL THEN s_suppkey * 2 + 1 ELSE s_suppkey * 2 END FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey""")
def guarded_clusters(t):
    p = stored(resolve.prepare(people(t)))
    return resolve.clusters(p, resolve.block_levels(p, resolve.block_keys(p)))


def rivals(t) -> DataFrame:
    """customer and supplier as groups of four keys each with names, tax ids, cities, phones, sites and coordinates that agree in part and conflict in part."""
    none = F.lit(None).cast("string")

    def base(df, key, src, off):
        k, m = F.col(key), F.col(key) % 4
        g = F.floor(k / 4)
        name = F.concat(F.lit("Alpha zor"), F.translate(g.cast("string"), "0123456789", "bcdfghjklm"), F.when(m == 3, " sul").when((m == 2) & (g % 2 == 0), " 2").otherwise(""))
        place = lambda start, step: F.when(m != 1, F.lit(start) + (g % 1000) * 0.01 + m * step)
        return df.select(
            (k * 2 + off).alias("idx"), F.lit(src).alias("source"), k.cast("string").alias("source_record_id"), name.alias("name"), none.alias("trade_name"),
            F.when(m == off, F.lpad((k * 2 + off).cast("string"), 14, "0")).alias("cnpj"), F.when((m == 3) & (g % 3 == 0), F.concat(F.lit("www.site"), g.cast("string"), F.lit(".com"))).alias("website"),
            F.array(F.concat(F.lit("889"), F.lpad(F.when(m.isin(1, 2), g).otherwise(k * 2 + off + 20_000_000).cast("string"), 8, "0"))).alias("phones"),
            F.element_at(F.array(F.lit(""), F.lit("Sobral"), F.lit("Fortaleza")), ((k + off) % 3 + 1).cast("int")).alias("city"), none.alias("street"), place(-3.6, 0.0005).alias("lat"), place(-40.3, 0.0005).alias("lon"),
            F.when((m == 3) & (g % 5 == 0), F.array(F.concat(F.lit("local_db:"), (k - 3).cast("string")))).otherwise(F.array().cast("array<string>")).alias("linked_record_ids"),
        )

    return base(t("customer"), "c_custkey", "local_db", 0).unionByName(base(t("supplier"), "s_suppkey", "places_overture", 1))


def rival_levels(t) -> tuple[DataFrame, DataFrame]:
    p = stored(resolve.prepare(rivals(t)))
    return p, stored(resolve.block_levels(p, resolve.block_keys(p)))


@query()
def pair_evidence(t):
    """Levels of all pairs that any of the six kinds of block keys makes; tested by brute force."""
    return rival_levels(t)[1]


@query()
def conflicting_clusters(t):
    """Clusters with their confidence where tax ids and cities conflict; tested by brute force."""
    return resolve.merged(*rival_levels(t))[0].select("idx", "cluster", "confidence")


@query()
def merge_reviews(t):
    """Pairs to review: MEDIUM and LOW ones, and those that the guards refused; tested by brute force."""
    return resolve.merged(*rival_levels(t))[1]


FUSED_SQL = """WITH r AS (SELECT c_custkey AS k, 'local_db' AS source, c_name AS name, '88' || lpad(CAST(c_custkey AS VARCHAR), 9, '9') AS phone FROM customer UNION ALL SELECT s_suppkey, 'places_overture', s_name, '88' || lpad(CAST(s_suppkey * 3 AS VARCHAR), 9, '9') FROM supplier),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN source = 'places_overture' THEN 2 ELSE 1 END DESC) AS r FROM r)"""


def fused(t) -> DataFrame:
    base = lambda df, key, name, src, off, times: df.select((F.col(key) * 2 + off).alias("idx"), F.lit(src).alias("source"), F.lit("MEDIUM").alias("confidence"), F.col(name).alias("name"), F.concat(F.lit("88"), F.lpad((F.col(key) * times).cast("string"), 9, "9")).alias("phone"))
    rows = base(t("customer"), "c_custkey", "c_name", "local_db", 0, 1).unionByName(base(t("supplier"), "s_suppkey", "s_name", "places_overture", 1, 3))
    members = rows.select("idx", F.floor(F.col("idx") / 2).alias("cluster"))
    order = ["places_overture", "local_db"]
    return resolve.fuse(rows, members, {"name": order, "phone": order})


@query(f"{FUSED_SQL} SELECT k AS cluster, source, name FROM b WHERE r = 1")
def field_fusion_argmax(t):
    return fused(t).where("field = 'name'").select("cluster", "source", F.col("value").alias("name"))


@query(f"{FUSED_SQL} SELECT x.k AS cluster, x.phone AS chosen, y.phone AS other FROM b x JOIN b y ON x.k = y.k AND x.r = 1 AND y.r = 2 WHERE x.phone <> y.phone")
def conflict_lists(t):
    rows = fused(t).where("field = 'phone' and conflict")
    return rows.select("cluster", F.col("value").alias("chosen"), F.explode("alternatives").alias("o")).select("cluster", "chosen", F.col("o")["value"].alias("other"))


@query("""WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '55' ELSE '' END || '88' || CASE WHEN c_custkey % 3 = 0 THEN '9' ELSE '' END || lpad(CAST(c_custkey AS VARCHAR), 8, '3') AS d FROM customer), l AS (SELECT *, CASE WHEN length(d) > 11 AND d LIKE '55%' THEN substr(d, 3) ELSE d END AS loc FROM p)
SELECT c_custkey, CASE WHEN length(loc) IN (10, 11) THEN loc END AS key, coalesce(length(loc) = 11 AND substr(loc, 3, 1) = '9', FALSE) AS mobile, CASE WHEN length(loc) = 11 THEN '(' || substr(loc, 1, 2) || ') ' || substr(loc, 3, 5) || '-' || substr(loc, 8) WHEN length(loc) = 10 THEN '(' || substr(loc, 1, 2) || ') ' || substr(loc, 3, 4) || '-' || substr(loc, 7) ELSE d END AS shown FROM l""")
def phone_normalise(t):
    k = F.col("c_custkey")
    raw = F.concat(F.when(k % 4 == 0, "55").otherwise(""), F.lit("88"), F.when(k % 3 == 0, "9").otherwise(""), F.lpad(k.cast("string"), 8, "3"))
    return t("customer").select("c_custkey", raw.alias("d")).select("c_custkey", ids.phone_key("d").alias("key"), ids.is_mobile("d").alias("mobile"), ids.format_phone("d").alias("shown"))


def _digit_sql(weights: list[int]) -> str:
    total = " + ".join(f"CAST(substr(d, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights))
    return f"(CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END)"


@query(f"""WITH p AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 AS VARCHAR), 14, '1') AS d FROM orders)
SELECT o_orderkey, {_digit_sql(ids.FIRST_WEIGHTS)} = CAST(substr(d, 13, 1) AS INT) AND {_digit_sql([6, *ids.FIRST_WEIGHTS])} = CAST(substr(d, 14, 1) AS INT) AS valid, substr(d, 1, 2) || '.' || substr(d, 3, 3) || '.' || substr(d, 6, 3) || '/' || substr(d, 9, 4) || '-' || substr(d, 13) AS shown FROM p""")
def taxid_check_digits(t):
    d = F.lpad((F.col("o_orderkey") * 7919).cast("string"), 14, "1")
    return t("orders").select("o_orderkey", ids.is_valid_tax_id(d).alias("valid"), ids.format_tax_id(d).alias("shown"))


@query("""WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 10 AS lat, CAST(embedding[2] AS DOUBLE) * 10 AS lon FROM embeddings)
SELECT vec_id, round(2 * 6371000.0 * asin(sqrt(pow(sin(radians(lat - 1) / 2), 2) + cos(radians(1)) * cos(radians(lat)) * pow(sin(radians(lon - 1) / 2), 2))), 3) AS meters, lat BETWEEN -0.51 AND 0.51 AND lon BETWEEN -0.51 AND 0.51 AS inside, CAST(floor(lat / 0.002 + 0.5) AS BIGINT) AS cell FROM p""")
def haversine_bbox(t):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double") * 10
    p = t("embeddings").select("vec_id", at(0).alias("lat"), at(1).alias("lon"))
    lat, lon = F.col("lat"), F.col("lon")
    return p.select("vec_id", F.round(geo.haversine(F.lit(1.0), F.lit(1.0), lat, lon), 3).alias("meters"), geo.in_box(lat, lon, -0.5, -0.5, 0.5, 0.5, 0.01).alias("inside"), geo.cell(lat).cast("long").alias("cell"))


@query("""WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings) SELECT vec_id, abs(x) + abs(y) < 0.2 AND NOT (abs(x) < 0.02 AND abs(y) < 0.02) AS inside FROM p""")
def point_in_polygon(t):
    """A diamond with a square hole."""
    ring = lambda pts: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [*pts, pts[0]]])
    shape = F.array(ring([(0.2, 0), (0, 0.2), (-0.2, 0), (0, -0.2)]), ring([(0.02, 0.02), (-0.02, 0.02), (-0.02, -0.02), (0.02, -0.02)]))
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return t("embeddings").select("vec_id", geo.in_polygon(at(0), at(1), shape).alias("inside"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '^www\\.', '') AS domain FROM pages")
def url_domain(t):
    return t("pages").select("page_id", ids.website_domain("url").alias("domain"))


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, substr(sha256(substr(html, 1, 5000)), 1, 16) AS content_hash, regexp_matches(html, '(?i)<video[\\s>]') AS has_video, regexp_matches(html, '(?i)<form') AS has_form FROM pages")
def html_features(t):
    return t("pages").select("page_id", html.title("html").alias("title"), html.content_hash("html").alias("content_hash"), F.array_contains(html.videos("html"), "vídeo HTML5").alias("has_video"), F.col("html").rlike("(?i)<form").alias("has_form"))


@query("""SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'), lambda e: lower(e))).list_sort() AS emails FROM documents""")
def contact_extraction(t):
    found = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))
    some = F.when(~F.contains("text", F.lit("@")), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.transform(found, F.lower))))
    return t("documents").select("doc_id", some.alias("emails"))


@query()
def page_contacts(t):
    """All features of a page: contacts, profiles, videos, hints, flags (lookbehinds have no SQL twin)."""
    return t("pages").select("page_id", html.page_features("html").alias("f")).select("page_id", "f.*")


@query("SELECT c_custkey, 'Olá ' || c_name || ', de ' || coalesce(n_name, '[city?]') || ': ' || CASE WHEN c_custkey % 2 = 0 THEN 'sim' ELSE '[offer?]' END || ' {other}' AS text, CASE WHEN c_custkey % 2 = 0 THEN [] ELSE ['offer'] END AS missing FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def template_render(t):
    r = text.render_template(F.lit("Olá {name}, de {city}: {offer} {other}"), {"name": F.col("c_name"), "city": F.col("n_name"), "offer": F.when(F.col("c_custkey") % 2 == 0, "sim").otherwise("")})
    return companies(t).select("c_custkey", r["text"].alias("text"), r["missing"].alias("missing"))


@query("SELECT CASE WHEN c_custkey % 6 = 0 THEN 'trade_name' WHEN c_custkey % 10 = 0 THEN 'city' ELSE 'valid' END AS missing, count(*) AS n FROM customer GROUP BY 1")
def import_validation_split(t):
    from ..sources.files import import_error

    rows = t("customer").select(F.when(F.col("c_custkey") % 6 != 0, F.col("c_name")).alias("trade_name"), F.when(F.col("c_custkey") % 10 == 0, " ").otherwise("x").alias("city"), F.lit("CE").alias("state"))
    return rows.groupBy(F.coalesce(import_error(), F.lit("valid")).alias("missing")).agg(n())


@query("""SELECT s_suppkey AS id, CASE WHEN c_custkey IS NULL THEN 'NO_MATCH' WHEN s_suppkey % 5 = 0 THEN 'EXACT_MATCH' WHEN s_suppkey % 3 = 0 THEN 'LIKELY_MATCH' ELSE 'POSSIBLE_DUPLICATE' END AS level FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey""")
def import_dedup_levels(t):
    side = lambda df, key: df.select(F.col(key).alias("id"), F.when(F.col(key) % 5 == 0, F.col(key).cast("string")).alias("tax"), F.lit(None).cast("string").alias("domain"), F.concat(F.lit("88"), F.col(key).cast("string")).alias("phone"), F.when(F.col(key) % 3 == 0, F.concat(F.col(key).cast("string"), F.lit("@x.com"))).alias("email"), F.lit("").alias("name"), F.lit("").alias("city"))
    return resolve.import_matches(side(t("supplier"), "s_suppkey"), side(t("customer"), "c_custkey")).select("id", "level")


def request_log(t) -> DataFrame:
    return t("events").select(F.col("user_id").alias("source"), "ts", F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"), "value")


@query("""WITH e AS (SELECT user_id AS source, event_id AS id, ts, (event_type <> 'error') AS ok FROM events), g AS (SELECT *, sum(ok::INT) OVER (PARTITION BY source ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS island, avg(ok::INT::DOUBLE) OVER (PARTITION BY source ORDER BY ts, id ROWS 19 PRECEDING) AS rate FROM e)
SELECT source, id, round(rate, 9) AS success_rate, CAST(sum((NOT ok)::INT) OVER (PARTITION BY source, island ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures FROM g""")
def breaker_windows(t):
    return health.recent_success(request_log(t)).select("source", "id", F.round("success_rate", 9).alias("success_rate"), F.col("failures").cast("long").alias("failures"))


@query()
def breaker_fold(t):
    """State after all events of a source; tested against a plain fold."""
    return health.breakers(request_log(t))


@query("""WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type <> 'error')
SELECT user_id AS source, round(sum(value * CASE WHEN r = 1 THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, n - r) END), 6) AS latency FROM e GROUP BY 1""")
def moving_latency(t):
    return health.moving_latencies(request_log(t)).select("source", F.round("latency", 6).alias("latency"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def hourly_windows(t):
    return t("events").groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("start"), "event_type").agg(n(), F.round(F.sum("value"), 6).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first, event_id FROM events), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(t):
    out = t("events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(n())
    return out.select("user_id", F.col("w")["start"].cast("timestamp_ntz").alias("start"), F.col("w")["end"].cast("timestamp_ntz").alias("end"), "n")


@query("SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_stage, event_type AS to_stage FROM events")
def stage_history_lag(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("event_id", "user_id", F.lag("event_type").over(w).alias("from_stage"), F.col("event_type").alias("to_stage"))


@query("""SELECT conv_id, max(turn) FILTER (WHERE role = 'assistant') AS turn, length(arg_max(text, turn) FILTER (WHERE role = 'assistant')) AS chars, CASE WHEN arg_max(role, turn) = 'assistant' THEN 'ANSWERED' ELSE 'WAITING' END AS stage FROM conversations GROUP BY 1""")
def thread_last_response(t):
    said = F.when(F.col("role") == "assistant", F.col("turn"))
    return t("conversations").groupBy("conv_id").agg(F.max(said).alias("turn"), F.length(F.max_by("text", said)).cast("long").alias("chars"), F.when(F.max_by("role", "turn") == "assistant", "ANSWERED").otherwise("WAITING").alias("stage"))


@query("SELECT c_custkey, substr(sha256('city=' || c_nationkey || '|niche=' || lower(c_mktsegment) || '|state='), 1, 32) AS key FROM customer")
def cache_key(t):
    parts = {"niche": F.col("c_mktsegment"), "city": F.col("c_nationkey"), "state": F.lit(None).cast("string")}
    return t("customer").select("c_custkey", text.cache_key(parts).alias("key"))


LINKS_SQL = """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey * 2 AS x, l_suppkey * 2 + 1 AS y FROM lineitem), l AS (SELECT x AS a, y AS b FROM e UNION ALL SELECT y, x FROM e),
c(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, min(c.component) FROM c JOIN l ON c.node = l.a JOIN recurring.c AS r ON r.node = l.b WHERE c.component < r.component GROUP BY l.b)
SELECT {} FROM c"""


def links(t) -> DataFrame:
    """All links of parts (even nodes) and suppliers (odd ones)."""
    return t("lineitem").select((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b"))


@query(LINKS_SQL.format("count(*) AS nodes, count(DISTINCT component) AS components"))
def link_nodes(t):
    return connected(links(t)).agg(n("nodes"), F.countDistinct("component").alias("components"))


@query(LINKS_SQL.format("node, component"))
def link_components(t):
    """(node, component) over all links; also tested by brute force, on links of many components."""
    return connected(links(t))


@query()
def lead_qualification(t):
    """Seven dimensions, score, confidence and reasons of every company, its signals taken from its orders."""
    o = t("orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("sources"), F.max("o_orderdate").alias("last_at"), F.count("*").alias("units"))
    df = companies(t).join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    days = F.datediff(F.to_date(F.lit(AS_OF[:10])), F.col("last_at").cast("date")).cast("double")
    given = {
        "segment_fit": (k % 101).cast("int"), "visual": (k % 97).cast("int"), "website": F.when(bal > 0, "w"), "street": F.lit("s"), "city": F.col("n_name"), "sources": F.coalesce(F.col("sources"), F.lit(0)).cast("int"), "verified_days": days,
        "phone_valid": bal > 100, "ticket": F.when(bal > 5000, "HIGH"), "socials": F.when(k % 3 == 0, F.array(F.lit("instagram"), F.lit("facebook"))), "units": F.col("units").cast("int"), "size": F.lit("ME"),
    }
    columns = {c.split(" ")[0]: c.split(" ")[1] for c in qualify.SCHEMA.split(", ")}
    rows = df.select("c_custkey", *[given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])
    return qualify.qualified(rows).select("c_custkey", "lead_score", "confidence", "qualified", F.size("reasons").alias("n_reasons"))
