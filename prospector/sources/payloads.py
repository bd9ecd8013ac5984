"""Stored answers of map and registry services as source records. Nothing is fetched: the answers are files of JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OVERPASS = "elements array<struct<type:string,id:long,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"
PHOTON = "features array<struct<geometry:struct<coordinates:array<double>>,properties:struct<osm_type:string,osm_id:long,osm_key:string,osm_value:string,name:string,street:string,housenumber:string,postcode:string,city:string,state:string,district:string>>>"
NOMINATIM = "osm_type string, osm_id long, category string, type string, name string, lat string, lon string, address map<string,string>, extratags map<string,string>"
REGISTRY = "cnpj string, razao_social string, nome_fantasia string, descricao_situacao_cadastral string, cnae_fiscal long, porte string, qsa array<struct<nome_socio:string,qualificacao_socio:string>>"
POI_KEYS = ["amenity", "shop", "tourism", "leisure", "office", "craft", "healthcare"]
SIZES = {"MICRO EMPRESA": "ME", "EMPRESA DE PEQUENO PORTE": "EPP", "DEMAIS": "DEMAIS"}
STATUSES = ["NULA", "ATIVA", "SUSPENSA", "INAPTA", "BAIXADA"]


def tag(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at("tags", F.lit(n))), F.lit("")) for n in names])


def payload_lines(spark: SparkSession, path: str) -> DataFrame:
    """(payload variant, null where the line is no JSON) of files with an answer a line, which many tasks can share; empty lines are left out."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.try_parse_json("value").alias("payload"))


def exploded(payloads: DataFrame, at: str, kind: str, missing: str) -> tuple[DataFrame, DataFrame]:
    """(e, an item of type kind each; counts by reason): items of the array at the path of each payload. Payloads that aren't JSON, or have no such array, are counted, and so are items of another type."""
    items = F.try_variant_get("payload", at, "array<variant>")
    reason = F.when(F.col("payload").isNull(), "not_json").when(items.isNull(), missing)
    each = payloads.select(F.explode(items).alias("v")).select(F.try_variant_get("v", "$", kind).alias("e"))
    bad = payloads.select(reason.alias("reason")).unionByName(each.select(F.when(F.col("e").isNull(), "not_an_item").alias("reason"))).where("reason is not null")
    return each.where("e is not null"), bad.groupBy("reason").agg(F.count("*").alias("n"))


def overpass_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """overpass over files with an answer a line: large files are split over tasks, and a broken line costs itself alone."""
    each, bad = exploded(payload_lines(spark, path), "$.elements", OVERPASS.removeprefix("elements array<").removesuffix(">"), "no_elements")
    records, unnamed = _overpass(each.select("e.*"))
    return records, bad.unionByName(unnamed)


def overpass(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, counts of elements left out by reason) of whole files of one answer each. An element that comes twice counts once; ways and relations have their centre."""
    return _overpass(spark.read.schema(OVERPASS).option("multiLine", "true").json(path).select(F.explode("elements").alias("e")).select("e.*"))


def _overpass(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    e = elements.dropDuplicates(["type", "id"])
    rows = e.withColumns({"name": tag("name", "brand", "operator"), "lat": F.coalesce("lat", F.col("center")["lat"]), "lon": F.coalesce("lon", F.col("center")["lon"])})
    key = F.coalesce(*[F.when(tag(k).isNotNull(), F.concat(F.lit(k + "="), tag(k))) for k in POI_KEYS])
    records = rows.where("name is not null").select(
        F.lit("osm_overpass").alias("source"),
        F.concat_ws("/", "type", "id").alias("source_record_id"),
        "name",
        key.alias("category"),
        tag("addr:street").alias("street"),
        tag("addr:housenumber").alias("house_number"),
        tag("addr:suburb", "addr:neighbourhood").alias("neighborhood"),
        tag("addr:city").alias("city"),
        tag("addr:postcode").alias("postcode"),
        tag("phone", "contact:phone", "contact:mobile").alias("phone"),
        tag("contact:whatsapp").alias("whatsapp"),
        tag("email", "contact:email").alias("email"),
        tag("website", "contact:website", "url").alias("website"),
        tag("opening_hours").alias("opening_hours"),
        "lat",
        "lon",
    )
    return records, rows.where("name is null").groupBy(F.lit("no_name").alias("reason")).agg(F.count("*").alias("n"))


def nominatim(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(NOMINATIM).option("multiLine", "true").json(path).where(F.col("category").isin(*POI_KEYS) & (F.col("name") != "")).dropDuplicates(["osm_type", "osm_id"])
    part = lambda *n: F.coalesce(*[F.try_element_at("address", F.lit(x)) for x in n])
    return rows.select(F.lit("osm_nominatim").alias("source"), F.concat_ws("/", "osm_type", "osm_id").alias("source_record_id"), "name", F.concat_ws("=", "category", "type").alias("category"), part("road").alias("street"), part("house_number").alias("house_number"), part("city", "town", "village").alias("city"), part("postcode").alias("postcode"), F.expr("try_cast(lat as double)").alias("lat"), F.expr("try_cast(lon as double)").alias("lon"))


def photon(spark: SparkSession, path: str) -> DataFrame:
    p, g = F.col("f")["properties"], F.col("f")["geometry"]["coordinates"]
    rows = spark.read.schema(PHOTON).option("multiLine", "true").json(path).select(F.explode("features").alias("f")).where(p["osm_key"].isin(*POI_KEYS) & (p["name"] != ""))
    kind = F.create_map(*[F.lit(x) for x in ("N", "node", "W", "way", "R", "relation")])
    out = rows.select(F.lit("osm_photon").alias("source"), F.concat_ws("/", F.try_element_at(kind, p["osm_type"]), p["osm_id"]).alias("source_record_id"), p["name"].alias("name"), F.concat_ws("=", p["osm_key"], p["osm_value"]).alias("category"), p["street"].alias("street"), p["housenumber"].alias("house_number"), p["city"].alias("city"), p["postcode"].alias("postcode"), F.get(g, F.lit(1)).alias("lat"), F.get(g, F.lit(0)).alias("lon"))
    return out.dropDuplicates(["source_record_id"])


def registry_patch(spark: SparkSession, path: str) -> DataFrame:
    """What the registry's answer adds to a business: known statuses only, the activity code as it is written, at most ten partners."""
    rows = spark.read.schema(REGISTRY).option("multiLine", "true").json(path)
    status = F.upper("descricao_situacao_cadastral")
    activity = F.regexp_replace(F.lpad(F.col("cnae_fiscal").cast("string"), 7, "0"), r"^(\d{4})(\d)(\d{2})$", "$1-$2/$3")
    size = F.try_element_at(F.create_map(*[F.lit(x) for kv in SIZES.items() for x in kv]), F.upper("porte"))
    return rows.select("cnpj", F.col("razao_social").alias("legal_name"), F.nullif("nome_fantasia", F.lit("")).alias("trade_name"), F.when(status.isin(*STATUSES), status).alias("status"), activity.alias("activity"), size.alias("size"), F.slice("qsa", 1, 10).alias("partners"))
