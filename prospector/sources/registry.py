"""Open company registry: headerless files joined to business records. Two scans, a semi-join and broadcast look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import compact_date
from ..functions.ids import digits, format_activity, repair_mobile
from ..functions.text import fold_text, present, title_city

ESTABLISHMENT = "root order check_digits branch trade_name status_code status_date reason foreign_city country start_date activity secondary_activities street_type street number complement district postcode uf municipality area1 phone1 area2 phone2 fax_area fax email special_status special_date".split()
COMPANY = "root legal_name legal_nature responsible capital size_code federative_entity".split()
PARTNER = "root kind name id qualification entry_date country representative_id representative_name representative_qualification age_band".split()
SIMPLES = "root simples simples_in simples_out mei mei_in mei_out".split()
# Codes of status and size.
STATUS = {"01": "NULA", "02": "ATIVA", "03": "SUSPENSA", "04": "INAPTA", "08": "BAIXADA"}
SIZE = {"01": "ME", "03": "EPP", "05": "DEMAIS"}
MOST_PARTNERS = 10


def read_raw(spark: SparkSession, path: str | list[str], columns: list[str], ordered: bool = False) -> DataFrame:
    """`;`-separated, quoted, latin-1 text without a header; short rows are left out, blanks are null. ordered adds row_id, in file order."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_bad"]])
    raw = spark.read.schema(schema).option("sep", ";").option("quote", '"').option("escape", '"').option("encoding", "ISO-8859-1").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    return raw.where(F.col("_bad").isNull()).select(*[present(c).alias(c) for c in columns], *([F.monotonically_increasing_id().alias("row_id")] if ordered else []))


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    return read_raw(spark, path, ["code", "name"])


def code_map(codes: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), c)


def filter_establishments(rows: DataFrame, uf: str | list[str] | None = None, municipality: str | list[str] | None = None, statuses: list[str] | None = None, activities: list[str] | None = None) -> DataFrame:
    """By states, municipality codes, status codes, and activity codes (primary or one of the secondary ones)."""
    keep = F.lit(True)
    if uf:
        keep = keep & F.col("uf").isin(*[u.upper() for u in ([uf] if isinstance(uf, str) else uf)])
    if municipality:
        keep = keep & F.col("municipality").isin(*([municipality] if isinstance(municipality, str) else municipality))
    if statuses:
        keep = keep & F.col("status_code").isin(*statuses)
    if activities:
        secondary = F.coalesce(F.arrays_overlap(F.split("secondary_activities", " *, *"), F.array(*map(F.lit, activities))), F.lit(False))
        keep = keep & (F.col("activity").isin(*activities) | secondary)
    return rows.where(keep)


def municipality_code(lookup: DataFrame, city: str) -> DataFrame:
    return lookup.where(fold_text("name") == fold_text(F.lit(city))).select("code")


def businesses(establishments: DataFrame, companies: DataFrame, partners: DataFrame | None = None, simples: DataFrame | None = None, municipalities: DataFrame | None = None) -> DataFrame:
    """One record per establishment. The big files are reduced by a semi-join on the roots before they are joined; of repeated roots the last row counts (by row_id where companies have it, else by name); at most ten partners are kept."""
    roots = establishments.select("root").distinct()
    own = companies.join(roots, "root", "left_semi").groupBy("root").agg(F.max_by(F.struct("legal_name", "size_code", "capital"), "row_id" if "row_id" in companies.columns else "legal_name").alias("c"))
    out = establishments.join(own, "root", "left")
    if simples is not None:
        out = out.join(simples.join(roots, "root", "left_semi").groupBy("root").agg(F.max(F.col("mei") == "S").alias("is_mei")), "root", "left")
    else:
        out = out.withColumn("is_mei", F.lit(None).cast("boolean"))
    if partners is not None:
        first = F.row_number().over(W.partitionBy("root").orderBy("name", "qualification"))
        few = partners.join(roots, "root", "left_semi").where("name is not null").withColumn("_r", first).where(F.col("_r") <= MOST_PARTNERS)
        out = out.join(few.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("name", "qualification"))).alias("partners")), "root", "left")
    else:
        out = out.withColumn("partners", F.lit(None).cast("array<struct<name:string,qualification:string>>"))
    if municipalities is not None:
        out = out.join(F.broadcast(municipalities.select(F.col("code").alias("municipality"), title_city("name").alias("city"))), "municipality", "left")  # some six thousand rows
    else:
        out = out.withColumn("city", F.col("municipality"))
    telephone = lambda area, number: F.when(F.col(number).isNotNull(), F.concat(F.coalesce(digits(area), F.lit("")), repair_mobile(digits(number))))
    return out.select(
        F.concat("root", "order", "check_digits").alias("cnpj"),
        F.coalesce("trade_name", F.col("c")["legal_name"]).alias("name"),
        F.col("trade_name"),
        F.col("c")["legal_name"].alias("legal_name"),
        code_map(STATUS, F.lpad("status_code", 2, "0")).alias("status"),
        F.when(F.coalesce("is_mei", F.lit(False)), "MEI").otherwise(code_map(SIZE, F.lpad(F.col("c")["size_code"], 2, "0"))).alias("size"),
        compact_date("start_date").alias("opened_at"),
        format_activity("activity").alias("activity"),
        F.transform(F.split("secondary_activities", " *, *"), format_activity).alias("secondary_activities"),
        F.concat_ws(" ", "street_type", "street").alias("street"),
        F.col("number").alias("house_number"),
        F.col("district").alias("neighborhood"),
        "postcode",
        "city",
        F.col("uf").alias("state"),
        F.array_compact(F.array(telephone("area1", "phone1"), telephone("area2", "phone2"))).alias("phones"),
        F.lower("email").alias("email"),
        F.coalesce("partners", F.array().cast("array<struct<name:string,qualification:string>>")).alias("partners"),
    )


def counters(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("n"), F.count_if(F.size("phones") > 0).alias("with_phone"), F.count_if(F.col("email").isNotNull()).alias("with_email"), F.count_if(F.col("trade_name").isNull()).alias("without_trade_name"))


def niche_of(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """records with industry_id: the primary activity before secondary ones, the workspace's mapping before the global one. mapping: activity, industry_id, workspace_id (null: global)."""
    codes = F.concat(F.array("activity"), F.coalesce("secondary_activities", F.array().cast("array<string>")))
    each = records.select("cnpj", F.posexplode(codes).alias("ord", "activity")).join(mapping, "activity")
    best = each.groupBy("cnpj").agg(F.min_by("industry_id", F.struct("ord", F.col("workspace_id").isNull().alias("all"), "industry_id")).alias("industry_id"))
    return records.join(best, "cnpj", "left")
