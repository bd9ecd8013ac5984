"""Users' CSV files in, exports out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.links import map_links

REQUIRED = ["trade_name", "city", "state"]


def read_csv(spark: SparkSession, path: str, mapping: dict[str, str]) -> DataFrame:
    """A file with a header, its columns named by mapping ("__skip__" leaves one out), values trimmed, with row_id in file order."""
    raw = spark.read.option("header", "true").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)
    return raw.select(*[F.trim(F.col(f"`{h}`")).alias(f) for h, f in mapping.items() if f != "__skip__"], F.monotonically_increasing_id().alias("row_id"))


def import_error(required: list[str] = REQUIRED) -> Column:
    """The first required field that is missing; null if none is."""
    return F.coalesce(*[F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(c)) for c in required])


def split_valid(rows: DataFrame, required: list[str] = REQUIRED) -> tuple[DataFrame, DataFrame]:
    return rows.where(import_error(required).isNull()), rows.withColumn("missing", import_error(required)).where("missing is not null")


def export_csv(df: DataFrame, path: str, joiner: str = " | ") -> None:
    """`;`-separated files with a byte order mark at the head of the header, lists joined; one file for each partition of df."""
    flat = [F.array_join(c, joiner).alias(c) if t.startswith("array<string") else F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    out = df.select(*flat)
    out.withColumnRenamed(out.columns[0], "﻿" + out.columns[0]).write.option("header", "true").option("sep", ";").csv(path)


def discovery_rows(results: DataFrame) -> DataFrame:
    """The 29 columns of a search's export, all text, nulls as nothing. profiles: network to address; numbers are written as short as they are."""
    c = F.col
    number = lambda n: F.regexp_replace(c(n).cast("string"), r"\.0$", "")
    profile = lambda n: F.try_element_at("profiles", F.lit(n))
    link = map_links(c("name"), c("street"), c("house_number"), c("neighborhood"), c("city"), c("state"), c("lat"), c("lon"))["search_url"]
    out = {
        "nome": c("name"), "razao_social": c("legal_name"), "cnpj": c("cnpj"), "situacao_cadastral": c("cnpj_status"), "categoria": c("category"), "logradouro": c("street"), "numero": c("house_number"), "bairro": c("neighborhood"), "cidade": c("city"), "uf": c("state"), "cep": c("postcode"),
        "telefone": c("phone"), "outros_telefones": F.array_join(F.filter("phones", lambda p: ~p.eqNullSafe(c("phone"))), " | "), "whatsapp": c("whatsapp"), "email": c("email"), "website": c("website"), **{n: profile(n) for n in ("instagram", "facebook", "tiktok", "linkedin")},
        "latitude": number("lat"), "longitude": number("lon"), "fontes": F.array_join("source_labels", " + "), "confianca": c("confidence"), "completude": c("completeness"), "qualidade": c("quality_label"), "conflitos": F.array_join("conflict_fields", ", "),
        "ja_no_banco": F.when(c("company_id").isNotNull(), "sim").otherwise("não"), "google_maps": link,
    }
    return results.select(*[F.coalesce(v.cast("string"), F.lit("")).alias(k) for k, v in out.items()])


def municipality_suggestions(places: DataFrame, typed: str, limit: int = 8) -> DataFrame:
    """(name, uf) that begin with what is typed, then those that contain it."""
    from ..functions.text import fold_text

    name, part = fold_text("name"), fold_text(F.lit(typed))
    order = F.when(F.startswith(name, part), 0).when(F.contains(name, part), 1)
    return places.withColumn("_o", order).where("_o is not null").orderBy("_o", "name", "uf").limit(limit).drop("_o")
