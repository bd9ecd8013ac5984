"""Imports that join the pool as they are accepted, and a discovery's results going into the base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import stored
from .resolve import import_matches, match_keys

SURE = ["EXACT_MATCH", "LIKELY_MATCH"]


def import_pool(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, accepted, level) of incoming rows taken in order of id: a row is refused if it surely matches (EXACT or LIKELY) an existing one or an incoming one accepted before it; level is its best against the existing.

    Order decides only between incoming rows that share a sure key. Rounds decide them: a row that is the first undecided
    one of all its keys is accepted, and refuses the later rows of these keys. No pairs are made: a key that thousands
    share is an aggregate of one row, whoever holds it. The number of rounds is the longest chain of rows that each hang on
    the one before. Both sides: id (not null, no repeats) and the comparable forms that `match_keys` reads.
    """
    against = stored(import_matches(incoming, existing).select("id", "level"))
    pending = incoming.join(against.where(F.col("level").isin(*SURE)), "id", "left_anti")
    keys = match_keys(pending, least=2)
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    open_ = stored(keys.select("id", "key").join(shared, "key", "left_semi"))
    accepted = stored(pending.select("id").join(open_.select("id").distinct(), "id", "left_anti"))
    while not open_.isEmpty():
        first = open_.groupBy("key").agg(F.min("id").alias("first"))
        held = stored(open_.join(first, "key"))
        free = stored(held.groupBy("id").agg(F.bool_and(F.col("id") == F.col("first")).alias("free")).where("free").select("id"))
        decided = held.join(free.select(F.col("id").alias("first")), "first", "left_semi").select("id").distinct()  # the accepted and those they refuse
        accepted = stored(accepted.unionByName(free))
        open_ = stored(held.select("id", "key").join(decided, "id", "left_anti"))
    return against.join(accepted.withColumn("_ok", F.lit(True)), "id", "left").select("id", F.coalesce("_ok", F.lit(False)).alias("accepted"), "level")


def discovery_import(results: DataFrame, companies: DataFrame, fill: list[str]) -> tuple[DataFrame, DataFrame]:
    """(companies complemented by results and with new ones, one audit-like row (id, outcome, company_id) per result).

    results: id, company_id (null if unknown), the forms that `match_keys` reads, and the fields of fill; companies: id, these forms, fill, tags.
    A result that names a company, or surely matches one, complements its empty fields (the smallest id where several do).
    Others are created, tagged POSSIBLE_DUPLICATE where something matches in part.
    """
    found = import_matches(results.where("company_id is null"), companies)
    marked = results.join(found, "id", "left").withColumn("target", F.coalesce("company_id", F.when(F.col("level").isin(*SURE), F.col("match_id"))))
    marked = stored(marked)
    known = marked.where("target is not null")
    patch = known.groupBy(F.col("target").alias("id")).agg(*[F.min_by(c, F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.col("id"))).alias(f"_{c}") for c in fill])
    changed = companies.join(patch, "id", "left").withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")) for c in fill}).select(*companies.columns)
    new = marked.where("target is null")
    tags = F.when(F.col("level") == "POSSIBLE_DUPLICATE", F.array(F.lit("POSSIBLE_DUPLICATE"))).otherwise(F.array().cast("array<string>"))
    created = new.withColumn("tags", tags).select(*companies.columns)
    outcome = F.when(F.col("company_id").isNotNull(), "EXISTING").when(F.col("target").isNotNull(), "COMPLEMENTED").when(F.col("level") == "POSSIBLE_DUPLICATE", "CREATED_TAGGED").otherwise("CREATED")
    return changed.unionByName(created), marked.select("id", outcome.alias("outcome"), F.coalesce("target", "id").alias("company_id"))


def create_company(new: DataFrame, companies: DataFrame) -> DataFrame:
    """new with refused: whether an existing company surely matches; the caller appends the others."""
    return new.join(import_matches(new, companies).select("id", "level"), "id", "left").withColumn("refused", F.col("level").isin(*SURE))


def reconcile(results: DataFrame, prefix: str = "osm_") -> DataFrame:
    """Results that a source of the map has."""
    return results.where(F.exists("sources", lambda s: s.startswith(prefix)))


def onto_baseline(baseline: DataFrame, refreshed: DataFrame, source: str) -> DataFrame:
    """Source records with one source's replaced by its refreshed ones; resolution then runs on the whole again."""
    return baseline.where(F.col("source") != source).unionByName(refreshed.where(F.col("source") == source))


def children_of(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Dependent rows whose parent was written."""
    return children.join(parents.select(key).distinct(), key, "left_semi")
