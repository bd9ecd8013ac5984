"""Events after the first contact: responses, follow-ups, suppression, deletion, the audit log. Every change is new rows or a rewritten column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stage that a response moves a company to.
STAGES = {"INTERESTED": "REPLIED", "MEETING_REQUESTED": "MEETING", "ASKED_PRICE": "REPLIED", "ASKED_DETAILS": "REPLIED"}
OPT_OUT = "OPT_OUT"
EVERY_CHANNEL = "all"


def stage_of(response: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv]), response)


def opt_outs(rows: DataFrame, kind: str) -> DataFrame:
    """Suppression rows (company_id, channel, reason), one a company, of rows that opt out."""
    return rows.where(F.col(kind) == OPT_OUT).select("company_id").distinct().withColumns({"channel": F.lit(EVERY_CHANNEL), "reason": F.lit("opt_out")})


def record_responses(outreach: DataFrame, responses: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outreach with response_type and responded_at, companies with the stage of their last response, suppression rows).

    responses: outreach_id, response_type, responded_at; the last of an outreach counts. A response without a stage moves nothing.
    """
    last = responses.groupBy("outreach_id").agg(F.max_by(F.struct("response_type", "responded_at"), F.struct("responded_at", "response_type")).alias("_r"))
    marked = outreach.join(last, "outreach_id", "left").withColumns({"response_type": F.col("_r")["response_type"], "responded_at": F.col("_r")["responded_at"]}).drop("_r")
    moves = marked.withColumn("_to", stage_of(F.col("response_type"))).where("_to is not null").groupBy("company_id").agg(F.max_by("_to", F.struct("responded_at", "outreach_id")).alias("_to"))
    moved = companies.join(moves, "company_id", "left").withColumn("stage", F.coalesce("_to", "stage")).drop("_to")
    return marked, moved, opt_outs(marked, "response_type")


def complete_followups(followups: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(followups with the status and completed_at of done (followup_id, status, completed_at), suppression rows of opt-outs)."""
    new = done.select("followup_id", F.col("status").alias("_s"), F.col("completed_at").alias("_at"))
    out = followups.join(new, "followup_id", "left").withColumns({"status": F.coalesce("_s", "status"), "completed_at": F.coalesce("_at", "completed_at")})
    return out.drop("_s", "_at"), opt_outs(out.where("_s is not null"), "status")


def append_suppression(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing with the rows of new whose company and channel it doesn't have yet; of repeats in new one stays."""
    fresh = new.groupBy("company_id", "channel").agg(F.min("reason").alias("reason"))
    return existing.unionByName(fresh.join(existing.select("company_id", "channel"), ["company_id", "channel"], "left_anti").select(*existing.columns))


def soft_delete(df: DataFrame, ids: DataFrame, key: str, column: str, at: Column) -> DataFrame:
    """df with column (deleted_at, archived_at) set for the ids; those set before keep their moment."""
    return df.join(ids.select(key).distinct().withColumn("_x", F.lit(True)), key, "left").withColumn(column, F.coalesce(column, F.when(F.col("_x"), at))).drop("_x").select(*df.columns)


def audit(rows: DataFrame, actor: str, action: str, entity: str, key: str, details: list[str], at: Column) -> DataFrame:
    """Audit rows: who did what to which row, with details as JSON."""
    return rows.select(F.lit(actor).alias("actor"), F.lit(action).alias("action"), F.lit(entity).alias("entity"), F.col(key).cast("string").alias("entity_id"), F.to_json(F.struct(*details)).alias("metadata"), at.alias("created_at"))
