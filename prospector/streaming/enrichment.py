"""Enrichment of the stored base in micro-batches, whose writes a repeated batch doesn't repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.html import page_features
from ..functions.ids import website_domain, website_from_email
from ..functions.text import present
from ..operators.graph import stored

# The tag of rows that were looked at, how many go first, and names of files that are no addresses.
TAG, FIRST = "ENRICHED", 5
NO_MAIL = r"(?i)\.(?:png|jpg|jpeg|gif|webp|svg)$"


def pages_by_site(pages: DataFrame) -> DataFrame:
    """(domain, features) of pages (page_id, url, html): of several pages of a site the one of the smallest id."""
    first = pages.where("html IS NOT NULL").withColumn("domain", website_domain("url")).where("domain IS NOT NULL").groupBy("domain").agg(F.min_by("html", "page_id").alias("html"))
    return first.select("domain", page_features("html").alias("page"))


def enriched(companies: DataFrame, sites: DataFrame, tag: str = TAG) -> DataFrame:
    """companies (id, name, email, website, whatsapp, tags, any more) filled from the pages of their sites (pages_by_site), all tagged.

    The site is the website, or, without one, the domain of the company's own e-mail address, which becomes its website if
    its page is there. Empty whatsapp and email are filled from the page, others stay. found lists what was filled; checked tells that a page
    was read, flags its features. Rows without a site, or whose page is missing, are tagged too, as they were looked at.
    """
    blank = lambda c: present(c).isNull()
    own = website_domain("website")
    candidate = F.when(blank("website"), website_from_email("email", "name"))
    rows = companies.withColumns({"_domain": F.coalesce(own, candidate), "_candidate": candidate})
    # Many companies may share one site, and many have none: those stay out of the join.
    some = rows.where("_domain IS NOT NULL").join(sites.withColumnRenamed("domain", "_domain"), "_domain", "left")
    joined = some.unionByName(rows.where("_domain IS NULL"), allowMissingColumns=True)
    read = F.col("page").isNotNull()
    contact = F.col("page")["contact"]
    mail = F.when(~contact["email"].rlike(NO_MAIL), F.lower(contact["email"]))
    fills: dict[str, Column] = {
        "website": F.when(read & F.col("_candidate").isNotNull(), F.col("_candidate")),
        "whatsapp": F.when(read & blank("whatsapp"), contact["whatsapp"]),
        "email": F.when(read & blank("email"), mail),
    }
    found = F.array_compact(F.array(*[F.when(v.isNotNull(), F.lit(k)) for k, v in fills.items()]))
    tags = F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit(tag)))
    flags = F.when(read, F.struct(F.col("page")["blog"].alias("blog"), F.col("page")["contact_page"].alias("contact_page"), F.col("page")["content_hash"].alias("content_hash")))
    named = [tags.alias("tags") if c == "tags" else F.coalesce(fills[c], F.col(c)).alias(c) if c in fills else F.col(c) for c in companies.columns]
    return joined.select(*named, found.alias("found"), read.alias("checked"), flags.alias("flags"))


def write_batch(batch: DataFrame, batch_id: int, work: Callable[[DataFrame], DataFrame], path: str, rank: str = "rank_score", first: int = FIRST) -> None:
    """work on a micro-batch, the `first` best-ranked rows before the others, each part written in place of what an earlier try of the same batch left."""
    batch = stored(batch.dropDuplicates(["id"]))
    top = stored(batch.orderBy(F.desc_nulls_last(rank), "id").limit(first))  # a handful of rows
    rest = batch.join(F.broadcast(top.select("id")), "id", "left_anti")
    for turn, part in enumerate((top, rest)):
        work(part).write.mode("overwrite").parquet(f"{path}/batch={batch_id}/turn={turn}")


def enrich_stream(pending: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, first: int = FIRST) -> StreamingQuery:
    """Runs work over all pending rows that are there, batch by batch; spark.read.parquet(path) is the table of results. A batch that is tried again, after a failure between its writes too, leaves the same tables."""
    return pending.writeStream.foreachBatch(lambda batch, i: write_batch(batch, i, work, path, first=first)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
