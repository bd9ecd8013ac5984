"""Operator 3, line dedup: lines that recur across documents stay only in the document with the largest id.

DataFrame functions only. Lines are exploded to fixed-size fingerprints (document, position, 128-bit hash of the
normalised line), never to text; distinct documents are counted per hash with partial aggregation before the shuffle,
so a line that sits in a third of all documents is one short row per map task when it reaches its reducer. The frequent
hashes come back as a written table; the few hashes that hold more than a ten-thousandth of all lines are joined by broadcast,
the others by a shuffle.
Texts move at most once, by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, join_counted, lower_ascii, table, written

NO_ID = -(2**63)


def _cut(docs: DataFrame, min_chars: int, min_docs: int, id_col: str, text_col: str) -> DataFrame:
    """_row (a struct of docs' columns), _text (null as empty), _lines, _cuts (sorted places of the lines that go, or null), _kept."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).withColumn("_text_id", F.xxhash64("_text"))
    key = lower_ascii(F.btrim("line", F.lit(ASCII_SPACE)))
    lines = (
        rows.select("_id", "_text_id", F.posexplode(F.split("_text", "\n")).alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .select("_id", "_text_id", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select("_id", "_text_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    lines = written(lines, "line-hashes")
    frequent = lines.groupBy("h1", "h2").agg(F.countDistinct("_id").alias("n"), F.max("_id").alias("keeper"), F.count("*").alias("copies")).where(F.col("n") >= min_docs)
    frequent = written(frequent.select("h1", "h2", "keeper", "copies"), "frequent-lines")
    hit = join_counted(lines, frequent, ["h1", "h2"], "copies", "inner").where(F.col("_id") < F.col("keeper"))
    dropped = hit.groupBy("_id", "_text_id").agg(F.array_sort(F.collect_set("pos")).alias("_cuts"))
    # What stays of n lines is the stretches between the cuts; copying them is linear in the lines, however many are cut.
    cut = rows.join(dropped, ["_id", "_text_id"], "left").withColumn("_lines", F.split("_text", "\n"))
    edges = F.arrays_zip(F.concat(F.array(F.lit(-1)), F.col("_cuts")).alias("a"), F.concat(F.col("_cuts"), F.array(F.size("_lines"))).alias("b"))
    kept = F.flatten(F.transform(edges, lambda e: F.slice("_lines", e["a"] + 2, e["b"] - e["a"] - 1)))
    return cut.withColumn("_kept", F.when(F.col("_cuts").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n")))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""One row per row of docs: doc_id, n_lines, n_dropped, kept_text.

    A line's key is the line stripped of `[\x20\x09-\x0D]` with A-Z lower-cased; keys of at least min_chars code points
    found in at least min_docs documents lose their lines except in the largest id that holds them.

    Null or empty text: one empty line, kept. Rows that repeat an id count as one document; each is cut on its own. Null
    ids count together as one document, smaller than all others. Other columns of docs are not used. Empty table: no rows.
    """
    return _cut(docs, min_chars, min_docs, id_col, text_col).select(
        F.col("_row")[id_col].alias("doc_id"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.when(F.col("_cuts").isNull(), 0).otherwise(F.size("_cuts")).cast("long").alias("n_dropped"),
        F.col("_kept").alias("kept_text"),
    )


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines taken out that line_dedup drops; all other columns, rows and texts (null ones too) as they were."""
    cut = _cut(docs, min_chars, min_docs, id_col, text_col)
    return cut.select(*[F.when(F.col("_cuts").isNull(), F.col("_row")[c]).otherwise(F.col("_kept")).alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.line AS line, u.pos AS pos
  FROM documents, LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos) u
), keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT k.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE coalesce(k.doc_id <> f.keeper, FALSE)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE NOT coalesce(k.doc_id <> f.keeper, FALSE)), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON k.key = f.key GROUP BY k.doc_id
"""
