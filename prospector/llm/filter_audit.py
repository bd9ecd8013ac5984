"""Operator 12, filter interaction audit: what each filter removes in each order of the filters, by executing their permutation trie.

The paths of the trie are the orders of the filters. Rows that survive a set of filters are the same in whatever order it was
applied, so nodes with equal sets are one state: it is executed once, when depth-first search first comes to it, and later
paths take its counts from the memo. A state is a persisted DataFrame of survivors, made from its parent's by one filter;
while it is held, one aggregation counts what every further filter removes of it, the state's edges. Of n filters there are
2^n states for n! orders, and n persisted DataFrames at most at any time. Rows carry no text there: a part, a flag a filter, and two
labels. Whether a row fails a filter is computed once, before.
"""

from __future__ import annotations

import itertools
import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, table, written

#: Most filters: 64 states and 720 orders.
MOST_FILTERS = 6


def _names(failing: dict[str, Column]) -> list[str]:
    names = list(failing)
    if not 1 <= len(names) <= MOST_FILTERS or any(len(n) != 1 for n in names):
        raise ValueError(f"1 to {MOST_FILTERS} filters, each named by one character")
    return names


def _trie(flags: DataFrame, names: list[str], labels: list[str]) -> DataFrame:
    """Edges of all states, _part, _state, _filter, kept, removed and <label>_lost: one aggregation a state, none repeated."""
    memo: dict[frozenset[str], DataFrame] = {}
    # The same sums in each state, so that its code is compiled once; filters of the state itself remove nothing.
    sums = [F.count("*").alias("_all")]
    for n in names:
        sums += [F.count_if(F.col(f"_{n}")).alias(f"removed_{n}"), *[F.count_if(F.col(f"_{n}") & F.col(f"_{label}")).alias(f"{label}_{n}") for label in labels]]

    def visit(state: frozenset[str], survivors: DataFrame) -> None:
        if state in memo or len(state) == len(names):
            return
        held = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        memo[state] = written(held.groupBy("_part").agg(*sums), "audit-state").withColumn("_state", F.lit("".join(sorted(state))))
        for n in names:
            if n not in state:
                visit(state | {n}, held.where(~F.col(f"_{n}")))
        held.unpersist()

    visit(frozenset(), flags)
    out = None
    for found in memo.values():
        out = found if out is None else out.unionByName(found)
    removed = [F.col(f"removed_{n}") for n in names]
    edge = [F.struct(F.lit(n).alias("_filter"), (F.col("_all") - r).alias("kept"), r.alias("removed"), *[F.col(f"{label}_{n}").alias(f"{label}_lost") for label in labels]) for n, r in zip(names, removed, strict=True)]
    return out.select("_part", "_state", F.explode(F.array(*edge)).alias("_edge")).select("_part", "_state", "_edge.*").where(~F.col("_state").contains(F.col("_filter")))


def filter_audit(rows: DataFrame, failing: dict[str, Column], part: Column, labels: dict[str, Column]) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, <label>_lost for each label, shapley: a row for each part, order and step.

    failing names each filter by one character and gives the condition of failing it; a null condition is passed. A
    filter sees a row alone, so what it removes of a state doesn't hang on the order before it. part is a string column, null
    is the empty string; labels are boolean, null is false. Repeated rows count as often as they come. Columns of rows
    may have any names. kept are the rows left after the step and removed those the step takes; redundant ones fail
    its filter but were gone; unique_fails fail no other filter; shapley is removed summed over all orders, at whatever step
    the filter came. Zeros are given. Empty table: no rows. Parts may be many: nothing of a part is collected.
    """
    names, spark = _names(failing), rows.sparkSession
    flags = rows.select(
        F.coalesce(part.cast("string"), F.lit("")).alias("_part"),
        *[F.coalesce(c, F.lit(False)).alias(f"_{n}") for n, c in failing.items()],
        *[F.coalesce(c, F.lit(False)).alias(f"_{label}") for label, c in labels.items()],
    )
    flags = written(flags, "audit-flags")
    edges = written(_trie(flags, names, list(labels)), "audit-trie")
    fails = sum((F.col(f"_{n}").cast("int") for n in names), F.lit(0))
    alone = [F.count_if(F.col(f"_{n}") & (fails == 1)).alias(n) for n in names]
    wide = flags.groupBy("_part").agg(*alone)
    unique = wide.select("_part", F.explode(F.array(*[F.struct(F.lit(n).alias("_filter"), F.col(f"`{n}`").alias("unique_fails")) for n in names])).alias("_u")).select("_part", "_u.*")
    # Of all orders, |state|! (n - 1 - |state|)! come through the state and go on with the filter.
    n = len(names)
    ways = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)).cast("long") for k in range(n)]), F.length("_state") + 1)
    whole = edges.groupBy("_part", "_filter").agg(F.sum(F.col("removed") * ways).alias("shapley"), F.max(F.when(F.col("_state") == "", F.col("removed"))).alias("_fail"))
    per_filter = unique.join(whole, ["_part", "_filter"])
    steps = [("".join(o), k + 1, "".join(sorted(o[:k])), f) for o in itertools.permutations(names) for k, f in enumerate(o)]
    orders = spark.createDataFrame(steps, "filter_order string, step int, _state string, _filter string")
    every = per_filter.join(F.broadcast(orders), "_filter")  # n! x n rows, at most 4,320
    full = every.join(edges, ["_part", "_state", "_filter"], "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("kept", "removed")]
    lost = [F.coalesce(f"{label}_lost", F.lit(0)).cast("long").alias(f"{label}_lost") for label in labels]
    redundant = (F.col("_fail") - F.coalesce("removed", F.lit(0))).cast("long").alias("redundant")
    return full.select(F.col("_part").alias("part"), "filter_order", "step", *zero, redundant, "unique_fails", *lost, "shapley")


def first_of_text(docs: DataFrame, digest: str = "_digest", id_col: str = "_id") -> DataFrame:
    """docs with _repeats: whether a row of a smaller id has its digest, anywhere in the table.

    Digests are counted before they are joined back, those of one row not at all, and digests of a large share of rows are
    broadcast. Null ids are neither smaller nor larger than others.
    """
    found = docs.groupBy(digest).agg(F.count("*").alias("_n"), F.min(id_col).alias("_least"), F.max(id_col).alias("_most")).where(F.col("_least") < F.col("_most"))
    firsts = written(found.drop("_most"), "audit-firsts")
    return join_counted(docs, firsts, [digest], "_n").withColumn("_repeats", F.coalesce(F.col(id_col) > F.col("_least"), F.lit(False))).drop("_least")


def text_facts(text: Column) -> list[Column]:
    """_words, _distinct, _upper, _length, _marks and _digest of a whole text; null is empty. Words are runs of other than ASCII white space, case matters."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        F.size(words).cast("long").alias("_words"),
        F.size(F.array_distinct(words)).cast("long").alias("_distinct"),
        upper.cast("long").alias("_upper"),
        F.length(text).cast("long").alias("_length"),
        text.rlike("[#$%&*|]").alias("_marks"),
        F.unhex(F.sha2(text, 256)).alias("_digest"),
    ]


def failing_text() -> dict[str, Column]:
    """A: few words; B: few distinct words; C: many capitals; D: marks; E: a text that a smaller id has."""
    return {
        "A": F.col("_words") < 200,
        "B": 100 * F.col("_distinct") < 50 * F.col("_words"),
        "C": 100 * F.col("_upper") > 3 * F.col("_length"),
        "D": F.col("_marks"),
        "E": F.col("_repeats"),
    }


def audit_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five text filters over docs (doc_id, text, lang), with labels (doc_id, quality, toxic).

    Each row of docs counts; a document with several rows of labels is good, or toxic, if one says so. Null and empty
    texts fail A alone, and E after the first. Rows with a null doc_id have no labels and don't take part in E. Empty labels: none is good or toxic.
    """
    facts = written(docs.select(F.col("doc_id").alias("_id"), F.coalesce("lang", F.lit("")).alias("_lang"), *text_facts(F.col("text"))), "audit-facts")
    marked = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    rows = first_of_text(facts).drop("_digest").join(marked.where("_id is not null"), "_id", "left")
    return filter_audit(rows, failing_text(), F.col("_lang"), {"good": F.col("_good") == 1, "toxic": F.col("_toxic") == 1})


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), l AS (
  SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) THEN 'E' ELSE '' END AS fails
  FROM t LEFT JOIN l USING (doc_id)
), m AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), steps AS (
  SELECT filter_order, CAST(s.step AS INTEGER) AS step, filter_order[step] AS filter, left(filter_order, step - 1) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s
), r AS (
  SELECT part, filter_order, step, filter, n, good, toxic, fails,
    contains(fails, filter) AS failing,
    len(list_filter(string_split(before, ''), lambda x: x <> '' AND contains(fails, x))) > 0 AS gone
  FROM m, steps
), counted AS (
  SELECT part, filter_order, step, filter,
    coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed, coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = filter), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND failing), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND failing), 0) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM counted
"""


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_texts(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
