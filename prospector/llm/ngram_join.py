"""Operator 6, n-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles, as 64-bit hashes; equal sets are one class from the start. The join goes:

1. Rule out. Over a fixed part of the hash space, the tokens that only one class has are counted (one shuffle of hashes
   with partial aggregation). A class with more unique tokens than a link may miss has no link. What is left, near-copies
   and little else, is tokenised again, and ruled out once more by all its tokens.
2. Group. Classes are partitioned into groups of similar ones: those of equal smallest hash are verified against one
   leader, in a few rounds with other hashes, and what these links connect is a group; whatever is left is a group of one.
   A group is never gathered in one place, however large.
3. Token-group matrix. Tokens are ordered from rare to frequent, and of each class only the first ones are kept that a
   link can't all miss. Each group stores the union of its members' such tokens: rows (token, group). A class is compared
   only with the groups with which it shares a cell, first with the leader; of two groups the smaller one asks. A cell
   tells how many tokens a member has from this one on: no more can be common where it is the first common one. Parity
   sketches of both sets, of a fixed size, bound their overlap before a pair is made.
4. Open. Where the leader didn't link and the two aren't connected yet, the overlap of the class with the union of all
   tokens of each chunk of the group bounds its similarity with every member; only chunks whose bound reaches the
   threshold are opened, the likeliest first, and all their members verified.

A group is connected, so links inside it add nothing to components; every other link is found: results are exact.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HOT_KEYS, join_counted, slices, strings, table, written
from .components import components
from .words import NOT_SPACE, shingles, words

NO_ID = 2**63 - 1
#: Part of the hash space whose tokens are counted over all documents.
PROBE = 0.3
#: Rounds of grouping by other hashes.
ROUNDS = 5
#: Sets of a bucket differ in size by a factor of exp(BAND) at most.
BAND = 0.12
#: Members of a group whose tokens are united and opened together, and the tokens that they have together; fewer of long texts.
CHUNK, CHUNK_TOKENS = 64, 1 << 20
#: Candidates' ids are broadcast up to so many bytes; beyond, the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Rows of one token that a task joins at most, about.
HOT_ROWS = 10_000
#: Longs of a set's parity sketch.
SKETCH = 8


def token_sets(docs: DataFrame, size: int, probe: float | None) -> DataFrame:
    """id, n, set (16-byte fingerprint of the sorted token set), tokens: all, or those in the first part `probe` of the hash space.

    Without probe also sketch: whether an odd number of tokens falls on each of 64 * SKETCH bits.
    docs: id long, text string, and want (binary) if only rows whose fingerprint it is are asked for.
    """
    limit = np.uint64(int(probe * 2**64)) if probe else None
    wanted = "want" in docs.columns

    def run(batches):
        for batch in batches:
            texts = strings(batch.column("text"))
            for a, b in slices(texts):
                w = words(texts.slice(a, b - a), NOT_SPACE)
                all_, begin = shingles(w, size)
                n, sets, tokens, sketch = [], [], [], []
                for k in range(b - a):
                    own = np.sort(all_[begin[k] : begin[k + 1]])
                    if len(own) > 1:
                        own = own[np.concatenate([[True], own[1:] != own[:-1]])]
                    n.append(len(own))
                    sets.append(xxhash.xxh3_128_digest(own.tobytes()))
                    if limit is None:
                        odd = np.bincount((own % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
                        sketch.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                    tokens.append((own if limit is None else own[: np.searchsorted(own, limit)]).view(np.int64))
                at = np.zeros(len(tokens) + 1, np.int32)
                np.cumsum([len(t) for t in tokens], out=at[1:])
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64)))
                columns = {"id": batch.column("id").slice(a, b - a), "n": pa.array(n, pa.int32()), "set": pa.array(sets, pa.binary()), "tokens": lists}
                if limit is None:
                    columns["sketch"] = pa.array(sketch, pa.list_(pa.int64()))
                out = pa.RecordBatch.from_pydict(columns)
                if wanted:
                    out = out.filter(pa.array([x == y for x, y in zip(sets, batch.column("want").slice(a, b - a).to_pylist(), strict=True)]))
                yield out

    return docs.mapInArrow(run, "id long, n int, set binary, tokens array<long>" + (", sketch array<long>" if limit is None else ""))


def reaches(common: Column, n: Column, m: Column, percent: int) -> Column:
    return common * 100 >= (n + m - common) * percent


def possible(n: Column, known: Column, m: Column, known_m: Column, percent: int) -> Column:
    """Whether sets of n and m tokens can link at all: they have in common at most the known tokens of either."""
    return F.least(known, known_m) * (100 + percent) >= (n + m) * percent


def alike(n: Column, sketch: Column, m: Column, other: Column, percent: int) -> Column:
    """Whether sets of n and m tokens can link by their sketches: every bit in which these differ is a token that only one set has."""
    differ = reduce(Column.__add__, [F.bit_count(sketch[i].bitwiseXOR(other[i])) for i in range(SKETCH)])
    return (n + m - differ) * (100 + percent) >= (n + m) * 2 * percent


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b of sets' ids, any more columns), those that link; the sizes let most others go unread."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta"), F.col("n").alias("na")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"), F.col("n").alias("nb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    possible = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return both.where(possible).where(reaches(common, F.col("na"), F.col("nb"), percent)).select("a", "b", *rest)


def _candidates(base: DataFrame, classes: DataFrame, probes: DataFrame, size: int, percent: int) -> DataFrame:
    """id, n, tokens, sketch of the classes that could link with another, by the unique tokens they have."""
    unique = probes.groupBy("token").agg(F.min("set").alias("set"), F.max("set").alias("other")).where("set = other").groupBy("set").agg(F.count("*").alias("unique"))
    open_ = classes.where("n > 0").join(unique, classes["key"] == unique["set"], "left").where((F.col("n") - F.coalesce("unique", F.lit(0))) * 100 >= F.col("n") * percent)
    open_ = written(open_.select(F.col("rep").alias("id"), classes["set"].alias("want")), "open-classes")
    if open_.count() * 48 <= BROADCAST_BYTES:
        open_ = F.broadcast(open_)
    sets = token_sets(base.join(open_, "id").select("id", "text", "want"), size, None).dropDuplicates(["set"])
    return written(sets.select("id", "n", "tokens", "sketch"), "token-sets")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """id, n, known, prefix: known tokens are those that another set has too; prefix is the rarest of them, as many as a link can't all miss."""
    each = sets.select("id", "n", F.explode("tokens").alias("token"))
    shared = written(each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").withColumn("rows", F.col("df")), "shared-tokens")
    listed = join_counted(each, shared, ["token"], "rows", "inner", HOT_ROWS).groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("by_df"))
    known = F.size("by_df")
    free = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1 - (F.col("n") - known)  # of the prefix, without the unique tokens that lead it
    return listed.where((known * 100 >= F.col("n") * percent) & (free > 0)).select("id", "n", known.alias("known"), F.transform(F.slice("by_df", 1, free), lambda s: s["token"]).alias("prefix"))


def _stars(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between sets and the leaders of their buckets: in each round a bucket is the sets of equal smallest hash and about equal size; its leaders are the set of the smallest id and the smallest set, which has least of its own. Every set is in every round, so a few rounds join the stars of a group of similar sets into one component."""
    pairs = []
    for k in range(ROUNDS):
        seed = F.array_min("tokens") if k == 0 else F.array_min(F.transform("tokens", lambda t, k=k: F.xxhash64(F.lit(k), t)))
        band = F.floor(F.log("n") / BAND + k / ROUNDS)  # bounds of bands move from round to round
        pairs.append(sets.select("id", "n", F.lit(k).alias("k"), F.xxhash64(seed, band).alias("seed")))
    seeded = written(reduce(DataFrame.unionByName, pairs), "seeds")
    leaders = written(seeded.groupBy("k", "seed").agg(F.array_distinct(F.array(F.min("id"), F.min(F.struct("n", "id"))["id"])).alias("leaders"), F.count("*").alias("of")).where("of > 1"), "leaders")
    near = join_counted(seeded.select("id", "k", "seed"), leaders, ["k", "seed"], "of", "inner").select(F.col("id").alias("a"), F.explode("leaders").alias("b")).where("a <> b").distinct()
    return written(_verified(written(near, "leader-pairs"), sets, percent), "stars")


def _by_token(queries: DataFrame, cells: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """queries joined with cells on token; the queries of a token that has more than `limit` are dealt over several tasks, and its cells go to each of them.

    A token counts as hot from `limit` or a HOT_KEYS-th of all queries on, so at most HOT_KEYS of them are broadcast.
    """
    counts = written(queries.groupBy("token").agg(F.count("*").alias("rows")), "token-counts")
    limit = max(limit, (counts.agg(F.sum("rows")).first()[0] or 0) // HOT_KEYS)
    hot = counts.where(F.col("rows") > limit).select("token", F.ceil(F.col("rows") / limit).cast("int").alias("deals"))
    if hot.isEmpty():
        return queries.join(cells, "token")
    deals = F.coalesce("deals", F.lit(1))
    asked = queries.join(F.broadcast(hot), "token", "left").withColumn("deal", F.pmod(F.xxhash64("id"), deals).cast("int")).drop("deals")
    dealt = cells.join(F.broadcast(hot), "token", "left").withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("deals")
    return asked.join(dealt, ["token", "deal"]).drop("deal")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, label) after more links (a, b): only the links between different labels are connected, the rest stays."""
    of = lambda c, out: labels.select(F.col("id").alias(c), F.col("label").alias(out))
    more = components(links.join(of("a", "la"), "a").join(of("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    if more.isEmpty():
        return labels
    upper = more.select(F.col("node").alias("label"), F.col("label").alias("upper"))
    return written(labels.join(upper, "label", "left").select("id", F.coalesce("upper", "label").alias("label")), "labels")


def _labels(sets: DataFrame, percent: int) -> DataFrame:
    """(id, label) for every set that could link: label is the smallest id that links connect it with."""
    prefixes = written(_prefixes(sets, percent), "prefixes")
    sets = written(sets.join(prefixes.select("id", "known", F.size("prefix").alias("cells")), "id"), "token-sets")
    leader = components(_stars(sets, percent)).select(F.col("node").alias("id"), F.col("label").alias("leader"))
    groups = written(sets.select("id", "n", "known", "cells", "sketch").join(leader, "id", "left").withColumn("leader", F.coalesce("leader", "id")), "groups")
    labels = groups.select("id", F.col("leader").alias("label")).distinct()  # classes may repeat an id
    least = F.min(F.struct("n", "id", "sketch"))
    sizes = written(groups.groupBy("leader").agg(F.count("*").alias("size"), least["id"].alias("rep"), least["n"].alias("least"), least["sketch"].alias("rep_sketch"), F.max("n").alias("most"), F.max("known").alias("most_known"), F.sum("cells").alias("cells")), "group-sizes")
    # left: the known tokens from this one on, in the order of all prefixes.
    rows = prefixes.select("id", F.posexplode("prefix").alias("pos", "token")).join(groups.drop("cells"), "id").withColumn("left", F.col("known") - F.col("pos")).drop("pos")
    matrix = rows.groupBy("token", "leader").agg(F.max("left").alias("most_left"))
    tokens = join_counted(matrix, sizes, ["leader"], "cells", "inner")
    # Of two groups the smaller one asks, row by row; the larger one answers as a whole.
    queries = join_counted(rows.withColumnRenamed("leader", "own"), sizes.select(F.col("leader").alias("own"), F.col("size").alias("own_size"), "cells"), ["own"], "cells", "inner")
    near = (F.col("most") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("least") * percent) & possible(F.col("n"), F.col("known"), F.col("least"), F.col("most_known"), percent)
    asks = (F.col("own") != F.col("leader")) & (F.struct("own_size", "own") < F.struct("size", "leader"))
    by_rep = alike(F.col("n"), F.col("sketch"), F.col("least"), F.col("rep_sketch"), percent)
    first = possible(F.col("n"), F.col("left"), F.col("least"), F.col("most_left"), percent)
    cells = _by_token(queries, tokens).where(near & asks & first & ((F.col("size") > 1) | by_rep))
    own = ("n", "known", "sketch", "size", "rep")  # alike in all rows of an id and a leader
    asked = written(cells.withColumn("by_rep", by_rep).groupBy("id", "leader").agg(*[F.first(c).alias(c) for c in (*own, "by_rep")]), "asked")
    labels = _merged(labels, _verified(asked.where("by_rep").select(F.col("id").alias("a"), F.col("rep").alias("b")), sets, percent))
    still = _unconnected(asked.where("size > 1"), labels)
    # Chunks of the groups that are asked for, of about CHUNK members of nearly one size, and the union of their tokens.
    step = F.floor(F.log("n") / 0.02).cast("int")
    members = written(still.select("leader").distinct().join(groups, "leader").select("leader", "id", "n", "known", "sketch", step.alias("step")), "members")
    counted = members.groupBy("leader", "step").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / CHUNK_TOKENS)).alias("parts"))
    chunks = written(members.join(counted, ["leader", "step"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts"), "chunks")
    at = ["leader", "step", "chunk"]
    bounds = chunks.groupBy(*at).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("known").alias("most_known"))
    fits = (F.col("most") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("least") * percent) & possible(F.col("n"), F.col("known"), F.col("least"), F.col("most_known"), percent)
    looked = written(still.join(bounds, "leader").where(fits).select("id", "n", *at, "least"), "looked-at")
    unions = chunks.join(looked.select(*at).distinct(), at, "left_semi").join(sets.select("id", "tokens"), "id").select(*at, F.explode("tokens").alias("token")).distinct().groupBy(*at).agg(F.collect_list("token").alias("union"))
    common = F.size(F.array_intersect("tokens", "union"))
    bounded = looked.join(sets.select("id", "tokens"), "id").join(unions, at).withColumn("common", common).where(F.col("common") * (100 + percent) >= (F.col("n") + F.col("least")) * percent)
    # The likeliest chunk first; then, for those that it doesn't connect, twice as many each time, until none is left.
    turn = F.row_number().over(W.partitionBy("id", "leader").orderBy(F.desc("common"), "step", "chunk"))
    todo = written(bounded.select("id", *at, F.floor(F.log2(turn)).cast("int").alias("turn")), "qualifying")
    last = todo.agg(F.max("turn")).first()[0]
    inside = groups.select("id", "n", "known", "sketch")
    for k in range(-1 if last is None else last + 1):
        todo = _unconnected(todo.where(F.col("turn") >= k), labels) if k else todo
        if k and todo.isEmpty():
            break
        now = todo.where(F.col("turn") == k).select("id", *at).join(inside, "id")
        far = chunks.select(F.col("id").alias("b"), *at, F.col("n").alias("m"), F.col("known").alias("known_m"), F.col("sketch").alias("other"))
        can = possible(F.col("n"), F.col("known"), F.col("m"), F.col("known_m"), percent) & alike(F.col("n"), F.col("sketch"), F.col("m"), F.col("other"), percent)
        pairs = now.join(far, at).where((F.col("id") != F.col("b")) & can)
        pairs = written(pairs.select(F.col("id").alias("a"), "b"), "opened")
        labels = _merged(labels, _verified(pairs, sets, percent))
    return labels


def _unconnected(asked: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of asked (id, leader, ...) whose two sides no links connect yet."""
    of = lambda c, out: labels.select(F.col("id").alias(c), F.col("label").alias(out))
    return written(asked.join(of("id", "la"), "id").join(of("leader", "lb"), "leader").where("la <> lb").select(*asked.columns), "still")


def ngram_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a document's set holds its distinct runs of `size` words, or its
    whole sequence if it has fewer. Two documents link when 100 * intersection >= percent * union. component_id is the
    smallest doc_id that links reach. Null text, or none but white space: an empty set that links with nothing, and
    component_id is the own id. Rows that repeat an id are one document to the components (each keeps its own n_shingles);
    a null id is larger than all others. Other columns are not read.
    """
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    key = F.xxhash64("set")
    first = written(token_sets(base, size, PROBE).withColumn("key", key), "sets")
    classes = written(first.groupBy("set").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("key").alias("key")), "classes")
    probes = first.select(F.col("key").alias("set"), F.explode("tokens").alias("token"))
    sets = _candidates(base, classes, probes, size, percent)
    label = _labels(sets, percent)
    named = written(classes.join(label.toDF("rep", "label"), "rep", "left").select("set", F.col("n").alias("size"), F.coalesce("label", "rep").alias("label")), "named")
    out = first.select("id", "n", "set").join(named, "set")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("label"))
    shown = lambda c: F.when(c == NO_ID, None).otherwise(c)
    return out.select(shown(F.col("id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), shown(component).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of linked documents, that of the smallest id; rows without words, and null ids, stay.

    Rows that repeat an id and its text count as copies: one of them stays.
    """
    own = ngram_components(docs, size, percent, id_col, text_col)
    gone = written(own.where("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct(), "near-copies")
    kept = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    repeated = written(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col), "repeated-ids")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, id_col, "left_semi").select(*docs.columns)
    wordy = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return kept.join(repeated, id_col, "left_anti").select(*docs.columns).unionByName(again.where(~wordy)).unionByName(again.where(wordy).dropDuplicates([id_col, text_col]))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), size=4, percent=85)


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), tokens AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 3), ' ') AS token FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS k FROM d WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id
), sets AS (
  SELECT doc_id, md5(string_agg(token, chr(10) ORDER BY token)) AS print FROM tokens GROUP BY doc_id
), classes AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY print) AS rep FROM sets
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM tokens x JOIN tokens y ON x.token = y.token AND x.doc_id < y.doc_id
  WHERE x.doc_id IN (SELECT rep FROM classes) AND y.doc_id IN (SELECT rep FROM classes) GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes m ON m.doc_id = a JOIN sizes k ON k.doc_id = b WHERE 100 * c >= 85 * (m.n + k.n - c)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a, b FROM ways UNION SELECT r.a, l.b FROM reach r JOIN ways l ON r.b = l.a
), lowest AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CASE WHEN rep IS NULL THEN d.doc_id ELSE least(rep, coalesce(lowest.b, rep)) END AS component_id
FROM d LEFT JOIN sizes ON d.doc_id = sizes.doc_id LEFT JOIN classes ON d.doc_id = classes.doc_id LEFT JOIN lowest ON lowest.a = rep
"""


def brute_force(docs: list[tuple[int, str | None]], size: int = 4, percent: int = 85) -> list[tuple]:
    """The same rows by comparing every two documents; for tests."""
    import re

    lower = {c: c + 32 for c in range(0x41, 0x5B)}
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        best[find(i)] = min(best.get(find(i), d), d)
    return [(d, len(sets[i]), best[find(i)]) for i, (d, _) in enumerate(docs)]
