"""Operator 5, quality classifier: importance resampling with hashed n-gram models, sampled by Gumbel top-k.

Two generative models over hashed n-grams (words and runs of punctuation, one and two in a row): one of the target, the
labelled good documents, one of the raw text, which is every document. A document's importance weight has as its logarithm
the sum, over its n-grams, of the log ratio of the two models less a constant: the mean log ratio that parts held-out good and
bad labels best. Without it, sums would choose by length, as the raw text holds the target. Gumbel noise added to the log
weights and the k largest taken is sampling without replacement in proportion to the weights (temperature 1). k is not
guessed: it is the number of documents whose log weight is not negative.

Three passes over the texts, none of which shuffles them: count n-grams (a bounded table of sums leaves each task), weigh,
and decide. The k-th largest key comes from histograms, each of a bounded size, so nothing is sorted or gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, strings, table, written
from .words import WORD_OR_MARK, mix, words

BUCKETS = 1 << 14
#: Labelled documents that the target model and the threshold come from, about; the raw model has all documents.
LABELLED_ROWS = 20_000
#: Part of them held out for the threshold.
HELD_OUT = 0.3
SEED = 11
_DIGITS, _ROUNDS = 12, 4


@dataclass
class Weigher:
    """log_ratio: per bucket; threshold: the mean log ratio taken off; temperature: what log weights are divided by before the noise is added."""

    log_ratio: np.ndarray
    threshold: float = -np.inf
    temperature: float = 1.0


def features(texts: pa.StringArray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, the text it is of). A word right after itself counts as a mark of its own, whatever the word."""
    w = words(texts, WORD_OR_MARK, lower=False)
    h, n = w.hashes, len(w.hashes)
    doc = np.repeat(np.arange(len(texts)), w.counts)
    if not n:
        return np.zeros(0, np.int64), doc
    inner = np.ones(n, np.bool_)
    inner[w.first[:-1][w.counts > 0]] = False
    again = np.zeros(n, np.bool_)
    again[1:] = h[1:] == h[:-1]
    h = np.where(again & inner, np.uint64(1), h)
    pairs = mix(h[1:] * np.uint64(31) + h[:-1] * np.uint64(7919))[inner[1:]]
    return (np.concatenate([h, pairs]) % np.uint64(buckets)).astype(np.int64), np.concatenate([doc, doc[1:][inner[1:]]])


def fit(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratios by bucket; the raw model is the target's prior, worth as many n-grams as there are buckets."""
    raw = (raw + 0.5) / (raw + 0.5).sum()
    return np.log((target + len(raw) * raw) / (target.sum() + len(raw))) - np.log(raw)


def weigh(texts: pa.StringArray, log_ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of n-grams, mean log ratio) of each text; 0 of none."""
    bucket, doc = features(texts, len(log_ratio))
    n = np.bincount(doc, minlength=len(texts))
    return n, np.bincount(doc, log_ratio[bucket], minlength=len(texts)) / np.maximum(n, 1)


def threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The middle of the weights that part good from bad with the best mean of both rates; minus infinity if either has none."""
    if not len(good) or not len(bad):
        return -np.inf
    points = np.unique(np.concatenate([good, bad]))
    kept = 1 - np.searchsorted(np.sort(good), points) / len(good)
    gone = np.searchsorted(np.sort(bad), points) / len(bad)
    best = np.flatnonzero(kept + gone >= (kept + gone).max() - 1e-12)[-1]
    return float((points[best] + points[best - 1]) / 2) if best else float(points[0])


def log_weights(mean: np.ndarray, n: np.ndarray, model: Weigher) -> np.ndarray:
    """Logarithms of the importance weights of texts of n n-grams with these mean log ratios."""
    return n * (mean - (model.threshold if np.isfinite(model.threshold) else 0.0))


def sample_keys(mean: np.ndarray, n: np.ndarray, draw: np.ndarray, model: Weigher) -> np.ndarray:
    """Order-preserving whole numbers of 48 bits for log weight / temperature + Gumbel noise; texts without n-grams come last, with 0."""
    u = ((draw.view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    key = log_weights(mean, n, model) / model.temperature - np.log(-np.log(u))
    # The logarithm of the size holds all numbers there are in 48 bits, and the most digits where keys are close.
    whole = np.clip((np.sign(key) * np.log1p(np.abs(key)) + 64) / 128, 1e-9, 1 - 1e-9) * 2.0 ** (_DIGITS * _ROUNDS)
    return np.where(n > 0, whole.astype(np.int64), 0)


def kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest of column key (long, 48 bits, not negative), by histograms of its digits; 0 if there are fewer."""
    prefix, shift = 0, _DIGITS * _ROUNDS
    for _ in range(_ROUNDS):
        shift -= _DIGITS
        own = keys.where(F.shiftright("key", shift + _DIGITS) == prefix)
        counts = {r["d"]: r["n"] for r in own.groupBy(F.shiftright("key", shift).bitwiseAND(2**_DIGITS - 1).alias("d")).agg(F.count("*").alias("n")).collect()}
        for d in sorted(counts, reverse=True):
            if counts[d] >= k:
                break
            k -= counts[d]
        else:
            return 0
        prefix = prefix << _DIGITS | d
    return prefix


def _labelled(labels: DataFrame, bound: int) -> DataFrame:
    """doc_id, good, held of about `bound` labelled documents at most, chosen by hash."""
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_doc")).agg((F.max("quality") > 0).alias("_good"))
    total = own.count()
    share = min(1.0, bound / max(total, 1))
    part = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "_doc"), F.lit(1_000_000)) / 1e6
    return written(own.where(part(1) < share).withColumn("_held", part(2) < HELD_OUT), "labelled")


def _counts(buckets: int):
    def run(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            texts, chosen = strings(batch.column("text")), batch.column("target").to_numpy(zero_copy_only=False).astype(np.bool_)
            for a, b in slices(texts):
                bucket, doc = features(texts.slice(a, b - a), buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[chosen[a:b][doc]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    return run


def fit_models(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, labelled_rows: int = LABELLED_ROWS, id_col: str = "doc_id", text_col: str = "text", temperature: float = 1.0) -> tuple[Weigher, DataFrame]:
    """The fitted models and threshold, and the table (held, doc, draw, n, mean) of all documents."""
    rows = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(_labelled(labels, labelled_rows)), "_doc", "left")  # bounded by labelled_rows
    target = F.coalesce(F.col("_good") & ~F.col("_held"), F.lit(False))
    counted = rows.select("text", target.alias("target")).mapInArrow(_counts(buckets), "bucket long, raw long, target long")
    raw, own = np.zeros(buckets), np.zeros(buckets)
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # a row per bucket
        raw[r["bucket"]], own[r["bucket"]] = r["raw"], r["target"]
    log_ratio = fit(raw, own)

    def run(batches):
        for batch in batches:
            texts = strings(batch.column("text"))
            for a, b in slices(texts):
                n, mean = weigh(texts.slice(a, b - a), log_ratio)
                own = [batch.column(c).slice(a, b - a) for c in ("held", "doc", "draw")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(mean)], names=["held", "doc", "draw", "n", "mean"])

    held = F.when(F.col("_held"), F.col("_good"))
    named = rows.select("text", held.alias("held"), F.when(F.col("_held"), F.col("_doc")).alias("doc"), _draw("_doc", "text").alias("draw"))
    scored = written(named.mapInArrow(run, "held boolean, doc long, draw long, n long, mean double"), "weights")
    # One row per held-out label, however often its id is repeated: bounded by labelled_rows.
    marks = [(r["held"], r["mean"]) for r in scored.where("held is not null and n > 0").groupBy("doc", "held").agg(F.min("mean").alias("mean")).collect()]
    good, bad = (np.array([m for h, m in marks if h is x]) for x in (True, False))
    model = Weigher(log_ratio, threshold(good, bad), temperature)
    return model, scored


def _draw(doc: str, text: str):
    return F.xxhash64(F.lit(SEED), doc, text)


def quality_select(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rejected: bool = False, **options) -> DataFrame:
    """docs with _n_grams, _weight (the logarithm of the importance weight) and _selected; rows that aren't selected are left out unless rejected is True.

    labels: doc_id, quality (above 0: good). Null or empty text has no n-grams, weight 0, and is never selected. Rows that
    repeat id and text fare alike; other ties at the k-th key are all selected. temperature: below 1, the draw keeps closer to
    the weights. Without good or without bad labels there
    is nothing to tell apart: all documents with n-grams are selected. Columns of docs with the three names are replaced.
    Empty docs: no rows.
    """
    docs = docs.drop("_n_grams", "_weight", "_selected")
    model, scored = fit_models(docs, labels, id_col=id_col, text_col=text_col, **options)
    k = scored.where((F.col("n") > 0) & (F.col("mean") >= model.threshold)).count()
    keyed = scored.select("draw", "n", "mean").mapInArrow(_keys(model), "key long")
    least = max(1, kth_largest(written(keyed, "keys"), k)) if k else 2**62
    where = docs.columns.index(text_col)
    out = T.StructType([*docs.schema.fields, T.StructField("_n_grams", T.LongType()), T.StructField("_weight", T.DoubleType()), T.StructField("_selected", T.BooleanType())])

    def decide(batches):
        for batch in batches:
            texts, draw = strings(batch.column(where)), batch.column(batch.num_columns - 1).to_numpy()
            for a, b in slices(texts):
                n, mean = weigh(texts.slice(a, b - a), model.log_ratio)
                chosen = sample_keys(mean, n, draw[a:b], model) >= least
                part = pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(n), pa.array(log_weights(mean, n, model)), pa.array(chosen)], names=out.names)
                yield part if rejected else part.filter(pa.array(chosen))

    return docs.select("*", F.xxhash64(F.lit(SEED), F.col(id_col).cast("long"), F.col(text_col)).alias("_draw")).mapInArrow(decide, out)


def _keys(model: Weigher):
    def run(batches):
        for batch in batches:
            c = {x: batch.column(x).to_numpy() for x in ("draw", "n", "mean")}
            yield pa.RecordBatch.from_arrays([pa.array(sample_keys(c["mean"], c["n"], c["draw"], model))], names=["key"])

    return run


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_select(docs, table(spark, sf_dir, "labels"), rejected=True)
    return out.select("doc_id", F.col("_n_grams").alias("n_grams"), F.round("_weight", 6).alias("weight"), F.col("_selected").alias("selected"))


def brute_force(docs: list[tuple[int, str | None]], labels: list[tuple[int, int]], buckets: int = BUCKETS) -> dict[int, float]:
    """Weights by one Python loop, with the good and held-out documents of labels given as 1 (target) and 0; for tests."""
    import re

    def grams(text: str | None) -> list:
        raw = [m.encode() for m in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+|[^A-Za-z0-9\x80-\U0010ffff\x20\x09-\x0D]+", text or "")]
        w = ["again" if i and x == raw[i - 1] else x for i, x in enumerate(raw)]
        return [*w, *zip(w, w[1:], strict=False)]

    target = dict(labels)
    number: dict = {}
    raw, own = np.zeros(buckets), np.zeros(buckets)
    place: dict[tuple, int] = {}

    def bucket(g) -> int:  # the operator's own hash, by gram
        if g not in place:
            ws = [g] if not isinstance(g, tuple) else list(g)
            h = [np.uint64(1) if x == "again" else words(pa.array([x.decode()]), WORD_OR_MARK, lower=False).hashes[0] for x in ws]
            v = h[0] if len(h) == 1 else mix(np.array([h[1]]) * np.uint64(31) + np.array([h[0]]) * np.uint64(7919))[0]
            place[g] = int(v % np.uint64(buckets))
        return place[g]

    for d, text in docs:
        number[d] = [bucket(g) for g in grams(text)]
        for b in number[d]:
            raw[b] += 1
            own[b] += target.get(d, 0)
    ratio = fit(raw, own)
    return {d: float(np.mean(ratio[b])) if b else 0.0 for d, b in number.items()}
