"""Operator 4, benchmark decontamination: an FM-index per training shard, searched for every window of the benchmark.

The benchmark is small and stated, the corpus is not: so the index is built over the training texts, a shard of bounded
size at a time inside the task that read it (no shuffle), and all windows are searched in it at once. Each shard's words
become symbols (words that no benchmark item has are one separator); a wavelet matrix over the Burrows-Wheeler transform
answers the ranks of the backward search; occurrences are located by walking back to sampled suffix positions, and their
word ranges merge into removal spans. The benchmark goes to the tasks in blocks of bounded bytes, one pass a block, and
every block is searched in the text as it was.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, slices, strings, table, written
from .words import ALNUM, parts, words

WINDOW = 10
#: Bytes of text that one index covers, about; a longer document has several, which overlap by a window less one word.
SHARD_BYTES = 1 << 20
#: Bytes of benchmark text that are sent to the tasks at once; its queries take some 24 bytes a word.
BLOCK_BYTES = 4 << 20
#: Every so many text positions have their suffix position kept.
SAMPLE = 32


@dataclass
class Queries:
    """vocabulary: sorted word hashes; symbols are places there plus 1. A window is its last place in `text` and its length."""

    vocabulary: np.ndarray
    text: np.ndarray
    last: np.ndarray
    lengths: np.ndarray
    window: np.ndarray  # pairs (window, item), sorted
    item: np.ndarray
    ids: list[str]


def queries_of(items: list[tuple[str, str]], size: int) -> Queries:
    w = words(strings(pa.array([t for _, t in items], pa.string())), ALNUM)
    vocabulary, symbol = np.unique(w.hashes, return_inverse=True)
    text = (symbol + 1).astype(np.int32)
    number: dict[str, int] = {}
    item = np.array([number.setdefault(i, len(number)) for i, _ in items], np.int64)
    counts = w.counts
    windows = np.where(counts >= size, counts - size + 1, counts > 0).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(windows)])
    of = np.repeat(np.arange(len(items)), windows)
    first = w.first[:-1][of] + np.arange(begin[-1]) - begin[:-1][of]
    length = np.minimum(counts[of], size)
    rows = np.zeros((len(first), size), np.int32)
    for j in range(size):
        own = length > j
        rows[own, j] = text[first[own] + j]
    _, at, same = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    pair = np.unique(np.stack([same.reshape(-1), item[of]], 1), axis=0).reshape(-1, 2)
    return Queries(vocabulary, text, (first + length - 1)[at], length[at], pair[:, 0], pair[:, 1], list(number))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes of text in order, by prefix doubling over those still tied. 0 is a separator: smallest, and by position among its like. The last symbol is 0."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    s = text[order]
    head = np.ones(n, np.bool_)
    head[1:] = (s[1:] != s[:-1]) | (s[1:] == 0)
    slot = np.arange(n)
    group = np.maximum.accumulate(np.where(head, slot, 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    step = 1
    while True:
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(tied):
            return order
        at = order[tied]
        key = group[tied] * n + rank[at + step]
        by = np.argsort(key, kind="stable")
        key = key[by]
        order[tied] = at[by]
        head[tied[1:]] = key[1:] != key[:-1]
        group[tied] = np.maximum.accumulate(np.where(head[tied], tied, 0))
        rank[order[tied]] = group[tied]
        step *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_order(text)
        last = text[order - 1]  # what stands before each suffix; before the first stands the final separator
        self.below = np.zeros(symbols + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=symbols + 1), out=self.below[1:])
        self.bits = list(range(max(1, int(symbols).bit_length()) - 1, -1, -1))
        self.ones, self.zeros, row = [], [], last
        for b in self.bits:
            one = (row >> b) & 1
            count = np.zeros(len(row) + 1, np.int32)
            np.cumsum(one, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(row) - int(count[-1]))
            row = np.concatenate([row[one == 0], row[one == 1]])
        kept = (order % SAMPLE == 0) | (last == 0)
        self.kept = kept
        self.kept_before = np.cumsum(kept) - kept
        self.positions = order[kept]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first i places of the transform."""
        start = np.zeros_like(i)
        for b, ones, zeros in zip(self.bits, self.ones, self.zeros, strict=True):
            up = (symbol >> b) & 1 == 1
            i = np.where(up, zeros + ones[i], i - ones[i])
            start = np.where(up, zeros + ones[start], start - ones[start])
        return i - start

    def back(self, i: np.ndarray) -> np.ndarray:
        """From the rows of suffixes to the rows of the suffixes one symbol longer."""
        symbol, start = np.zeros_like(i), np.zeros_like(i)
        for b, ones, zeros in zip(self.bits, self.ones, self.zeros, strict=True):
            up = ones[i + 1] > ones[i]
            symbol |= up.astype(np.int64) << b
            i = np.where(up, zeros + ones[i], i - ones[i])
            start = np.where(up, zeros + ones[start], start - ones[start])
        return self.below[symbol] + i - start

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the patterns that occur, and which they are; a row of patterns holds one at its end."""
        return self.search_in(patterns.reshape(-1), np.arange(1, len(patterns) + 1) * patterns.shape[1] - 1, lengths)

    def search_in(self, text: np.ndarray, last: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for patterns that are stretches of one text: each ends at its place `last`."""
        which = np.arange(len(last))
        low, high = np.zeros(len(last), np.int64), np.full(len(last), len(self.kept))
        for j in range(int(lengths.max(initial=0))):
            now = lengths[which] > j
            c = text[np.maximum(last[which] - j, 0)].astype(np.int64)
            low = np.where(now, self.below[c] + self.rank(c, low), low)
            high = np.where(now, self.below[c] + self.rank(c, high), high)
            live = low < high
            which, low, high = which[live], low[live], high[live]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            done = self.kept[rows[open_]]
            hit = open_[done]
            out[hit] = self.positions[self.kept_before[rows[hit]]] + steps[hit]
            open_ = open_[~done]
            if len(open_):
                rows[open_] = self.back(rows[open_])
                steps[open_] += 1
        return out


def occurrences(w, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """(word number, window) of every occurrence in a shard."""
    none = np.zeros(0, np.int64)
    if not len(w.hashes) or not len(q.last):
        return none, none
    place = np.minimum(np.searchsorted(q.vocabulary, w.hashes), len(q.vocabulary) - 1)
    known = q.vocabulary[place] == w.hashes
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    heads = w.first[:-1][w.counts > 0]
    begins[heads] = known[heads]
    # A run of known words inside one text that is shorter than the shortest window can hold no occurrence.
    run = np.cumsum(begins) - 1
    length = np.bincount(run[known], minlength=1)
    kept = np.flatnonzero(known & (length[run] >= q.lengths.min()))
    if not len(kept):
        return none, none
    at = np.arange(len(kept)) + np.cumsum(begins[kept])
    text = np.zeros(at[-1] + 2, np.int64)
    text[at] = place[kept] + 1
    word = np.zeros(len(text), np.int64)
    word[at] = kept
    index = FMIndex(text, len(q.vocabulary))
    which, low, high = index.search_in(q.text, q.last, q.lengths)
    count = high - low
    rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return word[index.locate(rows)], np.repeat(which, count)


@dataclass
class Found:
    """Per text: its words, the merged spans of hit words (first, last + 1) and the items; for texts with hits only."""

    counts: np.ndarray
    spans: dict[int, list[tuple[int, int]]]
    items: dict[int, list[str]]


def search(w, q: Queries) -> Found:
    word, window = occurrences(w, q)
    cover = np.zeros(len(w.hashes) + 1, np.int64)
    np.add.at(cover, word, 1)
    np.add.at(cover, word + q.lengths[window], -1)
    inside = np.cumsum(cover[:-1]) > 0
    text_of = np.searchsorted(w.first, word, "right") - 1
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, list[str]] = {}
    for t in np.unique(text_of):
        own = np.flatnonzero(np.diff(np.concatenate([[0], inside[w.first[t] : w.first[t + 1]].astype(np.int8), [0]])))
        spans[int(t)] = list(zip(own[::2].tolist(), own[1::2].tolist(), strict=True))
    if len(word):
        pair = np.unique(np.stack([text_of, window], 1), axis=0)
        begin, end = np.searchsorted(q.window, pair[:, 1]), np.searchsorted(q.window, pair[:, 1], "right")
        for t, a, b in zip(pair[:, 0].tolist(), begin.tolist(), end.tolist(), strict=True):
            items.setdefault(t, []).extend(q.ids[i] for i in q.item[a:b])
    return Found(w.counts, spans, {t: sorted(set(x)) for t, x in items.items()})


def search_texts(texts: pa.StringArray, q: Queries, window: int, shard_bytes: int = SHARD_BYTES):
    """(first, last, Found) of row ranges of texts; a text longer than a shard is searched in overlapping parts."""
    for a, b in slices(texts, shard_bytes):
        if b - a > 1 or pa.compute.binary_length(texts[a]).as_py() <= shard_bytes:
            yield a, b, search(words(texts.slice(a, b - a), ALNUM), q)
            continue
        n, spans, items = 0, [], set()
        for part, again in parts(texts[a].as_py().encode(), ALNUM, shard_bytes, window - 1):
            found = search(words(pa.array([part]), ALNUM), q)
            n -= again
            spans += [(x + n, y + n) for x, y in found.spans.get(0, [])]
            items |= set(found.items.get(0, []))
            n += int(found.counts[0])
        yield a, b, Found(np.array([n]), {0: united(spans)} if spans else {}, {0: sorted(items)} if items else {})


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def query_blocks(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES):
    """Queries of the whole benchmark, one block after another, in as many as its size asks for: the driver holds one at a time.

    Items without a text have no words; those without an id have the empty one.
    """
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        yield queries_of([(r["id"], r["text"]) for r in part.collect()], window)  # about block_bytes of text


SPANS = "array<struct<first:int,last:int>>"
SPAN_TYPE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _spans(found: Found, n: int) -> pa.Array:
    return pa.array([[{"first": x, "last": y} for x, y in found.spans.get(t, [])] for t in range(n)], SPAN_TYPE)


def _text_key(text_col: str, asked: bool = True) -> list:
    """128 bits that stand for a text; zeros where they aren't asked for."""
    keys = [F.xxhash64(text_col), F.xxhash64(F.lit(1), text_col)] if asked else [F.lit(0).cast("long")] * 2
    return [keys[0].alias("_h1"), keys[1].alias("_h2")]


def _merged_hits(docs: DataFrame, blocks, window: int, text_col: str) -> DataFrame:
    """_h1, _h2, spans, items, copies: a row per text with hits of any of the blocks (broadcast queries), as a written table.

    Texts without hits leave no row, and what blocks find in one text is merged by its hash, whatever the row.
    """

    def find(shared):
        def run(batches):
            for batch in batches:
                for a, b, found in search_texts(strings(batch.column(2)), shared.value, window):
                    some = sorted(found.spans)
                    if some:
                        keys = [batch.column(k).slice(a, b - a).take(pa.array(some)) for k in (0, 1)]
                        yield pa.RecordBatch.from_arrays([*keys, _spans(found, b - a).take(pa.array(some)), pa.array([found.items[t] for t in some], pa.list_(pa.string()))], names=["_h1", "_h2", "spans", "items"])

        return run

    rows = docs.select(*_text_key(text_col), F.col(text_col).alias("_t"))
    hits = [rows.mapInArrow(find(shared), f"_h1 long, _h2 long, spans {SPANS}, items array<string>").withColumn("_block", F.lit(k)) for k, shared in enumerate(blocks)]
    each = reduce(DataFrame.unionByName, hits).groupBy("_h1", "_h2", "_block").agg(F.first("spans").alias("spans"), F.first("items").alias("items"), F.count("*").alias("_n"))
    return written(each.groupBy("_h1", "_h2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"), F.max("_n").alias("copies")), "benchmark-hits")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, items (sorted ids), spans (word numbers, first to last + 1).

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z; a window is `window` words of an item in a row,
    or a shorter item whole. Null or empty text: no words, nothing hit. Empty benchmark: nothing hit. Rows that repeat are
    judged each on its own; items that share an id are one item. Other columns are not read.
    """
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(q) for q in query_blocks(benchmark, window, block_bytes=block_bytes)]  # each of a bounded size
    first = blocks[0]

    def run(batches):
        for batch in batches:
            for a, b, found in search_texts(strings(batch.column(1)), first.value, window):
                own = [batch.column(k).slice(a, b - a) for k in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(found.counts), _spans(found, b - a), pa.array([found.items.get(t, []) for t in range(b - a)], pa.list_(pa.string()))], names=["doc_id", "_h1", "_h2", "n_words", "spans", "items"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *_text_key(text_col, len(blocks) > 1))
    out = rows.mapInArrow(run, f"doc_id long, _h1 long, _h2 long, n_words long, spans {SPANS}, items array<string>")
    if len(blocks) > 1:
        more = _merged_hits(docs, blocks[1:], window, text_col).withColumnsRenamed({"spans": "_s", "items": "_i"})
        out = join_counted(out, more, ["_h1", "_h2"], "copies")
        both = lambda a, b, kind: F.concat(F.col(a), F.coalesce(F.col(b), F.array().cast(kind)))
        out = out.withColumns({"spans": both("spans", "_s", SPANS), "items": both("items", "_i", "array<string>")})
    # Spans of one block are merged; those of several may overlap.
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"], acc["reach"]))).cast("long").alias("n"), F.greatest(acc["reach"], s["last"]).alias("reach"))
    return out.select("doc_id", "n_words", F.aggregate(F.array_sort("spans"), start, step)["n"].alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), "spans")


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what stands between them inside one."""
    raw = text.encode()
    w = words(pa.array([text]), ALNUM, hashed=False)
    kept, at = [], 0
    for x, y in united(spans):
        kept.append(raw[at : w.starts[x]])
        at = w.ends[y - 1]
    return b"".join([*kept, raw[at:]]).decode()


def cut_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the hit words of every text, and what stands between them inside a span, taken out; other columns and texts as they were.

    Words and windows are those of `contamination`. Null and empty texts, and all rows where the benchmark is empty, stay as
    they are. Rows that repeat are cut each on its own, alike. The number of blocks changes nothing: each is searched in the
    text as it was, their spans are merged, and the text is cut once. Empty docs: no rows. Any other columns pass through.
    """
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(q) for q in query_blocks(benchmark, window, block_bytes=block_bytes)]
    where, schema = docs.columns.index(text_col), docs.schema
    first = blocks[0]

    def changed(part: pa.RecordBatch, spans: dict[int, list[tuple[int, int]]]) -> pa.RecordBatch:
        if not spans:
            return part
        texts = part.column(where).to_pylist()
        for t, own in spans.items():
            texts[t] = _without(texts[t], own)
        return part.set_column(where, part.schema.field(where).with_type(pa.string()), pa.array(texts, pa.string()))

    def run(batches):
        for batch in batches:
            for a, b, found in search_texts(strings(batch.column(where)), first.value, window):
                yield changed(batch.slice(a, b - a), found.spans)

    def run_found(batches):
        for batch in batches:
            rows = pa.RecordBatch.from_arrays(batch.column(0).flatten(), names=schema.names)
            for a, b in slices(strings(rows.column(where)), SHARD_BYTES):
                spans = batch.column(1).slice(a, b - a).to_pylist()
                yield changed(rows.slice(a, b - a), {t: [(x["first"], x["last"]) for x in s] for t, s in enumerate(spans) if s})

    if len(blocks) == 1:
        return docs.mapInArrow(run, schema)
    hits = _merged_hits(docs, blocks, window, text_col).select("_h1", "_h2", F.col("spans").alias("_spans_found"), "copies")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), *_text_key(text_col))
    found = join_counted(rows, hits, ["_h1", "_h2"], "copies").select("_row", "_spans_found")
    return found.mapInArrow(run_found, schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, k, k + least(10, len(w)) - 1), ' ') AS words FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)
), places AS (
  SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS words FROM (SELECT d.doc_id, d.w, l.n, unnest(range(1, len(d.w) - l.n + 2)) AS k FROM d, (SELECT DISTINCT n FROM windows) l WHERE len(d.w) >= l.n)
), found AS (
  SELECT p.doc_id, p.k, p.n, v.item_id FROM places p JOIN windows v ON p.n = v.n AND p.words = v.words
), hit AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS at FROM (SELECT DISTINCT doc_id, k, n FROM found)) GROUP BY doc_id
), items AS (
  SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM found GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], size: int = WINDOW) -> list[tuple]:
    """The same figures by comparing every window with every place; for tests."""
    import re

    lower = {c: c + 32 for c in range(0x41, 0x5B)}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    windows: dict[tuple, set[str]] = {}
    for item, text in items:
        own = split(text)
        for i in range(max(1, len(own) - size + 1) if own else 0):
            windows.setdefault(tuple(own[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        own = split(text)
        hit, ids = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(own) - n + 1):
                if (k := tuple(own[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    ids |= windows[k]
        out.append((doc, len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out
