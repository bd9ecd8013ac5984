"""Operator 8, best-fit packing: documents into as few sequences of a fixed number of tokens as can be.

Documents are tokenised where they lie; only pieces (document, piece, length, checksum) go on. A packing depends on
nothing but how many pieces there are of each length, at most one number per possible length, so that histogram is all
the driver sees. It plans over runs of equal sequences, not over pieces: first the large items (over a third of the
capacity, so two at most fit one sequence) are matched greedily, the longest with the longest that still fits; then the
others, from long to short, go where they leave the smallest gap. Pieces then take the places planned for their length
by rank, a rank that salted counting gives without gathering a length in one task.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, strings, table, written

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that one task ranks: an even share of all pieces, between these bounds.
RANK_ROWS = (256, 50_000)
#: Words kept with their ids in a Python worker.
CACHE_WORDS = 120_000

_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Byte-level BPE of one vocabulary file, as the tokenizers library gives it with add_special_tokens=False.

    The split of this vocabulary's pattern never reaches back over a space that follows a non-space, so a text without two
    spaces in a row is encoded as its words, each with the space before it; those are looked up, and new ones encoded by
    the ranks. Any other text is encoded whole. Strings of special tokens get their ids as the library's default has it.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import tiktoken
        import tokenizers

        ranks_path = path.rsplit(".", 1)[0] + ".tiktoken"
        import public_tokenizers

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        whole = tokenizers.Tokenizer.from_file(path)
        self.special = [t.content for t in whole.get_added_tokens_decoder().values()]
        self.whole = whole
        self.encode = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache: dict[str, bytes] = {}
        self.cache_words = cache_words

    def _bytes(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian ids of 32 bits."""
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not text:
            return b""
        if "  " in text:
            return self._bytes(text)
        first, *rest = text.split(" ")
        cache = self.cache
        if len(cache) > self.cache_words:
            cache.clear()
        out = [self._bytes(first)] if first else []
        for word in rest:
            got = cache.get(word)
            if got is None:
                got = self._bytes(" " + word)
                if len(word) <= 40:
                    cache[word] = got
            out.append(got)
        return b"".join(out)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and ids (binary, little-endian 32 bits) if asked for.

    A document's tokens are its ids and one end id. Only longer ones than capacity are cut, into pieces of capacity; the
    first may be shorter. Null text: the end id alone. Each row is a document, repeated ids included.
    """
    end = np.array([END_ID], "<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids

    def cut(batches):
        code = encoder(path)
        for batch in batches:
            texts = strings(batch.column(1))
            for first, last in slices(texts):
                columns: list[list] = [[] for _ in fields]
                for doc, text in zip(batch.column(0).slice(first, last - first).to_pylist(), texts.slice(first, last - first).to_pylist(), strict=True):
                    ids = code.ids(text) + end
                    n = len(ids) // 4
                    at, piece = 0, 0
                    while at < n:
                        size = (n - at) % capacity or min(capacity, n - at)
                        part = ids[4 * at : 4 * (at + size)]
                        for c, v in zip(columns, (doc, piece, at, size, zlib.crc32(part), part), strict=False):
                            c.append(v)
                        at, piece = at + size, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """{length: [(first rank, first sequence, offset)]}, ranks and sequences running on in step from there, and the number of sequences."""
    left = {n: c for n, c in counts.items() if c}
    places: dict[int, list[tuple[int, int, int]]] = {n: [] for n in left}
    taken = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    known: list[int] = []
    total = 0

    def put(n: int, first: int, count: int, offset: int) -> None:
        places[n].append((taken[n], first, offset))
        taken[n] += count
        left[n] -= count

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(known, gap)
            gaps[gap].append((first, count))

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            k = bisect_left(large, capacity - n + 1) - 1
            while k >= 0 and not left[large[k]]:
                k -= 1
            mate = large[k] if k >= 0 else None
            if mate == n and left[n] == 1:
                while k >= 0 and (large[k] == n or not left[large[k]]):
                    k -= 1
                mate = large[k] if k >= 0 else None
            count = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
            put(n, total, count, 0)
            if mate is not None:
                put(mate, total, count, n)
            leave(capacity - n - (mate or 0), total, count)
            total += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect_left(known, n)
            if k < len(known):
                gap = known[k]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], known[k]
            else:
                gap, first = capacity, total
                count = -(-left[n] // (capacity // n))
                total += count
            each = gap // n
            full = min(count, left[n] // each)
            rest = min(left[n] - full * each, each) if full < count else 0
            for j in range(each if full else 0):
                put(n, first, full, capacity - gap + j * n)
            leave(gap - each * n, first, full)
            for j in range(rest):
                put(n, first + full, 1, capacity - gap + j * n)
            if full < count:
                leave(gap - rest * n, first + full, 1 if rest else 0)
                leave(gap, first + full + bool(rest), count - full - bool(rest))
    return places, total


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (doc_id, piece, length, ids_crc32, ...) with sequence_id and offset. parts is written to the shared folder first.

    Every row is a piece, repeated rows too, and its place is its own; pieces alike in all of doc_id, piece and ids_crc32 take
    their places in any order. Lengths are 1 to capacity. Null ids rank first. Columns named sequence_id or offset are
    replaced; any others pass through. Empty table: no rows.
    """
    parts = parts.drop("sequence_id", "offset")
    parts = written(parts, "pieces")
    # Any length has at most `capacity` values: the histogram is bounded, and so is the plan made of it.
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places, _ = plan(counts, capacity)
    share = sum(counts.values()) // int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, -(-max(counts.values(), default=1) // min(max(share, RANK_ROWS[0]), RANK_ROWS[1])))
    rows = parts.select(F.struct(*[parts[c] for c in parts.columns]).alias("_piece"), F.col("length").cast("long").alias("_length"), F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).alias("_salt"))
    tally = rows.groupBy("_length", "_salt").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = written(tally.select("_length", "_salt", before.alias("_before")), "ranks")
    own = F.row_number().over(W.partitionBy("_length", "_salt").orderBy(*[F.col("_piece")[c] for c in ("doc_id", "piece", "ids_crc32")]))
    ranked = rows.withColumn("_own", own).join(offsets, ["_length", "_salt"]).select("_piece", "_length", (F.col("_before") + F.col("_own") - 1).alias("_rank"))
    table_of = {n: tuple(np.array(x, np.int64) for x in zip(*p, strict=True)) for n, p in places.items() if p}
    names = [*parts.columns, "sequence_id", "offset"]

    def place(batches):
        for batch in batches:
            length, r = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            sequence, offset = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
            for n in np.unique(length):
                same = length == n
                first, seq, off = table_of[int(n)]
                k = np.searchsorted(first, r[same], "right") - 1
                sequence[same], offset[same] = seq[k] + r[same] - first[k], off[k]
            yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), pa.array(sequence), pa.array(offset)], names=names)

    return ranked.mapInArrow(place, T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), vocabulary())).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
