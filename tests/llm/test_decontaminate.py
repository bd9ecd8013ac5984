import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prospector.llm import decontaminate as dc


def as_rows(df):
    out = df.select("doc_id", "n_words", "n_hit", F.size("items").cast("long"), F.sha2(F.array_join("items", ","), 256), (F.col("n_hit") > 0))
    return sorted(map(tuple, out.collect()), key=str)


def planted(rng):
    vocabulary = ["Alpha", "beta", "Gamma", "été", "naïve", "x1", "2", "delta"]
    items = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(30)]
    items += [(40, None), (41, ""), (42, "?!"), (7, "beta beta"), (None, "zeta eta theta")]
    docs = []
    for d in range(120):
        own = rng.choices([*vocabulary, *"pqrs"], k=rng.choice([0, 2, 40, 300]))
        for _ in range(rng.choice([0, 1, 2])):
            own.insert(rng.randrange(len(own) + 1), rng.choice(items)[1] or "")
        docs.append((d, " ".join(own).upper() if d % 5 == 0 else " ".join(own)))
    return [*docs, (500, None), (501, ""), (3, docs[9][1]), (3, docs[9][1]), (None, docs[10][1])], items


@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 300])
def test_matches_brute_force(spark, block):
    docs, items = planted(random.Random(7))
    df = spark.createDataFrame([(d, t, 5, "y") for d, t in docs], "doc_id long, text string, n_words int, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = as_rows(dc.contamination(df, bench, block_bytes=block))
    assert got == sorted(dc.brute_force(docs, [("" if i is None else i, t) for i, t in items]), key=str)


def test_driver_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs, items = ([tuple(r) for r in x.select(a, "text").collect()] for x, a in ((df, "doc_id"), (bench, "item_id")))
    assert as_rows(dc.contamination(df, bench)) == sorted(dc.brute_force(docs, items), key=str)


def test_long_texts_are_searched_in_overlapping_parts():
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "été", "x1", "delta", "w" * 400]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([2, 10, 12, 30])))) for i in range(12)]
    own = rng.choices([*vocabulary, *"pqrs"], k=1500)
    for at in range(0, 1500, 60):
        own.insert(at, rng.choice(items)[1])
    text = rng.choice([", ", " "]).join(own)
    q = dc.queries_of([(str(i), t) for i, t in items], dc.WINDOW)
    whole = next(dc.search_texts(dc.strings(dc.pa.array([text])), q, dc.WINDOW, 1 << 30))[2]
    for shard in (100, 1000, 5000):
        (a, b, found), *rest = dc.search_texts(dc.strings(dc.pa.array([text])), q, dc.WINDOW, shard)
        assert (a, b, rest) == (0, 1, [])
        assert found.counts.tolist() == whole.counts.tolist() and found.items == whole.items
        covered = lambda f: {w for x, y in f.spans[0] for w in range(x, y)}
        assert covered(found) == covered(whole), shard


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:3] for r in dc.contamination(df, bench).collect()] == [(1, 2, 0)]
    assert dc.contamination(df.limit(0), bench).count() == 0


def test_cut_spans_takes_out_what_is_hit_and_nothing_else(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    docs = [(1, f"before ÀÉ, {passage}! after", "k"), (2, "clean text", None), (3, None, "k"), (4, passage.upper(), "k")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = dc.cut_spans(df, spark.createDataFrame([(9, passage)], "item_id long, text string"))
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(1, "before ÀÉ, ! after", "k"), (2, "clean text", None), (3, None, "k"), (4, "", "k")]


def test_cut_spans_does_not_depend_on_the_blocks(spark):
    part = lambda i: " ".join(f"p{j}" for j in range(i * 6, i * 6 + 14))
    whole = " ".join(f"p{j}" for j in range(44))
    items = [(i, part(i)) for i in range(6)] + [(6, "left one two three four right five six seven eight")]
    docs = [(1, f"before {whole} after"), (2, "clean"), (3, None), (4, f"left one two three four {whole} right five six seven eight"), (5, whole)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [(1, "before  after"), (2, "clean"), (3, None), (4, "left one two three four  right five six seven eight"), (5, "")]
    size = sum(len(t) + 32 for _, t in items)
    for blocks in (1, 2, 4):
        block_bytes = -(-size // blocks)
        assert len(list(dc.query_blocks(bench, dc.WINDOW, block_bytes=block_bytes))) == blocks
        got = dc.cut_spans(df, bench, block_bytes=block_bytes)
        assert got.schema == df.schema and sorted(map(tuple, got.collect())) == want, blocks


@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 60])
def test_cut_spans_edges(spark, block):
    """Repeated rows, null ids, clashing names, short items, an empty benchmark and no documents."""
    rows = [(1, "k", "x alpha beta gamma y", 3, "s"), (1, "k", "x alpha beta gamma y", 3, "s"), (None, None, "alpha beta", 4, None), (2, "k", None, 5, "s"), (3, "k", "", 6, "s")]
    df = spark.createDataFrame(rows, "doc_id long, _h1 string, text string, copies int, _spans_found string")
    bench = spark.createDataFrame([(1, "alpha BETA"), (1, "gamma"), (2, None), (3, "x alpha")], "item_id long, text string")
    key = lambda r: str(tuple(r))
    want = [(d, h, t if t is None else t.replace("x alpha beta gamma ", " ").replace("alpha beta", ""), c, s) for d, h, t, c, s in rows]
    assert sorted(map(tuple, dc.cut_spans(df, bench, block_bytes=block).collect()), key=key) == sorted(want, key=key)
    assert sorted(map(tuple, dc.cut_spans(df, bench.limit(0), block_bytes=block).collect()), key=key) == sorted(rows, key=key)
    assert dc.cut_spans(df.limit(0), bench, block_bytes=block).count() == 0


def test_index_against_naive_search():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 4, 3000)
    text[500:700] = text[1000:1200]
    text[-1] = 0
    index = dc.FMIndex(text, 3)
    patterns = rng.integers(1, 4, (60, 4))
    lengths = rng.integers(1, 5, 60)
    for k in range(60):
        patterns[k, : 4 - lengths[k]] = 0
    which, low, high = index.search(patterns, lengths)
    found = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(which, low, high, strict=True)}
    for k in range(60):
        p = patterns[k, 4 - lengths[k] :]
        places = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
        assert found.get(k, []) == places
