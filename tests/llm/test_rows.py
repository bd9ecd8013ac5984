"""Quality, line dedup, packing, sharding and the pipeline, against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prospector.llm import line_dedup as ld
from prospector.llm import packing as pk
from prospector.llm import quality as ql
from prospector.llm import sharding as sh
from prospector.llm.common import join_counted, strings


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def dedup_by_hand(docs, min_chars=20, min_docs=3):
    lower = {c: c + 32 for c in range(0x41, 0x5B)}
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(lower)
    holders = defaultdict(set)
    for d, t in docs:
        for s in (t or "").split("\n"):
            holders[key(s)].add(d)
    out = []
    for d, t in docs:
        own = (t or "").split("\n")
        kept = [s for s in own if not (len(key(s)) >= min_chars and len(holders[key(s)]) >= min_docs and d != max(holders[key(s)]))]
        out.append((d, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(spark):
    rng = random.Random(5)
    pool = [f"A shared line number {i} É".ljust(rng.choice([20, 40])) for i in range(30)] + ["short", "", "   ", "\tA Shared LINE number 3 é"]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.choice([1, 3, 40])))) for i in range(120)] + [(500, None), (501, ""), (502, "hot line that everyone has\n" * 500)]
    docs += [(1000 + i, "hot line that everyone has") for i in range(300)]
    df = frame(spark, [(d, t, "s") for d, t in docs]).withColumn("pos", F.lit(1)).withColumn("_text", F.lit("x"))
    assert sorted(map(tuple, ld.line_dedup(df).collect())) == sorted(dedup_by_hand(docs))
    kept = ld.drop_lines(df)
    assert kept.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {d: (None if t is None else k) for (d, t), (_, _, _, k) in zip(docs, dedup_by_hand(docs), strict=True)}
    assert ld.line_dedup(df.limit(0)).count() == 0


def test_quality_weights_match_brute_force():
    docs = [(1, "the cat sat, the cat sat"), (2, "bad!! bad!! BAD"), (3, None), (4, "é é é x-y"), (5, "the dog sat")]
    labels = [(1, 1), (5, 1)]
    texts = strings(pa.array([t for _, t in docs], pa.string()))
    bucket, doc = ql.features(texts)
    own = np.isin(doc, [0, 4])
    ratio = ql.fit(np.bincount(bucket, minlength=ql.BUCKETS).astype(float), np.bincount(bucket[own], minlength=ql.BUCKETS).astype(float))
    got = dict(zip([d for d, _ in docs], ql.weigh(texts, ratio)[1], strict=True))
    want = ql.brute_force(docs, labels)
    assert all(abs(got[d] - want[d]) < 1e-9 for d in want)


def test_kth_largest(spark):
    rng = random.Random(2)
    keys = [rng.randrange(2**48) for _ in range(500)] + [7] * 20
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    for k in (1, 2, 250, 505, 520):
        assert ql.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]
    assert ql.kth_largest(df, 521) == 0


def test_quality_held_out_accuracy(spark):
    """Labels are taken from half of the documents; the other half is judged."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_weight", F.lit("clash"))
    out = ql.quality_select(docs, labels.where("doc_id % 2 = 0"), rejected=True)
    rows = out.join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "_selected").collect()
    rate = lambda q: np.mean([r["_selected"] for r in rows if r["quality"] == q])
    assert rate(1) >= 0.97 and rate(0) <= 0.1
    assert ql.quality_select(docs.limit(0), labels).count() == 0
    assert ql.quality_select(frame(spark, [(1, "a b", "s"), (2, None, "s"), (2, "", "s")]), labels.limit(0)).count() == 1


def test_quality_sample_is_nearer_the_target_than_the_raw_text(spark):
    """The n-grams of what is selected diverge less from those of unseen good documents than the n-grams of all documents."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = ql.quality_select(docs, labels.where("doc_id % 2 = 0"), rejected=True).select("doc_id", "text", "_selected", "_weight").collect()
    good = {r["doc_id"] for r in labels.where("doc_id % 2 = 1 and quality = 1").collect()}

    def spread(rows):
        bucket, _ = ql.features(strings(pa.array([r["text"] for r in rows], pa.string())), 1 << 12)
        n = np.bincount(bucket, minlength=1 << 12) + 0.5
        return n / n.sum()

    target = spread([r for r in out if r["doc_id"] in good])
    far = lambda p: float((target * np.log(target / p)).sum())
    chosen = [r for r in out if r["_selected"]]
    assert far(spread(chosen)) < 0.9 * far(spread(out))


def test_sample_keys_draw_in_proportion_to_the_weights():
    """Of two texts, the heavier comes first as often as its weight says (Gumbel noise at temperature 1)."""
    rng = np.random.default_rng(6)
    draws = rng.integers(-(2**63), 2**63 - 1, (2, 40_000))
    model = ql.Weigher(np.zeros(4), 0.25)
    one = np.ones(40_000, np.int64)
    a = ql.sample_keys(np.full(40_000, 0.25 + np.log(3)), one, draws[0], model)
    b = ql.sample_keys(np.full(40_000, 0.25), one, draws[1], model)
    assert abs((a > b).mean() - 0.75) < 0.01


def test_quality_edges(spark):
    """A repeated id with many texts, a very long text, clashing names, null ids and labels."""
    rows = [(1, f"good words here number {i}", "s") for i in range(50)] + [(2, "bad bad bad", "s"), (None, "good words here", "s"), (3, "good words " * 40_000, "s"), (4, None, None)]
    df = frame(spark, rows).withColumn("_doc", F.lit("x")).withColumn("draw", F.lit(1)).withColumn("_held", F.lit(2))
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    out = ql.quality_select(df, labels, rejected=True)
    assert out.columns == [*df.columns, "_n_grams", "_weight", "_selected"]
    got = out.collect()
    assert len(got) == len(rows) and not [r for r in got if r["doc_id"] == 4][0]["_selected"]
    assert {r["doc_id"]: r["_n_grams"] for r in got if r["doc_id"] in (3, 4)} == {3: 159_999, 4: 0}


def test_pieces_are_the_tokenizer_s_ids(spark):
    import tokenizers

    whole = tokenizers.Tokenizer.from_file(pk.vocabulary())
    texts = ["Hello  world", None, "", "a" * 5000, "<|endoftext|> x", "é\n\n ü  \tz don't 123", " lead", "trail ", "word " * 3000]
    docs = list(enumerate(texts))
    got = {(r["doc_id"], r["piece"]): r for r in pk.pieces(frame(spark, [(d, t, "s") for d, t in docs]), pk.vocabulary(), with_ids=True).collect()}
    for d, t in docs:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        own = [got[k] for k in sorted(got) if k[0] == d]
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in own]).tolist() == ids
        assert [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist()
        assert all(r["length"] == 2048 for r in own[1:]) and all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in own)


def fewest(lengths, capacity):
    """The least number of bins, by trying every place for every item, longest first."""
    best = len(lengths)

    def put(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(lengths):
            best = len(room)
            return
        for r in {*room}:
            if r >= lengths[i]:
                k = room.index(r)
                put(i + 1, [*room[:k], r - lengths[i], *room[k + 1 :]])
        put(i + 1, [*room, capacity - lengths[i]])

    put(0, [])
    return best


def test_plan_against_the_optimum():
    """Never more than one sequence above the optimum on small inputs, and mostly at it."""
    rng = random.Random(12)
    cases = [sorted((rng.randrange(1, 25) for _ in range(rng.randrange(1, 10))), reverse=True) for _ in range(300)]
    over = [pk.plan(Counter(c), 24)[1] - fewest(c, 24) for c in cases]
    assert set(over) <= {0, 1} and over.count(0) >= 0.95 * len(over)


def test_pack_edges(spark):
    """Repeated pieces, null ids and clashing names take places of their own; others stay as they are."""
    rows = [(1, 0, 0, 3, 9), (1, 0, 0, 3, 9), (None, 0, 0, 8, 1), (2, 0, 0, 8, 1), (3, 0, 0, 5, 1)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    odd = df.withColumns({c: F.lit("x") for c in ("_salt", "_rank", "_row", "_before", "_n", "_piece", "_length", "offset")})
    got = pk.pack(odd, 8)
    assert got.columns == [c for c in odd.columns if c != "offset"] + ["sequence_id", "offset"]
    places = defaultdict(list)
    for r in got.collect():
        assert r["_salt"] == r["_row"] == "x"
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(sorted(p) for p in places.values()) == [[(0, 3)], [(0, 5), (5, 3)], [(0, 8)], [(0, 8)]]
    assert pk.pack(odd.limit(0), 8).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randrange(1, 101), 100, 34, 33, 51]) for _ in range(rng.choice([0, 1, 30, 2000])))
    places, total = pk.plan(counts, 100)
    used = defaultdict(list)
    for n, runs in places.items():
        firsts = [r for r, _, _ in runs] + [counts[n]]
        assert firsts == sorted(firsts)
        for (rank, seq, off), end in zip(runs, firsts[1:], strict=True):
            for i in range(end - rank):
                used[seq + i].append((off, n))
    assert sum(map(len, used.values())) == sum(counts.values()) and len(used) == total
    for own in used.values():
        at = 0
        for off, n in sorted(own):
            assert off == at
            at += n
        assert at <= 100
    assert total <= max(1.05 * sum(n * c for n, c in counts.items()) / 100 + sum(c for n, c in counts.items() if n > 50), 1) if counts else total == 0


def test_packing_of_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pk.pack(pk.pieces(df.union(df.limit(3)), pk.vocabulary())).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *[n for _, n in sorted(own)]])[:-1].tolist() and sum(n for _, n in own) <= 2048
    assert len(by) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1
    assert pk.pack(pk.pieces(df.limit(0), pk.vocabulary())).count() == 0


def test_op10_rows_against_plain_python(spark, tmp_path):
    """Sizes, checksums and laws of all rows, null and repeated texts included."""
    texts = [None, "", "é" * 700, *["same text"] * 60, *[f"text {i} " * i for i in range(130)]]
    frame(spark, [(i, t, "s") for i, t in enumerate(texts)]).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = sh.op10(spark, str(tmp_path)).collect()
    want = {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == want and len(got) == len(texts)
    own = defaultdict(list)
    for r in got:
        own[r["shard"]].append(r["slot"])
        assert (r["law"], r["grown_shard"]) == ("rows", None)
    assert sorted(own) == list(range(24)) and all(sorted(v) == list(range(len(v))) for v in own.values())
    assert max(map(len, own.values())) - min(map(len, own.values())) <= 1


def test_shard_rows_edges(spark):
    """Clashing names keep their values; many buckets, null rows and an empty table."""
    names = "_key _place _before _bounds _p _i _bucket _rank _draw _shard _row shard slot".split()
    df = spark.range(0, 500, 1, 5).select("id", *[F.lit("v").alias(c) for c in names], F.when(F.col("id") % 3 > 0, F.repeat(F.lit("y"), 100_000)).alias("text"))
    out = sh.shard_rows(df, 3)
    assert out.columns == ["id", *names[:-2], "text", "shard", "slot"]
    got = out.drop("text").collect()
    assert all(r[c] == "v" for r in got for c in names[:-2])
    assert sorted(r["id"] for r in got) == list(range(500))
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, i) for s, n in enumerate((167, 167, 166)) for i in range(n)]
    assert sh.shard_rows(df.limit(0), 3).count() == 0


@pytest.mark.parametrize("rows", [0, 1, 23, 1000])
def test_shards_are_exact(spark, rows):
    df = spark.range(0, rows, 1, 7).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit(9).alias("shard"))
    out = sh.shard_rows(df, 24).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(rows))
    own = defaultdict(list)
    for r in out:
        own[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in own.values())
    sizes = [len(own[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_no_row_is_lost_when_the_layout_moves(spark, tmp_path):
    """Scan partitions are planned anew for each job; rows have places that don't hang on them."""
    spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before, layouts = docs.rdd.getNumPartitions(), []
    out = sh.shard_rows(docs, 24)
    try:
        for cores, size in (("64", "128m"), ("1", "128m"), ("64", "64k")):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            again = spark.read.parquet(f"{tmp_path}/documents.parquet")
            layouts.append(again.rdd.getNumPartitions())
            got = out.select("doc_id", "shard", "slot").collect()
            assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
            sizes = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(24)]
            assert all(own == list(range(len(own))) for own in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({before, *layouts}) > 2


def test_communication_matrix():
    m = sh.communication_matrix([5, 0, 100, 7], [28, 28, 28, 28], 1)
    assert m.sum(1).tolist() == [5, 0, 100, 7] and m.sum(0).tolist() == [28] * 4
    # Each row is as likely in each shard: over many draws a shard gets its share of a partition.
    mean = np.mean([sh.communication_matrix([10, 30], [20, 20], s)[0, 0] for s in range(2000)])
    assert abs(mean - 5) < 0.15


def test_join_counted(spark):
    left = spark.createDataFrame([(i, "hot") for i in range(600)] + [(1000 + i, f"k{i % 7}") for i in range(50)] + [(9, None)], "i long, k string")
    right = left.groupBy("k").agg(F.count("*").alias("c"), F.min("i").alias("m")).where("k <> 'k3'")
    got = sorted(((r["i"], r["m"]) for r in join_counted(left, right, ["k"], "c", least=100).collect()), key=str)
    want = sorted(((r["i"], r["m"]) for r in left.join(right, "k", "left").collect()), key=str)
    assert got == want and len(join_counted(left, right, ["k"], "c", "inner", least=100).collect()) == 643


def test_pipeline(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    from prospector.llm import decontaminate as dc
    from prospector.llm import ngram_join as nj
    from prospector.llm.common import written

    seen = [docs]
    for name, stage in cp.STAGES:
        seen.append(written(stage(spark, seen[-1], sf), "test"))
        if name != cp.STAGES[-1][0]:
            assert seen[-1].columns == docs.columns, name
    rows = [[(r["doc_id"], r["text"]) for r in d.collect()] for d in seen[:-1]]
    kept = {d for d, _ in rows[1]}
    clean = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in clean) >= 0.95 * len(clean)
    assert sorted(rows[2]) == sorted((d, k) for d, _, _, k in dedup_by_hand(rows[1]))
    groups = {d: c for d, _, c in nj.brute_force(rows[2], 5, 80)}
    assert {d for d, _ in rows[3]} == {d for d in groups if d == groups[d]}
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    before = {r[0]: r for r in dc.brute_force(rows[3], items)}
    assert {d for d, t in rows[4] if t != dict(rows[3])[d]} == {d for d, r in before.items() if r[5]}
    assert {r["doc_id"] for r in seen[-1].collect()} == {d for d, _ in rows[4]}


def test_quality_stage_keeps_columns_whatever_their_names(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in ("_weight", "_selected", "_n_grams", "_draw", "_column1")})
    out = cp.quality(spark, docs, sf)
    assert out.dtypes == docs.dtypes
    rows = out.collect()
    assert len(rows) > 20 and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in docs.columns if c.startswith("_"))


def test_tables_are_noted_by_block(spark):
    from prospector.llm.common import noted_tables, scratch_path

    with noted_tables() as outer:
        first = scratch_path(spark, "a")
        with noted_tables() as inner:
            second = scratch_path(spark, "b")
        third = scratch_path(spark, "c")
    scratch_path(spark, "d")
    assert (outer, inner) == ([first, third], [second])


def test_digests(spark):
    r = ld.op3(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    by_hand = {d: k for d, _, _, k in dedup_by_hand(list(docs.items()))}
    assert r["kept_sha256"] == hashlib.sha256(by_hand[r["doc_id"]].encode()).hexdigest()
