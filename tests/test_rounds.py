"""Guarded clusters by rounds and incremental resolution, against the ordered pass and against full reruns."""

import random

import pytest
from pyspark.sql import functions as F

from prospector.operators import guarded, refresh, resolve

NODES, LINKS = "idx long, tax string, city string", "component long, a long, b long, rank int, same_record boolean"
CITIES = ["", None, "sobral", "municipio de sobral", "fortaleza", "sobral norte"]


def ordered_pass(nodes, links):
    """(cluster, weakest) by node: unions in order but for those the guards refuse."""
    group = {i: {i} for i in {x for _, a, b, *_ in links if a != b for x in (a, b)}}
    tax, city = {i: t for i, t, _ in nodes}, {i: c for i, _, c in nodes}
    weakest = {}
    fits = lambda x, y: not x or not y or x in y or y in x
    for _, a, b, rank, same in sorted(links, key=lambda k: (-k[3], k[1], k[2])):
        if a == b or group[a] is group[b]:
            continue
        both = group[a] | group[b]
        cities = {city[i] for i in both}
        if len({tax[i] for i in both} - {None, ""}) > 1 or (not same and not all(fits(x, y) for x in cities for y in cities)):
            continue
        low = min(rank, *(weakest.get(i, rank) for i in both))
        for i in both:
            group[i], weakest[i] = both, low
    return {i: (min(g), weakest.get(i)) for i, g in group.items()}


def rounds(spark, nodes, links, **options):
    got = guarded.guarded_clusters(spark.createDataFrame(nodes, NODES), spark.createDataFrame(links, LINKS), **options)
    return {r["idx"]: (r["cluster"], r["weakest"]) for r in got.collect()}


@pytest.mark.parametrize(("seed", "chunk"), [(1, 7), (2, 40), (3, 10_000), (4, 20)])
def test_rounds_give_the_ordered_pass(spark, seed, chunk):
    rng = random.Random(seed)
    n = 120
    nodes = [(i, rng.choice([None, None, "", "t1", "t2", f"u{i % 9}"]), rng.choice(CITIES[: 3 + seed])) for i in range(n)]
    links = {}
    for _ in range(180):
        a, b = rng.randrange(n), rng.randrange(n)
        b = rng.choice([b, min(n - 1, a + 1)])
        links[min(a, b), max(a, b)] = (0, min(a, b), max(a, b), rng.choice([2, 3]), rng.random() < 0.2)
    links = [*links.values(), next(iter(links.values())), (0, 5, 5, 3, True)]
    want = ordered_pass(nodes, links)
    assert rounds(spark, nodes, links, chunk_links=chunk) == want
    assert len({c for c, _ in want.values()}) > 3


def test_a_component_of_a_hundred_thousand(spark):
    """A chain with a hub and conflicts: no task holds the component, chunks of a bounded size do."""
    n = 100_000
    nodes = spark.range(n).select(F.col("id").alias("idx"), F.when(F.col("id") % 30_000 == 7, F.col("id").cast("string")).alias("tax"), F.lit("").alias("city"))
    pairs = spark.range(n - 1).select(F.lit(0).cast("long").alias("component"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(2).alias("rank"), F.lit(False).alias("same_record"))
    got = guarded.guarded_clusters(nodes, pairs, chunk_links=30_000)
    rows = got.groupBy("cluster").agg(F.count("*").alias("n"), F.max("weakest").alias("w")).orderBy("cluster").collect()
    # The chain is joined from its start on; a second tax id refuses its link, and the next cluster begins there.
    assert [(r["cluster"], r["n"], r["w"]) for r in rows] == [(0, 30_007, 2), (30_007, 30_000, 2), (60_007, 30_000, 2), (90_007, 9_993, 2)]


def test_no_links(spark):
    assert rounds(spark, [(1, None, None)], []) == {} and rounds(spark, [(1, None, None)], [(0, 1, 1, 2, False)]) == {}


def random_record(rng, idx):
    words = ["alfa", "beta", "gama", "delta", "zeta"]
    return (idx, rng.choice(["local_db", "places_overture"]), str(idx if rng.random() < 0.9 else rng.randrange(40)), " ".join(rng.sample(words, 2)) + rng.choice(["", " 2"]), None, rng.choice([None, None, None, "11222333000181", "04252011000110"]), rng.choice([None, None, f"www.site{rng.randrange(12)}.com"]), [f"88991{rng.randrange(30):06d}"], rng.choice(["", "Sobral", "Sobral", "Fortaleza"]), None, rng.choice([None, -3.6 + rng.randrange(5) / 1000]), -40.3, [])


RECORD = "idx long, source string, source_record_id string, name string, trade_name string, cnpj string, website string, phones array<string>, city string, street string, lat double, lon double, linked_record_ids array<string>"


def test_refresh_equals_a_full_rerun(spark):
    rng, cap = random.Random(12), 16
    rows = {i: random_record(rng, i) for i in range(40)}
    prepared = lambda some: resolve.prepare(spark.createDataFrame(list(some), RECORD))
    state, crossed, again = refresh.resolved(prepared(rows.values()), cap), 0, []
    for size in (3, 16, 0):
        changed = {i: random_record(rng, i) for i in rng.sample(range(55), size)}
        removed = rng.sample(sorted(rows), size // 2) + [999]
        before = {k for k, n in state.keys.groupBy("key").count().collect() if n > cap}
        state = refresh.refreshed(state, prepared(changed.values()), spark.createDataFrame([(i,) for i in removed], "idx long"), cap)
        crossed += len(before ^ {k for k, n in state.keys.groupBy("key").count().collect() if n > cap})
        rows = {i: r for i, r in (rows | changed).items() if i not in removed or i in changed}
        whole = refresh.resolved(prepared(rows.values()), cap)
        for part in refresh.Resolved._fields:
            a, b = getattr(state, part), getattr(whole, part)
            assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect())), part
        again.append(len({r["cluster"] for r in whole.members.collect()}))
    assert crossed > 1 and min(again) > 3 and state.reviews.count() > 5


def test_untouched_pairs_are_not_judged_again(spark, monkeypatch):
    rng = random.Random(3)
    state = refresh.resolved(resolve.prepare(spark.createDataFrame([random_record(rng, i) for i in range(60)], RECORD)))
    asked = []
    real = refresh.classify
    monkeypatch.setattr(refresh, "classify", lambda p, pairs: asked.append(pairs) or real(p, pairs))
    refresh.refreshed(state, resolve.prepare(spark.createDataFrame([random_record(rng, 7)], RECORD)), spark.createDataFrame([], "idx long"))
    assert all(7 in (r["a"], r["b"]) for r in asked[0].collect())
