"""What keeps queries within bounds as tables grow, checked on plans and small tables."""

import itertools
import random
from collections import defaultdict

from pyspark.sql import functions as F

from prospector.operators import brands, pairs, resolve, stored_tables
from prospector.plans.catalogue import QUERIES, rivals, table

DIR = "/root/testdata/sf0.001"


def plans_of(monkeypatch, module):
    """The plans of what the module stores from now on."""
    plans, store = [], module.stored

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df)

    monkeypatch.setattr(module, "stored", kept)
    return plans


def test_rounds_of_brands_broadcast_nothing(spark, monkeypatch):
    plans = plans_of(monkeypatch, brands)
    plans.append(QUERIES["brand_units"](spark, DIR)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and any("SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans)


def test_pairs_are_judged_in_their_first_block(spark, monkeypatch):
    """The rows of candidate_pairs and classify at any cap; pairs go through no shuffle, and nothing is broadcast."""
    plans = plans_of(monkeypatch, resolve)
    p = resolve.stored(resolve.prepare(rivals(lambda name: table(spark, DIR, name)).where("idx % 3 <> 1")))
    keys = resolve.block_keys(p)
    for cap in (400, 9):
        want = sorted(map(tuple, resolve.classify(p, resolve.candidate_pairs(keys, cap)).collect()))
        found = resolve.block_levels(p, keys, cap)
        assert sorted(map(tuple, found.collect())) == want and len(want) > 50
        plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 5 and not any(s in plan for plan in plans[1:] for s in ("Broadcast", "hashpartitioning(a", "hashpartitioning(b"))


def test_pairs_of_keys_go_through_no_shuffle(spark, monkeypatch):
    """Each pair once, whatever the parts; a frequent key makes none, and what is shuffled are records with their keys."""
    monkeypatch.setattr(pairs, "PAIRS_A_STEP", 50)
    rng = random.Random(3)
    held = {(rng.randrange(-40, 120) * 10**9, f"k{rng.randrange(90)}") for _ in range(700)} | {(i, "all") for i in range(30)} | {(7, "alone"), (2, "two"), (3, "two")}
    keys = spark.createDataFrame([*held, (None, "two"), (None, "alone")], "idx long, key string")
    by = defaultdict(set)
    for i, k in [*held, (None, "two"), (None, "alone")]:
        by[k].add(i)
    want = sorted({p for ids in by.values() if 2 <= len(ids) <= 20 for p in itertools.combinations(sorted(ids - {None}), 2)})
    for size in ((), (40,), (3,)):
        found = pairs.candidate_pairs(keys, 20, *size)
        assert sorted(map(tuple, found.collect())) == want and len(want) > 300
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(cell" in plan and "hashpartitioning(a" not in plan and "Join" not in plan
    assert pairs.candidate_pairs(keys.where("idx < 0 and idx > 0")).isEmpty()


def test_a_large_folder_is_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored_tables, "ROWS_A_TASK", 100, raising=False)
    path, day = f"{tmp_path}/t", lambda df, n: df.selectExpr("id AS k", f"map('d', {n}) AS m", f"{n} AS at")
    rows = lambda: {(r["k"], r["m"]["d"]) for r in stored_tables.read(spark, path).collect()}
    sizes = lambda: [len(p.read_bytes()) and spark.read.parquet(str(p)).count() for p in (tmp_path / "t" / "_folder=0").glob("*.parquet")]
    stored_tables.create(day(spark.range(1000), 1), path, ["k"], 1)
    assert len(sizes()) > 4 and max(sizes()) < 400 and rows() == {(i, 1) for i in range(1000)}
    stored_tables.upsert(spark, path, day(spark.range(500, 1500), 2).union(day(spark.range(500, 600), 0)), ["k"], 1, F.col("at"))
    want = {(i, 1 if i < 500 else 2) for i in range(1500)}
    assert len(sizes()) > 7 and max(sizes()) < 400 and rows() == want
    assert stored_tables.retain(spark, path, F.col("k") % 3 > 0) == 500
    assert len(sizes()) > 4 and max(sizes()) < 400 and rows() == {x for x in want if x[0] % 3}
