"""Hard negatives against plain Python."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from prospector.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, a int, score string"


def by_hand(rows, positives=5, negatives=10, low=30, high=90):
    part = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    part = [r for r in part if sum(c * c for c in r[2]) < 2**59]
    out = []
    for a in {(i, lab, tuple(c)) for i, lab, c in part if i % 10 == 0}:
        every = sorted((-sum(x * y for x, y in zip(a[2], c, strict=True)), i, lab) for i, lab, c in part if len(c) == len(a[2]))
        for p, pid, _ in [r for r in every if r[2] == a[1] and r[1] != a[0]][:positives]:
            fit = [r for r in every if r[2] != a[1] and low * -p <= 100 * -r[0] <= high * -p]
            out += [(a[0], pid, k, i, -p, -s) for k, (s, i, _) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, hn.hard_negatives(df, F.col("vec_id") % 10 == 0, **options).collect()))


def test_mining(spark):
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, rng.randrange(3), [float(np.float32(x + rng.gauss(0, 0.5))) for x in rng.choice(base)]) for i in range(200)]
    rows += [(300 + i, i % 3, rows[5][2]) for i in range(40)]  # ties
    rows += [rows[7], rows[10], rows[10], (20, 2, rows[3][2])]  # repeated rows, an anchor too, and an id with two vectors
    rows += [(400, None, rows[1][2]), (410, 1, None), (None, 1, rows[1][2]), (420, 1, [1.0, None]), (430, 1, [math.nan] * 6), (440, 1, [math.inf] + [0.0] * 5)]
    rows += [(450, 1, [0.0] * 6), (460, 1, []), (461, 1, []), (462, 2, []), (470, 0, [1.0, 2.0]), (471, 0, [1.0, 2.0]), (472, 1, [0.5, 1.0])]
    rows += [(480, 0, [1e30] * 6), (490, 0, [5e4, 1.0, 0.0]), (491, 0, [9e4, 0.0, 1.0]), (492, 1, [7e4, 0.0, 1.0]), (493, 1, [0.5, 0.0, 1.0])]
    want = by_hand(rows)
    assert len(want) > 500
    assert mined(spark, rows) == want
    assert mined(spark, rows, anchors_at_most=4) == want
    assert mined(spark, rows, positives=2, negatives=3, low=-50, high=70) == by_hand(rows, 2, 3, -50, 70)


def test_no_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []


def test_exact_scores():
    rng = np.random.default_rng(1)
    for size in (100, 2**20, 2**27):
        a, b = (rng.integers(-size, size, (7, 33)).astype(float) for _ in range(2))
        assert hn.scores(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]
