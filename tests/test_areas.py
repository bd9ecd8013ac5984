"""Points in a table of polygons against the even-odd rule in plain Python."""

import math
import random

from pyspark.sql import functions as F

from prospector.operators import areas


def inside(x, y, rings):
    hit = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                hit = not hit
    return hit


def ring(rng, cx, cy, r, n):
    pts = [(cx + r * rng.uniform(0.5, 1) * math.cos(t), cy + r * rng.uniform(0.5, 1) * math.sin(t)) for t in (2 * math.pi * i / n for i in range(n))]
    return [*pts, pts[0]]


SHAPE = "area string, rings array<array<struct<x: double, y: double>>>"


def test_points_in_polygons(spark):
    rng = random.Random(4)
    shapes = {f"a{i}": [ring(rng, rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.01, 1, 20]), rng.choice([3, 9, 300]))] for i in range(25)}
    for name, rings in list(shapes.items())[:10]:  # holes, and parts apart
        x, y = (sum(p[i] for p in rings[0]) / len(rings[0]) for i in (0, 1))
        rings += [ring(rng, x, y, 0.3, 8), ring(rng, x + 40, y, 2, 5)]
    shapes["square"] = [[(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)], [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0), (1.0, 1.0)]]
    shapes["line"], shapes["point"] = [[(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]], [[(3.0, 3.0), (3.0, 3.0)]]
    edge = [(0.0, 0.0), (4.0, 2.0), (1.0, 1.5), (2.0, 2.0), (4.0, 4.0), (0.5, 0.5), (3.0, 3.0), (0.0, 2.0), (2.0, 0.0)]
    near = [(x + rng.gauss(0, 0.01), y + rng.gauss(0, 0.01)) for rings in shapes.values() for r in rings for x, y in r[:20]]
    vertices = [p for rings in shapes.values() for r in rings for p in r[:5]]
    points = edge + near + vertices + [(rng.uniform(-60, 60), rng.uniform(-60, 60)) for _ in range(2500)]
    rows = [(i, y, x, "clash") for i, (x, y) in enumerate(points)] + [(9001, None, 1.0, ""), (9002, math.nan, 1.0, ""), (9003, math.inf, 1.0, ""), (9004, 1e300, 1.0, "")]
    polygons = spark.createDataFrame([(k, [[{"x": x, "y": y} for x, y in r] for r in v]) for k, v in shapes.items()] + [("none", None), ("empty", []), ("bare", [[]]), (None, [])], SHAPE)
    want = sorted((i, k) for i, (x, y) in enumerate(points) for k, rings in shapes.items() if inside(x, y, rings))
    own = spark.createDataFrame(rows, "id long, lat double, lon double, area string").repartition(3)
    for cells in (4, 256):
        assert sorted(map(tuple, areas.in_polygons(own, polygons, "id", "area", cells=cells).collect())) == want
    assert len({k for _, k in want}) > 20
    assert areas.in_polygons(own, polygons.limit(0), "id", "area").count() == 0 and areas.in_polygons(own.limit(0), polygons, "id", "area").count() == 0


def test_inner_cells_are_not_judged(spark):
    round_ = [(10 + 0.2 * math.sin(40 * t), t) for t in (2 * math.pi * i / 2000 for i in range(2001))]
    cells = areas.cover([[{"x": r * math.cos(t), "y": r * math.sin(t)} for r, t in round_]])
    inner = [c for c in cells if c[3] is None]
    assert 10 < len(cells) < 1100 and len({c[0] for c in inner}) > 2
    covered = lambda own: sum(4.0 ** -c[0] for c in own)
    assert covered(inner) > 0.5 * covered(cells)
    assert max(len(c[3]) for c in cells if c[3]) < 1000  # an edge goes with the cells at its height only
    plan = areas.in_polygons(spark.range(9).select("id", F.lit(0.5).alias("lat"), F.lit(0.5).alias("lon")), spark.createDataFrame([("s", [[{"x": x, "y": y} for x, y in ((0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0))]])], SHAPE), "id", "area")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
