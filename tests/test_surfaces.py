"""Fine surfaces with cells missing and distances from walks, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dermotrace.functions import geo
from dermotrace.operators import surfaces


def cubic(p, t):
    return 0.5 * (2 * p[1] + (p[2] - p[0]) * t + (2 * p[0] - 5 * p[1] + 4 * p[2] - p[3]) * t**2 + (3 * (p[1] - p[2]) + p[3] - p[0]) * t**3)


def test_smooth_with_holes(spark):
    rng = np.random.default_rng(2)
    cells = {(y, x): float(rng.random()) for y in range(-4, 8) for x in range(9) if rng.random() < 0.93}
    odd = {(1, 20): None, (2, 20): float("nan"), (3, 30): 5.0}
    df = spark.createDataFrame([(*k, v) for k, v in (cells | odd).items()], "cy long, cx long, v double")
    got = {(r.cy, r.cx): r.v for r in surfaces.smooth(df, 4).collect()}
    cells[3, 30] = 5.0
    want, full = {}, 0
    for y in range(-6, 9):
        for x in range(-2, 33):
            for i in range(4):
                for j in range(4):
                    dy, dx = i / 4, j / 4
                    around = [[cells.get((y + a, x + b)) for b in range(-1, 3)] for a in range(-1, 3)]
                    if all(v is not None for row in around for v in row):
                        want[y * 4 + i, x * 4 + j] = cubic([cubic(row, dx) for row in around], dy)
                        full += 1
                        continue
                    met = [(cells[y + a, x + b], abs(1 - a - dy) * abs(1 - b - dx)) for a in (0, 1) for b in (0, 1) if (y + a, x + b) in cells]
                    if sum(w for _, w in met) > 1e-6:
                        want[y * 4 + i, x * 4 + j] = sum(v * w for v, w in met) / sum(w for _, w in met)
    assert set(got) == set(want) and full > 100
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


def test_corridor(spark):
    """A gap covers nothing, a long stretch of few positions its whole way, 180 degrees are no edge."""
    rows = [(1, 0.0, 0, 10.0, 20.0), (1, 1.0, 1, 10.003, 20.004), (1, 2.0, 2, 10.003, 20.03), (1, 3.0, 3, None, None), (2, 0.0, 0, 0.0, 179.9995), (2, 1.0, 1, 0.0001, -179.9993)]
    step, reach = 0.0005, 60.0
    got = {(r.cy, r.cx): r.d for r in surfaces.corridor(spark.createDataFrame(rows, "track long, t double, idx long, lat double, lon double"), step, reach, 1000.0).collect()}
    want = {}
    for (y1, x1), (y2, x2) in (((10.0, 20.0), (10.003, 20.004)), ((10.003, 20.03), (10.003, 20.03)), ((0.0, 179.9995), (0.0001, 180.0007))):
        for cy in range(math.floor(y1 / step) - 4, math.floor(y2 / step) + 5):
            for cx in range(math.floor(x1 / step) - 4, math.floor(x2 / step) + 5):
                y, x = (cy + 0.5) * step, (cx + 0.5) * step
                k = geo.DEGREE_M * math.cos(math.radians(y))
                ax, ay, dx, dy = (x1 - x) * k, (y1 - y) * geo.DEGREE_M, (x2 - x1) * k, (y2 - y1) * geo.DEGREE_M
                u = max(0, min(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) if dx or dy else 0
                d = math.hypot(ax + u * dx, ay + u * dy)
                key = cy, (cx + 360000) % 720000 - 360000
                if d <= reach:
                    want[key] = min(d, want.get(key, d))
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())
    assert any(cx < 0 for _, cx in got)


def test_coverage_is_summed_exactly(spark):
    """Many walks in a cell: the sum is the rounded exact one, whatever the order of rows, so that equal cells share a rank."""
    rng = np.random.default_rng(5)
    rows = [(int(k), float(51.5 + y), float(-0.1 + x)) for k, (y, x) in enumerate(rng.uniform(0, 0.0009, (4000, 2)))]
    df = spark.createDataFrame(rows, "track long, lat double, lon double")
    got = [{(r.cy, r.cx): (r.cover, r.rank) for r in surfaces.coverage(df.repartition(n).sortWithinPartitions(F.rand(n)), 0.001, 75.0).collect()} for n in (3, 7)]
    assert got[0] == got[1] and len(got[0]) > 4
    each = spark.createDataFrame(rows, "track long, lat double, lon double")
    for (cy, cx), (cover, _) in got[0].items():
        d = geo.distance(F.col("lat"), F.col("lon"), F.lit((cy + 0.5) * 0.001), F.lit((cx + 0.5) * 0.001))
        w = [r.w for r in each.select((1 - d / 75.0).alias("w")).collect() if r.w > 0]
        assert cover == pytest.approx(math.fsum(w), rel=1e-15)
