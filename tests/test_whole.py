"""Joins of rows with all others, grids at any latitude, matching: held against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest

from dermotrace import registry
from dermotrace.functions import geo
from dermotrace.operators import enrichment, joins, spatial
from dermotrace.sources.tables import events, positions
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def brute(rows, pick):
    tracks = defaultdict(list)
    for r in rows:
        tracks[r.track].append(r)
    return {(a.track, a.idx): pick(a, [b for b in t if b.idx != a.idx]) for t in tracks.values() for a in t}


def backward(a, others):
    return max((b for b in others if b.t <= a.t), key=lambda b: (b.t, b.idx), default=None)


def near(a, others):
    best = min(others, key=lambda b: (abs(b.t - a.t), b.t > a.t, -b.idx if b.t <= a.t else b.idx), default=None)
    return best if best and abs(best.t - a.t) <= 7200 else None


def ties(spark):
    rows = [(1, 5.0, 1, 0.1), (1, 5.0, 2, 0.2), (1, 5.0, 3, None), (1, 9.0, 4, 0.4), (2, 1.0, 5, 0.5), (1, 12.0, 6, 0.6), (1, 15.0, 7, 0.7), (1, 15.0, 8, 0.8)]
    return spark.createDataFrame(rows, "track long, t double, idx long, value double")


@pytest.mark.parametrize("pick,make", [(backward, joins.asof_other), (near, lambda df, v: joins.nearest_other(df, v, 7200.0))])
def test_each_row_meets_all_others(spark, pick, make):
    for df in (ties(spark), events(spark, SF)):
        want = brute(df.collect(), pick)
        got = {(r.track, r.idx): (r.right_t, r.value) for r in make(df, "value").collect()}
        assert got == {k: (b.t, b.value) if b else (None, None) for k, b in want.items()}


def test_asof_forward(spark):
    df = ties(spark)
    right = df.where("idx % 2 = 0")
    got = {(r.track, r.idx): (r.right_t, r.value) for r in joins.asof(df, right, "value", "forward").collect()}
    rows = right.collect()
    for a in df.collect():
        best = min((b for b in rows if b.track == a.track and b.t >= a.t), key=lambda b: (b.t, b.idx), default=None)
        assert got[a.track, a.idx] == ((best.t, best.value) if best else (None, None))


def test_asof_forward_is_linear(spark):
    """Both directions are a running frame: none looks at the rest of the track for each row."""
    df = ties(spark)
    for direction in ("backward", "forward"):
        plan = joins.asof(df, df, "value", direction)._jdf.queryExecution().executedPlan().toString()
        assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_matched_is_greedy(spark):
    """A row whose nearest partner is taken gets its next one; chains, ties and repeated times."""
    rng = np.random.default_rng(3)
    a = [(1, float(t), i) for i, t in enumerate(rng.integers(0, 60, 40))] + [(2, 0.0, 100), (2, 3.0, 101)]
    b = [(1, float(t) + 0.5 * (i % 2), 1000 + i) for i, t in enumerate(rng.integers(0, 60, 40))] + [(2, 1.0, 2000), (2, -4.0, 2001)]
    schema = "track long, t double, idx long"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    got = joins.matched(joins.within(left, right, 5.0))
    pairs = sorted((abs(y[1] - x[1]), x[2], y[2], x[0]) for x in a for y in b if x[0] == y[0] and abs(y[1] - x[1]) <= 5)
    used, want = set(), set()
    for _, x, y, track in pairs:
        if x not in used and y not in used:
            used |= {x, y}
            want.add((track, x, y))
    assert {(r.track, r.left_idx, r.right_idx) for r in got.collect()} == want
    assert (2, 101, 2000) not in want or (2, 100, 2001) in want
    assert {r.idx for r in joins.unmatched(right, got).collect()} == {y[2] for y in b} - used
    entries = right.withColumn("label", F.concat(F.lit("e"), "idx"))
    new = joins.relabelled(left.withColumn("label", F.lit("old")), entries, got, "label").collect()
    of = {x: f"e{y}" for _, x, y in want}
    assert all(r.label == of.get(r.idx, "old") for r in new) and len(new) == len(a)
    assert joins.matched(joins.within(left, right.where("false"), 5.0)).count() == 0


def metres(a, b):
    d = b[1] - a[1]
    d -= 360 * round(d / 360)
    return math.hypot((b[0] - a[0]) * geo.DEGREE_M, d * geo.DEGREE_M * math.cos(math.radians(a[0])))


@pytest.fixture(scope="module")
def globe(spark):
    """Points around the equator, at 51, 65, 80 and 89.99 degrees on both sides, and across 180 degrees."""
    rng = np.random.default_rng(4)
    rows = []
    for lat in (0.0, 51.0, -65.0, 65.0, 80.0, -89.99):
        for lon in (0.0, 179.9995, -120.0):
            for _ in range(45):
                y = lat + rng.normal() * 0.0006
                x = lon + rng.normal() * 0.0006 / max(0.001, math.cos(math.radians(lat)))
                rows.append((min(90.0, max(-90.0, y)), (x + 180) % 360 - 180))
    return [(i % 7, float(i), i, *p) for i, p in enumerate(rows)]


SCHEMA = "track long, t double, idx long, lat double, lon double"


def test_radius_at_any_latitude(spark, globe):
    df = spark.createDataFrame(globe, SCHEMA)
    features = df.where("idx % 2 = 0").select("lat", "lon")
    got = {r.idx: (r.n, r.nearest) for r in joins.radius_counts(df, features, 60.0).collect()}
    for _, _, i, *p in globe:
        d = [x for _, _, j, *q in globe if j % 2 == 0 and (x := metres(p, q)) <= 60]
        assert got[i][0] == len(d) and (not d or abs(got[i][1] - min(d)) < 1e-6)
    assert sum(n for n, _ in got.values()) > 2000


def test_around_at_any_latitude(spark, globe):
    df = spark.createDataFrame(globe, SCHEMA)
    got = {(r.idx, r["class"]): r.n for r in enrichment.around(df, df.withColumn("class", F.col("idx") % 3), 80.0).collect()}
    want = defaultdict(int)
    for _, _, i, *p in globe:
        for _, _, j, *q in globe:
            if metres(p, q) <= 80:
                want[i, j % 3] += 1
    assert got == want


def test_candidates_at_any_latitude(spark, globe):
    rng = np.random.default_rng(5)
    ways = []
    for k in range(0, len(globe), 9):
        _, _, _, lat, lon = globe[k]
        x = lon + 0.003 / max(0.01, math.cos(math.radians(lat)))
        ways.append((k, [(lat, lon), (max(-90.0, min(90.0, lat + float(rng.normal()) * 0.001)), (x + 180) % 360 - 180)]))
    df = spark.createDataFrame(globe, SCHEMA)
    segs = spatial.segments(spark.createDataFrame(ways, "way long, nodes array<struct<lat:double,lon:double>>"))
    got = {(r.idx, r.way): r.d for r in spatial.candidates(df, segs, 40.0, 10_000).collect()}
    want = {}
    for _, _, i, lat, lon in globe:
        k = geo.DEGREE_M * math.cos(math.radians(lat))
        short = lambda d: d - 360 * round(d / 360)
        for way, ((a, x), (b, y)) in ways:
            ax, ay, dx, dy = short(x - lon) * k, (a - lat) * geo.DEGREE_M, short(y - x) * k, (b - a) * geo.DEGREE_M
            s = min(1.0, max(0.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
            if (d := math.hypot(ax + s * dx, ay + s * dy)) <= 40:
                want[i, way] = d
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_surface_at_any_latitude(spark, globe):
    df = spark.createDataFrame([g for g in globe if abs(g[3]) < 89], SCHEMA).withColumn("value", F.col("idx") % 10 + 1.0)
    got = {(r.cy, r.cx): r.votes for r in spatial.surface(df, 0.0005).collect()}
    want = defaultdict(set)
    for track, _, _, lat, lon in globe:
        if abs(lat) > 89:
            continue
        y0, high = math.floor(lat / 0.0005), math.ceil(75 / (0.0005 * geo.DEGREE_M)) + 1
        wide = math.ceil(high / math.cos(math.radians(lat))) + 3
        for cy in range(y0 - high, y0 + high + 1):
            for cx in range(math.floor(lon / 0.0005) - wide, math.floor(lon / 0.0005) + wide + 1):
                if metres((lat, lon), ((cy + 0.5) * 0.0005, (cx + 0.5) * 0.0005)) <= 75:
                    want[cy, (cx + 360_000) % 720_000 - 360_000].add(track)
    assert got == {k: len(v) for k, v in want.items()}


def test_every_row_has_its_row(spark):
    n = positions(spark, SF).count()
    assert all(registry.queries()[q](spark, SF).count() == n for q in ("join_asof", "join_nearest", "join_radius", "env_raster", "delay_places", "disconnect_repaired"))
