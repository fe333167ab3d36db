"""Revisits against a walk written as loops over cells."""

import math
import random

import pytest

import oracle
from dermotrace.functions import geo
from dermotrace.operators import revisits


def cells(lat, lon, metres):
    step = metres / geo.DEGREE_M
    out = []
    for i in (-1, 0, 1):
        y = math.floor(lat / step) + i
        n = max(1, math.floor(360 * math.cos(math.radians(min(90, max(abs(y * step), abs((y + 1) * step))))) / step))
        x = math.floor((lon + 180) / 360 * n) % n
        out += [(y, (x + j) % n) for j in (-1, 0, 1)]
        if not i:
            own = (y, x)
    return own, set(out)


def plain(rows, metres, gap):
    """Rows (t, lat, lon, v) in order: value and whether the cell was come back to."""
    last, seen, again = {}, {}, set()
    for t, lat, lon, v in rows if len(rows) >= 4 else []:
        if v is None:
            continue
        own, near = cells(lat, lon, metres)
        stale = {c for c in near if c in last and t - last[c] > gap}
        again |= stale | ({own} if stale else set())
        last[own] = t
        for c in near:
            seen.setdefault(c, []).append(v)
    out = []
    for _, lat, lon, v in rows:
        own = cells(lat, lon, metres)[0]
        hit = v is not None and own in again and own in seen
        out.append((hit, None if v is None else round(sum(seen[own]) / len(seen[own]) if hit else v, 6)))
    return out


@pytest.mark.parametrize("lat0,lon0", [(0.0, 0.0), (51.5, -0.1), (-70.0, 179.9999), (89.99, 10.0)])
def test_against_plain(spark, lat0, lon0):
    rng = random.Random(lat0)
    rows, y, x, t = [], 0.0, 0.0, 0.0
    for i in range(400):
        y, x, t = y + rng.gauss(0, 3), x + rng.gauss(0, 3), t + rng.choice([1, 1, 1, 40])
        lon = lon0 + x / geo.DEGREE_M / max(0.05, math.cos(math.radians(lat0)))
        rows.append((t, lat0 + y / geo.DEGREE_M, (lon + 180) % 360 - 180, None if i % 17 == 0 else rng.random()))
    df = spark.createDataFrame([(1, r[0], i, *r[1:]) for i, r in enumerate(rows)] + [(2, float(i), i, lat0, lon0, 1.0) for i in (0, 50, 100)], "track long, t double, idx long, lat double, lon double, value double").repartition(4)
    got = revisits.revisited(df).collect()
    want = plain(rows, revisits.SPOT_M, revisits.GAP_S)
    assert {r.idx: (r.back, None if r.value is None else round(r.value, 6)) for r in got if r.track == 1} == dict(enumerate(want)) and any(w[0] for w in want)
    assert [(r.back, r.value) for r in got if r.track == 2] == [(False, 1.0)] * 3  # three points are no walk
    assert {r.track: r.retraces for r in revisits.retraces(df).collect()} == {1: True, 2: False}


def test_a_pause_is_no_revisit(spark):
    """Standing for an hour without a gap between points, then going on: nothing is pooled."""
    rows = [(1, float(i * 10), i, 50.0, 7.0 + max(0, i - 300) * 3e-4, 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "track long, t double, idx long, lat double, lon double, value double")
    assert revisits.revisited(df).where("back").count() == 0


@pytest.mark.parametrize("name", sorted(revisits.QUERIES))
def test_sql(spark, name):
    oracle.same(revisits.QUERIES[name](spark, "/root/testdata/sf0.001"), revisits.ORACLE_SQL[name], "/root/testdata/sf0.001")
