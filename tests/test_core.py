"""The library outside the corpus operators: every query against its oracle SQL, kernels against plain versions."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import oracle
from dermotrace import registry
from dermotrace.functions import geo, stats, text
from dermotrace.operators import islands, joins, signal, statistics, windows
from dermotrace.streaming import live
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    oracle.same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def track(spark, values, dt=1.0):
    return spark.createDataFrame([(1, i * dt, i, v) for i, v in enumerate(values)], "track long, t double, idx long, value double")


def test_hampel(spark):
    x = [1.0, 1.1, 0.9, 50.0, 1.0, 1.05, None, 0.95, 1.0]
    got = [r.clean for r in windows.hampel(track(spark, x), "value", 3, out="clean").orderBy("idx").collect()]
    assert got[3] < 2 and [g for i, g in enumerate(got) if i != 3] == [v for i, v in enumerate(x) if i != 3]


def test_empty_track(spark):
    e = track(spark, [1.0]).where("idx < 0").withColumn("kind", F.lit("a"))
    assert windows.response_summary(e).count() == islands.sessions(e, 1.0).count() == signal.detected(e).count() == 0


def test_sessions_and_flat_runs(spark):
    df = track(spark, [1.0, 1.0, 1.0, 2.0, 2.0, 1.0])
    assert [(r.start, r.end) for r in islands.flat_runs(df, "value", 1.0).orderBy("start").collect()] == [(0.0, 2.0), (3.0, 4.0)]
    spans = spark.createDataFrame([(1, 0.0, 5.0), (1, 1.0, 2.0), (1, 6.0, 7.0), (1, 20.0, 21.0)], "track long, start double, end double")
    assert sorted((r.start, r.end, r.n) for r in islands.merged(spans, 1.5).collect()) == [(0.0, 7.0, 3), (20.0, 21.0, 1)]


def test_asof_has_no_join(spark):
    df = track(spark, [1.0, 2.0, 3.0])
    plan = joins.asof(df, df, "value")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_lowpass_and_ema():
    t = np.arange(400) / 10
    slow, fast = np.sin(2 * np.pi * 0.1 * t), np.sin(2 * np.pi * 3 * t)
    out = signal.zero_phase_lowpass(slow + fast, 0.5, 10.0)
    assert np.abs(out - slow)[50:-50].max() < 0.02
    assert np.allclose(signal.zero_phase_ema(np.full(50, 3.0), 9), 3.0)
    assert signal.zero_phase_lowpass(np.ones(3), 0.5, 10.0).tolist() == [1, 1, 1]


def test_known_responses():
    fs, k = 10.0, signal.kernel(10.0)
    x, at, size = 5 + 0.0005 * np.sin(np.arange(1800)), [300, 600, 900, 1300], [0.3, 0.8, 0.5, 1.2]
    for a, s in zip(at, size):
        x[a : a + k.size] += s * k[: x.size - a]
    tonic, phasic = signal.decompose(x, fs)
    found = signal.peaks(phasic, x, fs, 0.045)
    top = int(np.argmax(k))
    assert [round((p - top) / 10) for p in found["place"]] == [a // 10 for a in at]
    assert (found["rise"] > 0).all() and (found["half_recovery"] > 0).all() and (found["quality"] > 0.5).all()
    driver = signal.pursue(x - 5, k, 0.05)
    assert all(driver[a - 3 : a + 4].sum() == pytest.approx(s, rel=0.1) for a, s in zip(at, size))
    assert (phasic >= 0).all() and signal.decompose(np.full(30, 2.0), 1.0)[1].max() < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=30))
def test_prominence(values):
    x = np.array(values, float)
    got = signal.prominence(x)
    for i in range(x.size):
        if 0 < i < x.size - 1 and x[i] > x[i - 1] and x[i] >= x[i + 1]:
            left = next((j for j in range(i - 1, -1, -1) if x[j] > x[i]), -1)
            right = next((j for j in range(i + 1, x.size) if x[j] > x[i]), x.size)
            assert got[i] == x[i] - max(x[left + 1 : i + 1].min(), x[i:right].min())
        else:
            assert got[i] == 0


def test_geo(spark):
    df = spark.createDataFrame([(0.5, 0.5, 1), (2.0, 0.5, 0), (0.5, -0.1, 0)], "lat double, lon double, want int")
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
    assert all(r.got == bool(r.want) for r in df.withColumn("got", geo.in_polygon(F.col("lat"), F.col("lon"), ring)).collect())
    d = spark.range(1).select(geo.segment_distance(*(F.lit(v) for v in (0.001, 0.5, 0.0, 0.0, 0.0, 1.0))).alias("d"), geo.bearing(*(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0))).alias("b"), geo.turn_label(F.lit(100.0)).alias("l")).first()
    assert d.d == pytest.approx(111.32, rel=1e-6) and d.b == pytest.approx(90) and d.l == "turn"
    t = spark.range(1).select(geo.tile_pixel(F.lit(0.0), F.lit(0.0), 1).alias("t"), geo.tile(F.lit(85.0), F.lit(-179.0), 3)[0].alias("x"), geo.tile(F.lit(85.0), F.lit(-179.0), 3)[1].alias("y")).first()
    assert tuple(t.t) == (1, 1, 0, 0) and (t.x, t.y) == (0, 0)
    r = spark.range(1).select(geo.angle_between(F.lit(350.0), F.lit(20.0)).alias("a"), geo.angle_between(F.lit(10.0), F.lit(190.0)).alias("b")).first()
    assert (r.a, r.b) == (30.0, 180.0)


def test_statistics(spark):
    assert stats.t_p_value(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert stats.t_critical(10) == pytest.approx(2.228139, abs=1e-5)
    e = spark.createDataFrame([(x / 4,) for x in range(-8, 9)], "x double").select("x", stats.erf(F.col("x")).alias("y")).collect()
    assert max(abs(r.y - math.erf(r.x)) for r in e) < 2e-7
    p = spark.createDataFrame([(1, 0.01), (1, 0.04), (1, 0.03), (1, None), (2, 0.5)], "f long, p double")
    assert sorted((r.p, round(r.q, 6)) for r in statistics.benjamini_hochberg(p, "p", "f").where("p is not null").collect()) == [(0.01, 0.03), (0.03, 0.04), (0.04, 0.04), (0.5, 0.5)]


def packet(ms):
    return live.pack(ms=ms, lat=51.5, lon=-0.1, gsr=5.0, hdop=1.0, pdop=1.0, speed=0.0, course=0.0, sats=9, fix=3, valid=1, hacc=2.0)


def test_packets():
    data = b"xxB" + packet(1) + b"noise" + packet(2) + packet(3)
    for size in (1, 7, 49, 1000):
        rest, got = b"", []
        for at in range(0, len(data), size):
            found, rest = live.frames(rest + data[at : at + size])
            got += [f[0] for f in found]
        assert got == [1, 2, 3] and rest == b""


def test_map_matching_follows_the_street(spark):
    """A noisy walk along a street, round a corner: never on the parallel street, and in order."""
    from dermotrace.operators import spatial

    m = 1 / geo.DEGREE_M
    ways = [(1, [(0.0, x * 50 * m) for x in range(7)]), (2, [(y * 50 * m, 300 * m) for y in range(7)]), (3, [(25 * m, x * 50 * m) for x in range(5)])]
    rng = np.random.default_rng(5)
    walk = [(0.0, x) for x in range(0, 301, 10)] + [(y, 300.0) for y in range(10, 251, 10)]
    rows = [(1, float(i * 8), i, (y + rng.normal() * 3) * m, (x + rng.normal() * 3) * m) for i, (y, x) in enumerate(walk)]
    got = spatial.map_matched(spark.createDataFrame(rows, "track long, t double, idx long, lat double, lon double"), spark.createDataFrame(ways, "way long, nodes array<struct<lat:double,lon:double>>")).orderBy("idx").collect()
    assert len(got) == len(walk)
    assert [r.way for r in got][:28] == [1] * 28 and [r.way for r in got][34:] == [2] * (len(walk) - 34)
    assert np.mean([r.off_m for r in got]) < 4


def test_hotspots_are_apart(spark):
    from dermotrace.operators import spatial

    m = 1 / geo.DEGREE_M
    rows = [(1, i, i * 1.01 * m, 0.0, float(-abs(i - 50))) for i in range(100)]
    got = spatial.hotspots(spark.createDataFrame(rows, "track long, idx long, lat double, lon double, value double"), share=0.03).orderBy("rank").collect()
    assert [r.idx for r in got] == [50, 20, 80]


def test_indices(spark):
    from dermotrace.operators import indices

    r = spark.range(1).select(indices.fog([F.lit(-30.0).cast("double") * 1.0, F.lit(None).cast("double")]).alias("a"), indices.microsiemens(F.lit(1e6), "ohm").alias("b"), indices.band_level(F.lit(-65.0), -100.0).alias("c"), indices.speed_band(F.lit(1.2)).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (3000.0, 1.0, 0.5, "walking")
    x = np.random.default_rng(1).normal(size=(20, 3))
    df = spark.createDataFrame([(1, float(i), i, *map(float, v)) for i, v in enumerate(x)], "track long, t double, idx long, a double, b double, c double")
    got = [r.v for r in df.withColumn("v", indices.triple(F.col("a"), F.col("b"), F.col("c"))).orderBy("idx").collect()]
    assert got == pytest.approx(list(((x - x.mean(axis=0)) / x.std(axis=0)) @ [0.1, 0.45, 0.45]))


def test_spectral():
    from dermotrace.operators import spectral

    t = np.arange(2560) / 4
    x = np.sin(2 * np.pi * 0.1 * t)
    f, p = spectral.welch(x, 4.0, 256)
    assert abs(f[np.argmax(p)] - 0.1) < 0.02 and spectral.band_power(f, p) == pytest.approx(0.5, rel=0.05)
    at, power = spectral.band_series(t, x, 4.0)
    assert len(at) == (2560 - 256) // 20 + 1 and np.ptp(power) < 0.05


def test_sparse_driver_meets_its_conditions():
    """Optimality: no gain over the penalty where the driver is zero, equal to it elsewhere."""
    from dermotrace.operators import spectral

    k, rng = signal.kernel(4.0), np.random.default_rng(6)
    true = np.zeros(120)
    true[[20, 50, 55]] = [1.0, 0.6, 0.9]
    x = np.convolve(true, k)[:120] + rng.normal(size=120) * 0.01
    d = spectral.sparse_driver(x, k, 0.05, rounds=3000)
    rest = x - np.convolve(d, k)[:120]
    gain = np.array([k[: 120 - i] @ rest[i : i + k.size] for i in range(120)])
    assert (gain <= 0.05 + 1e-3).all() and np.allclose(gain[d > 1e-6], 0.05, atol=1e-3) and (d >= 0).all()


def test_distance_is_that_of_the_stored_number(spark):
    """As printf has it: 10.85 is stored under its half, 17.05 over it, and what is a half goes to the even digit."""
    metres = [350.0 * 31, 550.0 * 31, 23250.0, 7750.0, 1234567.0, 999.5, 1000.0]
    got = [r.d for r in spark.createDataFrame([(i, m) for i, m in enumerate(metres)], "i long, m double").select("i", text.distance(F.col("m")).alias("d")).orderBy("i").collect()]
    assert got == [f"{m / 1000:.1f} km" if m >= 1000 else "1000 m" for m in metres] and got[0] == "10.8 km"


def test_rings_of_any_length(spark):
    """Rings of 1, 2, 3 and 2000 positions against plain loops; no ring is gathered into one value."""
    rng = np.random.default_rng(8)
    rings = {n: rng.uniform(0, 1, (n, 2)) for n in (1, 2, 3, 2000)}
    df = spark.createDataFrame([(n, float(i // 2), i, float(y), float(x)) for n, r in rings.items() for i, (y, x) in enumerate(r)], "track long, t double, idx long, lat double, lon double")
    made = geo.ring_summary(df, ("t", "idx"))
    got = {r.track: r for r in made.collect()}
    for n, r in rings.items():
        y, x = r[:, 0], r[:, 1]
        area = abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2 if n > 2 else 0.0
        path = [y[0], *(v for a, b in zip(y, y[1:]) for v in (0.75 * a + 0.25 * b, 0.25 * a + 0.75 * b)), y[-1]] if n > 2 else list(y)
        assert (got[n].area, got[n].lat, got[n].lon, got[n].n, got[n].sum_lat) == (pytest.approx(area), pytest.approx(y.mean()), pytest.approx(x.mean()), len(path), pytest.approx(sum(path)))
    assert "collect_list" not in registry.queries()["geo_rings"](spark, SF)._jdf.queryExecution().toString()


@pytest.mark.parametrize("closed", [False, True])
def test_corner_cutting_of_an_array(spark, closed):
    rows = [(i, [(float(k * k % 7), float(k)) for k in range(i)]) for i in range(6)]
    df = spark.createDataFrame(rows, "i long, p array<struct<lat:double,lon:double>>").withColumn("c", geo.smoothed_corners(F.col("p"), closed))
    for r in df.collect():
        p = [tuple(q) for q in r.p]
        sides = [tuple(a[j] * (1 - w) + b[j] * w for j in (0, 1)) for a, b in zip(p, p[1:]) for w in (0.25, 0.75)]
        want = p if len(p) < 3 else [*sides, sides[0]] if closed else [p[0], *sides, p[-1]]
        assert [tuple(q) for q in r.c] == [pytest.approx(q) for q in want]
