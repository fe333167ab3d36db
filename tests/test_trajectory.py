"""The filter of many pieces at once against one piece at a time, stops, gates, reconstruction."""

import math

import numpy as np
import pytest

from dermotrace.functions import geo
from dermotrace.operators import trajectory
from pyspark.sql import functions as F


def plain(t, xy, r, v):
    """One piece, one fix at a time, by the textbook."""
    n, q = len(t), 0.5
    xf, pf, xp, pp, begins, rejected = [None] * n, [None] * n, [None] * n, [None] * n, {0}, [False] * n
    i, run, since = 0, 0, 0
    while i < n:
        if i == 0 or (run and t[i - 1] - t[since] >= 10):
            if i:
                i = since
                begins.add(i)
            x, p, run = np.array([*xy[i], 0, 0]), np.diag([r[i], r[i], 9.0, 9.0]), 0
            rejected[i] = False
            xp[i], pp[i] = x, p
        else:
            dt = t[i] - t[i - 1]
            f = np.eye(4)
            f[0, 2] = f[1, 3] = dt
            g = q * np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]])
            x, p = f @ x, f @ p @ f.T + np.kron(g, np.eye(2))
            xp[i], pp[i] = x, p
            h = np.eye(4)[:2]
            s = h @ p @ h.T + np.eye(2) * r[i] * max(1, 3 / max(dt, 0.01))
            miss = xy[i] - h @ x
            rejected[i] = bool(miss @ np.linalg.inv(s) @ miss > 11.83)
            if rejected[i]:
                if not run or dt > 1:
                    run, since = 0, i
                run += 1
            else:
                k = p @ h.T @ np.linalg.inv(s)
                x, p, run = x + k @ miss, p - k @ h @ p, 0
        if not np.isnan(v[i][0]):
            h = np.eye(4)[2:]
            s = h @ p @ h.T + np.array([[v[i][2], v[i][3]], [v[i][3], v[i][4]]])
            miss = np.array(v[i][:2]) - h @ x
            if miss @ np.linalg.inv(s) @ miss <= 11.83:
                k = p @ h.T @ np.linalg.inv(s)
                x, p = x + k @ miss, p - k @ h @ p
        xf[i], pf[i] = x, p
        i += 1
    out = list(xf)
    for k in range(n - 2, -1, -1):
        if k + 1 not in begins:
            f = np.eye(4)
            f[0, 2] = f[1, 3] = t[k + 1] - t[k]
            out[k] = xf[k] + pf[k] @ f.T @ np.linalg.inv(pp[k + 1]) @ (out[k + 1] - xp[k + 1])
    return np.array(out), np.array(rejected)


def walk(rng, n):
    t = np.cumsum(rng.choice([0.2, 1.0, 1.0, 4.0], n))
    xy = np.column_stack((t * 1.2, np.sin(t / 9) * 8)) + rng.normal(size=(n, 2)) * 2
    for k in range(n):
        if rng.random() < 0.05:
            xy[k] += rng.normal(size=2) * 60
    if n > 60:
        xy[30:60] += 300  # long enough to restart there and again at the end
    return t, xy


def test_batch_against_one_at_a_time():
    rng = np.random.default_rng(2)
    parts = [walk(rng, n) for n in (1, 2, 3, 40, 90, 150)]
    t, xy = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    r = rng.uniform(1, 25, t.size)
    v = np.full((t.size, 5), np.nan)
    some = rng.random(t.size) < 0.6
    v[some] = np.column_stack((rng.normal(1.2, 0.3, some.sum()), rng.normal(0, 0.5, some.sum()), np.full(some.sum(), 0.1), np.full(some.sum(), 0.02), np.full(some.sum(), 0.2)))
    first = np.cumsum([0, *(len(p[0]) for p in parts)])[:-1]
    got, rejected = trajectory.kalman(t, xy, r, first, v)
    for a, b in zip(first, [*first[1:], t.size]):
        want, off = plain(t[a:b], xy[a:b], r[a:b], v[a:b])
        assert (off == rejected[a:b]).all() and np.allclose(got[a:b], want, atol=1e-5)
    assert rejected.sum() > 5


def test_without_rejections_it_is_least_squares():
    rng = np.random.default_rng(4)
    n, t = 12, np.arange(12.0)
    xy = np.column_stack((t, 0.5 * t)) + rng.normal(size=(n, 2)) * 0.5
    got, rejected = trajectory.kalman(t, xy, np.full(n, 0.25), np.array([0]))
    rows, rhs = [], []
    for i in range(n):
        h = np.zeros(2 * n)
        h[2 * i] = 1
        sigma = (0.25 * (3 if i else 1)) ** 0.5
        rows.append(h / sigma)
        rhs.append(xy[i, 0] / sigma)
    h = np.zeros(2 * n)
    h[1] = 1 / 3
    rows.append(h)
    rhs.append(0)
    root = np.linalg.cholesky(np.linalg.inv(0.5 * np.array([[1 / 3, 1 / 2], [1 / 2, 1]]))).T
    for i in range(n - 1):
        h = np.zeros((2, 2 * n))
        h[:, 2 * i : 2 * i + 2], h[:, 2 * i + 2 : 2 * i + 4] = -np.array([[1, 1], [0, 1]]), np.eye(2)
        rows += list(root @ h)
        rhs += [0, 0]
    best = np.linalg.lstsq(np.array(rows), np.array(rhs), rcond=None)[0]
    assert not rejected.any() and np.allclose(got[:, 0], best[::2], atol=1e-6) and np.allclose(got[:, 2], best[1::2], atol=1e-6)


def test_a_jump_is_rejected():
    t = np.arange(30.0)
    xy = np.column_stack((t, np.zeros(30)))
    xy[15] += 80
    got, rejected = trajectory.kalman(t, xy, np.full(30, 4.0), np.array([0]))
    assert np.flatnonzero(rejected).tolist() == [15] and abs(got[15, 1]) < 3


def test_pinned_stops():
    t = np.arange(30.0)
    xy = np.column_stack((np.where(t < 10, t, np.where(t < 20, 10 + (t % 2) * 0.4, t - 9)), np.zeros(30)))
    kts = np.where((t >= 10) & (t < 20), 0.2, 2.5)
    out, number = trajectory.pinned(t, xy, kts)
    assert (number[10:20] == 0).all() and (number[:10] == -1).all() and np.ptp(out[10:20, 0]) == 0
    assert (trajectory.pinned(t, xy, np.full(30, np.nan))[1] == -1).all()
    slow = np.column_stack((t * 0.6, np.zeros(30)))  # walks off slower than its speed shows
    assert (trajectory.pinned(t, slow, np.full(30, 0.3))[1] == -1).all()


def test_simplify():
    xy = np.array([[0, 0], [1, 0.01], [2, 0], [2, 5], [2, 10]], float)
    assert trajectory.simplify(xy, 0.1).tolist() == [True, False, True, False, True]
    assert trajectory.simplify(xy, 0.1, np.array([False, True, False, False, False])).tolist() == [True, True, True, False, True]


def fixes(spark, rows):
    return spark.createDataFrame(rows, "track long, t double, idx long, lat double, lon double, hacc double, speed_kts double, course_deg double")


def test_filtered_whole(spark):
    """Pieces of all tracks against one piece at a time, through Spark."""
    rng, m, rows = np.random.default_rng(8), 1 / geo.DEGREE_M, []
    for track in range(5):
        t, xy = walk(rng, 50)
        t[25:] += 5000  # a pause
        rows += [(track, float(a), track * 1000 + i, float(y * m), float(x * m), 3.0, float(rng.choice([0.4, 2.0])) if i % 4 else None, float(i * 9 % 360)) for i, (a, (x, y)) in enumerate(zip(t, xy))]
    got = {(r.track, r.idx): r for r in trajectory.filtered(fixes(spark, rows)).collect()}
    assert len(got) == len(rows) and {r.piece for r in got.values()} == {0, 1}
    for track in range(5):
        for part in (0, 1):
            mine = [r for r in rows if r[0] == track and got[track, r[2]].piece == part]
            lat0, lon0 = mine[0][3:5]
            k = geo.DEGREE_M * math.cos(math.radians(lat0))
            xy = np.array([((r[4] - lon0) * k, (r[3] - lat0) * geo.DEGREE_M) for r in mine])
            v = []
            for r in mine:
                s, c = (r[6] if r[6] is not None else np.nan) * 1852 / 3600, math.radians(r[7])
                a, b = 0.09, (s * math.radians(15)) ** 2
                v.append((np.nan,) * 5 if s != s else (0, 0, a + s * s, 0, a + s * s) if s < 0.6 else (s * math.sin(c), s * math.cos(c), a * math.sin(c) ** 2 + b * math.cos(c) ** 2, (a - b) * math.sin(c) * math.cos(c), a * math.cos(c) ** 2 + b * math.sin(c) ** 2))
            want, off = plain([r[1] for r in mine], xy, [9.0] * len(mine), v)
            for r, w, o in zip(mine, want, off):
                g = got[track, r[2]]
                if g.stop is None:
                    assert g.rejected == o and abs((g.lon - lon0) * k - w[0]) < 1e-4 and abs((g.lat - lat0) * geo.DEGREE_M - w[1]) < 1e-4


def test_reconstructed(spark):
    """Rows between fixes lie on the curve, or on the line where the curve is too fast; nothing before, after, or across a jump."""
    m = 1 / geo.DEGREE_M
    path = [(1, 2.0, 2, 0.0, 0.0, 1.0, 0.0), (1, 6.0, 6, 0.0, 4 * m, 0.0, 1.0), (1, 10.0, 10, 4 * m, 4 * m, 0.0, 1.0), (1, 12.0, 12, 400 * m, 400 * m, 1.0, 1.0), (1, 16.0, 16, 400 * m, 402 * m, None, None)]
    p = spark.createDataFrame(path, "track long, t double, idx long, lat double, lon double, v_east double, v_north double")
    rows = spark.createDataFrame([(1, float(i), i) for i in range(19)], "track long, t double, idx long")
    got = {r.idx: r for r in trajectory.reconstructed(rows, p).collect()}
    assert [i for i in got if got[i].lat is None] == [0, 1, 11, 17, 18]
    s = 0.25
    east = 4 * (3 * s * s - 2 * s**3) + 4 * 1.0 * (s**3 - 2 * s * s + s)
    north = 4 * 1.0 * (s**3 - s * s)
    assert got[3].lon / m == pytest.approx(east, rel=1e-6) and got[3].lat / m == pytest.approx(north, rel=1e-6)
    assert (got[8].lat / m, got[8].lon / m) == (pytest.approx(2), pytest.approx(4))
    assert got[13].lon / m == pytest.approx(400.5)  # no velocity at one end: a line
    fast = spark.createDataFrame([(1, 0.0, 0, 0.0, 0.0, 0.01, 0.0), (1, 4.0, 4, 0.0, 11 * m, 0.01, 0.0)], p.schema)
    line = {r.idx: r.lon / m for r in trajectory.reconstructed(rows.where("idx < 5"), fast).collect()}
    assert [line[i] for i in range(5)] == pytest.approx([0, 2.75, 5.5, 8.25, 11])


def test_snapped_and_spaced(spark):
    p = spark.createDataFrame([(1, 0.0, 0, 0.0, 0.0), (1, 1.0, 1, 0.0, 1.0), (1, 2.0, 2, 0.0, 1.000001), (1, 3.0, 3, 0.0, 1.000002)], "track long, t double, idx long, lat double, lon double")
    roads = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.25), (1, 1, None, None, 0.5)], "track long, idx long, road_lat double, road_lon double, alpha double")
    got = {r.idx: (r.lat, r.alpha) for r in trajectory.snapped(p, roads).collect()}
    assert got == {0: (0.25, 0.25), 1: (0.0, 0.0), 2: (0.0, 0.0), 3: (0.0, 0.0)}
    assert [r.idx for r in trajectory.spaced(p, 3.0).orderBy("idx").collect()] == [0, 1, 3]
    r = spark.range(1).select(trajectory.is_plausible(F.lit(10.0), F.lit(1.0)).alias("a"), trajectory.is_plausible(F.lit(10.0), F.lit(1.0), 3.0, 4.0).alias("b"), trajectory.is_impossible_jump(F.lit(60.0), F.lit(0.0)).alias("c"), trajectory.is_impossible_jump(F.lit(60.0), F.lit(3.5)).alias("d")).first()
    assert tuple(r) == (False, True, True, False)
