"""Clusters, contours, junctions and their tests against plain versions."""

import math
from collections import defaultdict

import numpy as np
import pytest

from dermotrace.functions import geo
from dermotrace.operators import isobands, junctions, places, surfaces
from pyspark.sql import functions as F


def plain_leaders(xy, radius=35.0, apart=1.8):
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    density = (d <= radius).sum(axis=1)
    out, heads = [-1] * len(xy), []
    for i in sorted(range(len(xy)), key=lambda i: (-density[i], i)):
        if out[i] >= 0:
            continue
        near = min(range(len(heads)), key=lambda k: (d[i, heads[k]], k), default=None)
        if near is not None and d[i, heads[near]] <= radius * apart:
            out[i] = near
            continue
        for j in range(len(xy)):
            if d[i, j] <= radius and out[j] < 0:
                out[j] = len(heads)
        heads.append(i)
    return out


@pytest.mark.parametrize("n", [1, 2, 60, 400])
def test_leaders(n):
    xy = np.random.default_rng(n).normal(size=(n, 2)) * 120
    assert places.leaders(xy).tolist() == plain_leaders(xy)


def test_clusters_and_weight(spark):
    m = 1 / geo.DEGREE_M
    rows = [(i, a, 10.0 + (i % 3) * 200 * m + i * 0.1 * m, 0.0) for a in (1, 2) for i in range(12)] + [(99, 1, None, 0.0)]
    got = places.clusters(spark.createDataFrame(rows, "idx long, area long, lat double, lon double")).collect()
    of = defaultdict(set)
    for r in got:
        of[r.area, r.cluster].add(r.idx % 3)
    assert len(got) == 24 and len(of) == 6 and all(len(v) == 1 for v in of.values())
    r = spark.range(1).select(places.weight(F.lit(9.0), F.lit(2.0)).alias("a"), places.weight(F.lit(0.1), F.lit(2.0)).alias("b"), places.weight(F.lit(0.1), F.lit(0.0)).alias("c")).first()
    assert tuple(r) == (3.0, 0.55, 1.0)


def grid(spark, values):
    return spark.createDataFrame([(y, x, float(v)) for y, row in enumerate(values) for x, v in enumerate(row) if v is not None], "cy long, cx long, v double")


def test_contours_of_a_hill(spark):
    n = 21
    hill = [[100 - (y - 10) ** 2 - (x - 10) ** 2 for x in range(n)] for y in range(n)]
    segments = surfaces.contour_segments(grid(spark, hill), [40.5, 75.5])
    for r in segments.collect():
        for y, x in ((r.y1, r.x1), (r.y2, r.x2)):
            fy, fx = math.floor(y), math.floor(x)
            v = hill[fy][fx] + (hill[min(fy + 1, n - 1)][fx] - hill[fy][fx]) * (y - fy) if x == fx else hill[fy][fx] + (hill[fy][min(fx + 1, n - 1)] - hill[fy][fx]) * (x - fx)
            assert v == pytest.approx(r.level)
    lines = {r.level: r for r in isobands.contour_lines(grid(spark, hill), [40.5, 75.5]).collect()}
    assert set(lines) == {40.5, 75.5} and all(r.closed for r in lines.values())
    for level, r in lines.items():
        far = [math.hypot(p.y - 10, p.x - 10) for p in r.points]
        assert abs(np.mean(far) - math.sqrt(100 - level)) < 0.15 and np.ptp(far) < 0.3


def test_saddles_and_edges(spark):
    got = surfaces.contour_segments(grid(spark, [[1, 0], [0, 1]]), [0.4]).collect()
    assert len(got) == 2
    mid = {(round((r.y1 + r.y2) / 2, 3), round((r.x1 + r.x2) / 2, 3)) for r in got}
    assert mid == {(0.2, 0.8), (0.8, 0.2)}  # the middle is high: lines go round the low corners
    low = surfaces.contour_segments(grid(spark, [[1, 0], [0, 1]]), [0.6]).collect()
    assert {(round((r.y1 + r.y2) / 2, 3), round((r.x1 + r.x2) / 2, 3)) for r in low} == {(0.2, 0.2), (0.8, 0.8)}
    assert surfaces.contour_segments(grid(spark, [[1, None], [0, 1]]), [0.5]).count() == 0
    assert surfaces.contour_segments(grid(spark, [[1, 0], [0, 1]]), []).count() == 0
    assert surfaces.levels(grid(spark, [[3, 1], [2, 4]]), 3) == [2.0, 3.0, 4.0] and surfaces.levels(grid(spark, [[None]]), 3) == []


def tags(spark, pairs, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(pairs)], "i int, tags map<string,string>")
    return [r.v for r in df.orderBy("i").select(make(F.col("tags")).alias("v")).collect()]


def test_road_rules(spark):
    assert tags(spark, [{"highway": "footway", "footway": "sidewalk"}, {"highway": "footway"}, {"footway": "crossing"}, {}], junctions.is_adjunct) == [True, False, False, False]
    assert tags(spark, [{"service": "parking_aisle"}, {"service": "alley"}, {}], junctions.is_parking_aisle) == [True, False, False]
    cases = [{"sidewalk": "separate"}, {"sidewalk:left": "separate"}, {"sidewalk:left": "separate", "sidewalk": "right"}, {"sidewalk:both": "separate"}, {"sidewalk": "both"}, {}, {"sidewalk:left": "separate", "sidewalk:right": "no"}]
    assert tags(spark, cases, junctions.pavements_apart) == [True, True, False, True, False, False, True]
    assert tags(spark, [{"highway": "path", "lit": "yes"}, {}], junctions.character) == ["path||yes", "||"]
    r = spark.createDataFrame([([(1.0, 2.0)], [(1.0000001, 2.0), (3.0, 3.0)]), ([(1.0, 2.0)], [(1.1, 2.0)])], "a array<struct<lat:double,lon:double>>, b array<struct<lat:double,lon:double>>").select(junctions.share_node(F.col("a"), F.col("b")).alias("s")).collect()
    assert [x.s for x in r] == [True, False]


def roads(spark, ways):
    m = 1 / geo.DEGREE_M
    return spark.createDataFrame([(i, t, [(y * m, x * m) for y, x in p]) for i, t, p in ways], "id long, tags map<string,string>, path array<struct<lat:double,lon:double>>")


def test_nodes_and_merging(spark):
    r = {"highway": "residential"}
    ways = [(1, r, [(0, 0), (0, 50), (0, 100)]), (2, r, [(0, 50), (60, 50)]), (3, r, [(0, 62), (-60, 62)]), (4, r, [(0, 100), (0, 200)]), (5, {"highway": "footway", "footway": "crossing"}, [(0, 0), (9, 0)]), (6, r, [(0, 50), (0, 62), (0, 74)]), (7, r, [(0, 74), (30, 74)])]
    found = junctions.nodes(roads(spark, ways))
    at = {(round(x.lat * geo.DEGREE_M), round(x.lon * geo.DEGREE_M)): (x.degree, x.ways) for x in found.collect()}
    assert at == {(0, 50): (2 + 1 + 1, [1, 2, 6]), (0, 62): (1 + 2, [3, 6]), (0, 74): (2, [6, 7]), (0, 100): (2, [1, 4])}
    of = defaultdict(set)
    for x in junctions.merged(found).collect():
        of[x.junction].add(round(x.lon * geo.DEGREE_M))
    assert sorted(map(sorted, of.values())) == [[50, 62, 74], [100]]  # 24 m across


def test_passages(spark):
    m = 1 / geo.DEGREE_M
    r = {"highway": "residential"}
    found = junctions.nodes(roads(spark, [(1, r, [(0, 0), (0, 100), (0, 200)]), (2, r, [(0, 100), (90, 100)])]))
    out_and_back = [*range(60, 145, 5), *range(140, 84, -5), *range(90, 121, 5)]  # past it, back (40 m away between), and again close by
    rows = [(1, float(i), i, 0.0, x * m, 1) for i, x in enumerate(out_and_back)]
    got = junctions.passages(spark.createDataFrame(rows, "track long, t double, idx long, lat double, lon double, way long"), found).orderBy("t").collect()
    assert [g.visit for g in got] == [0, 1] and all(g.d < 1e-6 for g in got)
    assert out_and_back[got[0].idx] == 100 and got[0].exit - got[0].enter == 6
    other = spark.createDataFrame([(1, 0.0, 0, 0.0, 100 * m, 9)], "track long, t double, idx long, lat double, lon double, way long")
    assert junctions.passages(other, found).count() == 0


def items(spark, rows):
    return spark.createDataFrame(rows, "test string, track long, in_a boolean, v double")


def test_permutations(spark):
    rng = np.random.default_rng(3)
    rows = []
    for w in range(6):
        base = rng.normal() * 5
        for i in range(30):
            a = i % 2 == 0
            noise = float(rng.normal())
            rows += [("effect", w, a, base + noise + 1.5 * a), ("none", w, a, base + noise)]
    got = {r.test: r for r in junctions.permutation_tests(junctions.adjusted(items(spark, rows), ["test"]), ["test"]).collect()}
    assert got["effect"].p < 0.001 and (got["effect"].n_a, got["effect"].n_b, got["effect"].walks) == (90, 90, 6)
    for name in got:
        mine = [r for r in rows if r[0] == name]
        grand = np.mean([r[3] for r in mine])
        flat = [(r[2], r[3] - np.mean([q[3] for q in mine if q[1] == r[1]]) + grand) for r in mine]
        a, b = [v for s, v in flat if s], [v for s, v in flat if not s]
        assert got[name].mean_a == pytest.approx(np.mean(a)) and got[name].mean_b == pytest.approx(np.mean(b))
        v, extreme = np.array([x for _, x in flat]).reshape(6, 30), 0
        for _ in range(2000):
            total = sum(rng.permutation(walk)[:15].sum() for walk in v)
            extreme += abs(total / 90 - (v.sum() - total) / 90) >= abs(np.mean(a) - np.mean(b)) - 1e-12
        assert got[name].p == pytest.approx(extreme / 2000, abs=0.03)
    # against all permutations of a small case
    small = [("t", 1, True, 3.0), ("t", 1, False, 1.0), ("t", 1, False, 0.5), ("t", 2, True, 2.0), ("t", 2, False, 2.5), ("t", 2, False, 1.0)]
    p = junctions.permutation_tests(items(spark, small), ["test"]).first().p
    sums = [(x, y) for x in (3.0, 1.0, 0.5) for y in (2.0, 2.5, 1.0)]
    gap = lambda s: s / 2 - (10.0 - s) / 4
    exact = np.mean([abs(gap(x + y)) >= abs(gap(5.0)) - 1e-12 for x, y in sums])
    assert p == pytest.approx(exact, abs=0.02)
    one = junctions.permutation_tests(items(spark, small[:3]), ["test"]).first()
    assert one.p is None
    again = junctions.permutation_tests(items(spark, rows).repartition(7), ["test"]).where("test = 'effect'").first().p
    assert again == junctions.permutation_tests(items(spark, rows).repartition(3), ["test"]).where("test = 'effect'").first().p


def test_paired(spark):
    rng = np.random.default_rng(4)
    rows = [(w, f"j{j}", d, float(rng.normal() + j + (0.9 if d == "turn" else 0))) for w in range(4) for j in range(8) for d in ("turn", "straight", "straight")]
    df = spark.createDataFrame(rows + [(9, "lonely", "turn", 100.0)], "track long, key string, decision string, v double")
    r = junctions.paired_tests(df, "v").first()
    gaps = [np.mean([v for w, j, d, v in rows if (w, j, d) == (a, f"j{b}", "turn")]) - np.mean([v for w, j, d, v in rows if (w, j, d) == (a, f"j{b}", "straight")]) for a in range(4) for b in range(8)]
    assert r.n == 32 and r.mean_difference == pytest.approx(np.mean(gaps)) and r.p < 0.01
    assert junctions.paired_tests(df.where("track = 9"), "v").first().p == 1.0


def test_verdict(spark):
    r = spark.createDataFrame([(0.01, 0.02), (0.01, 0.2), (0.5, 0.6), (None, None)], "p double, q double").select(junctions.verdict(F.col("p"), F.col("q")).alias("v")).collect()
    assert [x.v for x in r] == ["supported", "suggestive", "none", "none"]


def test_a_task_adds_up_its_walks(spark):
    """One row a test is written by a task, not one with all sums for each walk; and subsets drawn are those permutations give."""
    rows = [(f"t{k % 2}", k // 2, i % 2 == 0, float((k * 7 + i * i) % 13)) for k in range(400) for i in range(5)]
    df = spark.createDataFrame(rows, "test string, track long, in_a boolean, v double").coalesce(1).sortWithinPartitions("test", "track")
    got = df.mapInArrow(junctions._permuted(["test"], 1), "test string, n_a long, n long, walks long, sum_a double, total double, sums array<double>").collect()
    assert [(r.test, r.walks, r.n, r.n_a) for r in got] == [("t0", 200, 1000, 600), ("t1", 200, 1000, 600)]
    assert sum(r.total for r in got) == sum(r[3] for r in rows) and sum(r.sum_a for r in got) == sum(r[3] for r in rows if r[2])
    for v, k in ((np.arange(6.0) ** 2, 3), (np.arange(40.0), 15), (np.arange(3.0), 0), (np.arange(3.0), 3)):
        sums = junctions._side_sums(np.random.default_rng(1), v, k)
        spread = math.sqrt(k * (v.size - k) / max(1, v.size - 1) * v.var())
        assert sums.size == 5000 and abs(sums.mean() - k * v.mean()) <= 5 * spread / math.sqrt(5000) and abs(sums.std() - spread) <= 0.05 * spread + 1e-9
