"""Measures of surroundings against a plain pass over all features, rings, classes, and their way along a track."""

import math
from collections import defaultdict

import numpy as np
import pytest

from dermotrace.operators import enrichment as env
from dermotrace.sources.tables import positions
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def tags_of(spark, tags, make):
    return spark.createDataFrame([(tags,)], "tags map<string,string>").select(make(F.col("tags")).alias("v")).first().v


def test_classes(spark):
    cases = {
        "canopy": [{"natural": "wood"}, {"landuse": "forest"}, {"natural": "tree"}, {"natural": "tree_row"}],
        "green": [{"leisure": v} for v in ("park", "garden", "nature_reserve")] + [{"landuse": v} for v in ("grass", "meadow", "recreation_ground", "village_green", "orchard")] + [{"natural": v} for v in ("scrub", "grassland", "heath", "wetland")],
        "water": [{"natural": "water"}] + [{"waterway": v} for v in ("river", "canal", "stream", "drain", "ditch")] + [{"landuse": v} for v in ("basin", "reservoir")],
        "road": [{"highway": v} for v in ("motorway", "primary_link", "living_street", "service", "tertiary_link")], "path": [{"highway": "footway"}], "other": [{"building": "yes"}, {}, {"leisure": "golf_course"}],
    }
    rows = [(want, tags) for want, all_ in cases.items() for tags in all_]
    got = spark.createDataFrame(rows, "want string, tags map<string,string>").select("want", env.feature_class(F.col("tags")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_half_width(spark):
    for tags, want in (({"width": "7 m"}, 3.5), ({"lanes": "4"}, 6.5), ({"highway": "residential"}, 3.25), ({"oneway": "yes"}, 1.625), ({"oneway": "yes", "highway": "trunk_link"}, 3.25), ({"junction": "roundabout", "lanes": "x"}, 1.625), ({"width": "0", "lanes": "1"}, 1.625)):
        assert tags_of(spark, tags, env.half_width) == pytest.approx(want), tags


def test_rings_are_put_together():
    p = lambda *n: (list(n), [{"lat": float(i), "lon": 0.0} for i in n])
    got = env.assembled([p(1, 2, 3), p(9, 8, 9), p(5, 4, 3), p(5, 1), p(20, 21)])
    rings = {tuple(n) for n, _ in got}
    assert (9, 8, 9) in rings and (20, 21) in rings and len(got) == 3
    ring = next(n for n, _ in got if len(n) == 6)
    assert ring[0] == ring[-1] and set(ring) == {1, 2, 3, 4, 5}
    assert all([q["lat"] for q in c] == [float(i) for i in n] for n, c in got)


def flat(a, b):
    return math.hypot((b[0] - a[0]) * 111320, (b[1] - a[1]) * 111320 * math.cos(math.radians(a[0])))


def haversine(a, b):
    s = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(s))


def to_path(p, path):
    k, best = 111320 * math.cos(math.radians(p[0])), math.inf
    for a, b in zip(path, path[1:]):
        ax, ay, dx, dy = (a[1] - p[1]) * k, (a[0] - p[0]) * 111320, (b[1] - a[1]) * k, (b[0] - a[0]) * 111320
        size = dx * dx + dy * dy
        s = min(1, max(0, -(ax * dx + ay * dy) / size)) if size else 0
        best = min(best, math.hypot(ax + s * dx, ay + s * dy))
    return best


def within(p, ring):
    odd = False
    for (y1, x1), (y2, x2) in zip(ring, ring[1:]):
        if (y1 > p[0]) != (y2 > p[0]) and p[1] < (x2 - x1) * (p[0] - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def test_metrics_against_brute_force(spark):
    elements = env.street_elements(spark)
    rows = elements.collect()
    place = {r.id: (r.lat, r.lon) for r in rows if r.type == "node"}
    way = {r.id: (r.nodes, [place[n] for n in r.nodes], r.tags) for r in rows if r.type == "way"}
    features = [("way", t, [(n, c)], []) for n, c, t in way.values() if t]
    for r in rows:
        if r.type == "relation":
            side = lambda inner: [(n, [(q["lat"], q["lon"]) for q in c]) for n, c in env.assembled([(way[m.ref][0], [{"lat": y, "lon": x} for y, x in way[m.ref][1]]) for m in r.members if (m.role == "inner") == inner])]  # noqa: E731, B023
            features.append(("relation", r.tags, side(False), side(True)))
    nodes = [(r.tags, (r.lat, r.lon)) for r in rows if r.type == "node" and r.tags]
    has = lambda t, rules: any(t.get(k) in v for k, v in rules.items())
    closed = lambda w: w[0][0] == w[0][-1] and len(w[1]) > 2

    def covered(p, f):
        return any(closed(o) and within(p, o[1]) and not any(closed(i) and within(p, i[1]) for i in f[3]) for o in f[2])

    points = positions(spark, SF).select("track", "t", "idx", "lat", "lon").where("idx < 160")
    got = {(r.track, r.idx): r for r in env.metrics(points, elements).collect()}
    seen = defaultdict(set)
    for q in points.collect():
        p, g = (q.lat, q.lon), got[q.track, q.idx]
        roads = [(min(to_path(p, c) for _, c in f[2]), f[1]) for f in features if f[0] == "way" and "highway" in f[1] and f[1]["highway"] not in env.NO_ROAD]
        near = min((d, t["highway"]) for d, t in roads)
        vehicle = min(((d, t["highway"]) for d, t in roads if t["highway"] in env.VEHICLES), default=(math.inf, ""))
        cls = vehicle[1] if vehicle[0] <= 25 else near[1] if near[0] <= 150 else "none"
        half = lambda t: (int(t["lanes"]) if "lanes" in t else 1 if t.get("oneway") == "yes" else 2) * 3.25 / 2
        cap = lambda d: d if d <= 150 else 999.0
        major = cap(min((max(0, d - half(t)) for d, t in roads if t["highway"] in env.MAJOR and d <= 150), default=math.inf))
        all_d = lambda f: min(to_path(p, c) for _, c in f[2] + f[3])
        buildings = sum("building" in f[1] and min(to_path(p, c) for _, c in f[2]) <= 50 for f in features)
        water = cap(min(all_d(f) for f in features if has(f[1], env.WATER)))
        in_park = any(has(f[1], env.GREEN) and covered(p, f) for f in features)
        green = 0.0 if in_park else cap(min(all_d(f) for f in features if has(f[1], env.GREEN)))
        trees = sum(t.get("natural") == "tree" and haversine(p, c) <= 50 for t, c in nodes)
        shops = sum(("amenity" in t or t.get("highway") == "bus_stop") and haversine(p, c) <= 50 for t, c in nodes)
        shops += sum("shop" in f[1] and haversine(p, tuple(np.mean(f[2][0][1], axis=0))) <= 50 for f in features)
        leaf = sunny = 0.0
        for r, n in ((0, 1), (1, 8), (2, 16)):
            for k in range(n):
                a = 2 * math.pi * k / n
                s = (p[0] + 25 * r * math.sin(a) / 111320, p[1] + 25 * r * math.cos(a) / (111320 * math.cos(math.radians(p[0]))))
                w = 0.0625 if not r else (min(1, (r + 0.5) / 2) ** 2 - ((r - 0.5) / 2) ** 2) / n
                sunny += w * any(has(f[1], env.GREEN) and covered(s, f) for f in features)
                shade = any(has(f[1], env.CANOPY) and covered(s, f) for f in features) or any(f[1].get("natural") == "tree_row" and all_d_of(s, f) <= 10 for f in features) or any(t.get("natural") == "tree" and haversine(s, c) <= 10 for t, c in nodes)
                leaf += w * shade
        want = (cls, major, int(in_park), sunny * 100, green, leaf * 100, buildings, water, trees, shops)
        mine = tuple(g[c] for c in env.TIMELINE)
        for c, a, b in zip(env.TIMELINE, mine, want):
            assert a == (pytest.approx(b, abs=1e-6) if not isinstance(b, str) else b), (c, q, mine, want)
            seen[c].add(a)
    assert all(len(v) > 1 for v in seen.values()), {k: len(v) for k, v in seen.items()}


def all_d_of(p, f):
    return min(to_path(p, c) for _, c in f[2])


def test_projected(spark):
    rows = spark.createDataFrame([(1, float(i), i, None if i in (0, 9) else 1.0, None if i in (0, 9) else 1.0) for i in range(10)], "track long, t double, idx long, lat double, lon double")
    base = dict(road_class="a", dist_major=10.0, in_park=0, green_pct=0.0, dist_green=999.0, canopy_pct=4.0, building_density=1, dist_water=5.0, tree_density=0, amenity_count=0)
    other = base | dict(road_class="b", dist_major=30.0, in_park=1, green_pct=100.0, dist_green=20.0, building_density=3)
    m = spark.createDataFrame([dict(track=1, idx=2, **base), dict(track=1, idx=6, **other)], "track long, idx long, road_class string, dist_major double, in_park int, green_pct double, dist_green double, canopy_pct double, building_density long, dist_water double, tree_density long, amenity_count long")
    got = {r.idx: r for r in env.projected(rows, m).collect()}
    assert got[0].road_class is None and got[9].green_pct is None and got[1].dist_major == 10.0 and got[8].dist_major == 30.0
    assert [got[i].dist_major for i in (2, 3, 4, 5, 6)] == [10, 15, 20, 25, 30]
    assert [got[i].road_class for i in (3, 4)] == ["a", "b"] and [got[i].dist_green for i in (3, 4)] == [999.0, 20.0] and got[3].canopy_pct == 4.0
    one = {r.idx: r.road_class for r in env.projected(rows, m.where("idx = 2")).collect()}
    assert one[1] == one[8] == "a" and one[0] is None


def test_forward_filled(spark):
    df = spark.createDataFrame([(1, 0.0, 0, 5.0, True), (1, 1.0, 1, None, False), (1, 2.0, 2, None, True), (1, 3.0, 3, None, False), (1, 4.0, 4, 7.0, True), (1, 5.0, 5, None, False)], "track long, t double, idx long, v double, here boolean")
    assert [r.v for r in env.forward_filled(df, "v").orderBy("idx").collect()] == [5, 5, 5, 5, 7, 7]
    assert [r.v for r in env.forward_filled(df, "v", F.col("here")).orderBy("idx").collect()] == [5, 5, None, None, 7, 7]


def test_places_are_no_small_side_of_a_join(spark, tmp_path):
    """The plan takes rows of a compressed file, 25 places each, for some bytes; they were sent to the driver whole."""
    spark.range(3000).selectExpr("id % 7 as track", "id * 1.0D as t", "id as idx", "51.5 + id % 5 * 1e-3 as lat", "-0.1 + id % 5 * 1e-3 as lon").write.parquet(f"{tmp_path}/rows")
    points = spark.read.parquet(f"{tmp_path}/rows")
    got = env.metrics(points, env.street_elements(spark))
    plan, sent = got._jdf.queryExecution().executedPlan().toString().splitlines(), []
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            depth = line.index("BroadcastExchange")
            below = next((k for k in range(i + 1, len(plan)) if len(plan[k]) - len(plan[k].lstrip(" :+-")) <= depth), len(plan))
            sent += [k for k in plan[i:below] if f"{tmp_path.name}/rows" in k]
    assert not sent
    rows = got.collect()
    assert len(rows) == 3000 and len({r[3:] for r in rows}) <= 5


def test_rows_without_a_place_stay(spark):
    points = spark.createDataFrame([(1, 0.0, 1, None, None), (1, 1.0, 2, 51.5, -0.1), (2, 1.0, 2, 51.5, -0.1)], "track long, t double, idx long, lat double, lon double")
    got = {(r.track, r.idx): r for r in env.metrics(points, env.street_elements(spark)).collect()}
    assert len(got) == 3 and got[1, 1].road_class == "none" and got[1, 1].dist_major == 999.0 and got[1, 2][3:] == got[2, 2][3:]
