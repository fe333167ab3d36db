"""Queries without SQL over their whole tables, against plain loops."""

import math
from collections import defaultdict

import pytest

from dermotrace import registry
from dermotrace.functions import geo, stats
from dermotrace.operators import spatial
from dermotrace.sources.tables import events, positions

SF = "/root/testdata/sf0.001"


def test_hotspots(spark):
    tracks = defaultdict(list)
    for r in positions(spark, SF).collect():
        if r.value is not None:
            tracks[r.track].append(r)
    want = set()
    for track, rows in tracks.items():
        kept = []
        for r in sorted(rows, key=lambda r: (-r.value, r.idx)):
            if len(kept) == max(1, round(0.02 * len(rows))):
                break
            k = math.cos(math.radians(r.lat))
            if all(math.hypot(q.lat - r.lat, (q.lon - r.lon) * k) * geo.DEGREE_M >= 30 for q in kept):
                kept.append(r)
        want |= {(track, r.idx, i + 1) for i, r in enumerate(kept)}
    assert {(r.track, r.idx, r.rank) for r in registry.queries()["hotspots"](spark, SF).collect()} == want


def test_false_discovery(spark):
    by = defaultdict(lambda: defaultdict(list))
    for r in events(spark, SF).collect():
        if r.value is not None:
            by[r.track][r.kind].append(r.value)
    p = {}
    for track, kinds in by.items():
        a, b = kinds["click"], kinds["view"]
        if len(a) < 2 or len(b) < 2:
            continue
        m = lambda x: sum(x) / len(x)
        v = lambda x: sum((y - m(x)) ** 2 for y in x) / (len(x) - 1) / len(x)
        ea, eb = v(a), v(b)
        p[track] = stats.t_p_value((m(a) - m(b)) / math.sqrt(ea + eb), (ea + eb) ** 2 / (ea**2 / (len(a) - 1) + eb**2 / (len(b) - 1)))
    got = {r.track: r for r in registry.queries()["stats_false_discovery"](spark, SF).collect()}
    assert set(got) == set(p)
    for family in range(5):
        mine = sorted((v, t) for t, v in p.items() if t % 5 == family)
        low = 1.0
        for i in range(len(mine) - 1, -1, -1):
            low = min(low, mine[i][0] * len(mine) / (i + 1))
            r = got[mine[i][1]]
            assert (r.p, r.q) == (pytest.approx(mine[i][0], abs=1e-6), pytest.approx(low, abs=1e-6))


def test_map_matched_is_the_likeliest(spark):
    """Of all sequences of candidates of a short walk the one with the highest likelihood, routes of any length included."""
    from itertools import product

    m = 1 / geo.DEGREE_M
    # two parallel streets joined far away: a route of over 800 m between points 30 m apart
    ways = [(1, [(0.0, x * m) for x in range(0, 401, 100)]), (2, [(30 * m, x * m) for x in range(0, 401, 100)]), (3, [(0.0, 400 * m), (30 * m, 400 * m)])]
    walk = [(12, 10), (16, 20), (13, 30), (17, 45), (14, 60)]
    rows = [(1, float(i * 5), i, y * m, x * m) for i, (y, x) in enumerate(walk)]
    points = spark.createDataFrame(rows, "track long, t double, idx long, lat double, lon double")
    roads = spark.createDataFrame(ways, "way long, nodes array<struct<lat:double,lon:double>>")
    got = [(r.way, r.seg) for r in spatial.map_matched(points, roads).orderBy("idx").collect()]
    options = defaultdict(list)
    for c in spatial.candidates(points, spatial.segments(roads)).collect():
        options[c.idx].append(c)

    def route(p, q, x, y):
        if p.way == q.way:
            return abs(x - y)
        return (400 - x) + 30 + (400 - y)

    best = None
    for chain in product(*(options[i] for i in range(len(walk)))):
        score = -sum(0.5 * (c.d / spatial.SIGMA_M) ** 2 for c in chain)
        for i in range(1, len(walk)):
            gone = math.hypot(walk[i][0] - walk[i - 1][0], walk[i][1] - walk[i - 1][1])
            score -= min(abs(gone - route(chain[i - 1], chain[i], walk[i - 1][1], walk[i][1])), spatial.LOST_M) / spatial.BETA_M
        if best is None or score > best[0] + 1e-9:
            best = (score, [(c.way, c.seg) for c in chain])
    assert got == best[1]


def test_long_walk_searches_its_streets_once(monkeypatch):
    """Six rounds of a block, 10 s a point: each node's routes are searched a few times, over one edge a segment, and the path is right."""
    m, streets = 1 / geo.DEGREE_M, [((0, 0), (0, 100)), ((0, 100), (100, 100)), ((100, 100), (100, 0)), ((100, 0), (0, 0))]
    walk = [(way, s) for _ in range(6) for way in range(4) for s in range(5, 100, 10)]
    rows = []
    for i, (way, s) in enumerate(walk):
        (ay, ax), (by, bx) = streets[way]
        y, x = ay + (by - ay) * s / 100 + i % 3, ax + (bx - ax) * s / 100 - i % 2
        near = sorted((math.hypot(*spatial._project(y * m, x * m, c)[2:]), w, c) for w, c in enumerate({"a_lat": a[0] * m, "a_lon": a[1] * m, "b_lat": b[0] * m, "b_lon": b[1] * m} for a, b in streets))
        rows += [{"track": 1, "t": 10.0 * i, "idx": i, "rank": r, "lat": y * m, "lon": x * m, "way": w, "seg": 0, **c} for r, (d, w, c) in enumerate(near) if d <= 40]
    calls, edges, routes = [], [], spatial.routes
    monkeypatch.setattr(spatial, "routes", lambda graph, start, limit: (calls.append(start), edges.append(sum(map(len, graph.values()))), routes(graph, start, limit))[2])
    got = spatial.viterbi(rows)
    assert len(got) == len(walk) and all(c["way"] == way for c, (way, s) in zip(got, walk) if 10 < s < 90)
    assert len(calls) <= 40 and max(edges) == 8


def test_street_grid_has_a_known_size(spark):
    """Its ways, and that Spark knows they are few: else the points are what is sent to every task."""
    grid = spatial.street_grid(spark)
    got = {r.way: [tuple(p) for p in r.nodes] for r in grid.collect()}
    assert got == {2 * k + a: [(51.5 + 0.0012 * (k if a else j), -0.1 + 0.0012 * (j if a else k)) for j in range(9)] for k in range(9) for a in (0, 1)}
    assert int(str(grid._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20
