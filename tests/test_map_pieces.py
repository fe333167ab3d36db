"""Map matching in pieces: the same as one pass, whatever the width, and what its terms are for."""

import itertools
import math
import random

import pyarrow as pa
import pytest

from dermotrace.functions import geo
from dermotrace.operators import junction_turns, map_pieces

M = 1 / geo.DEGREE_M
POINTS = "track long, t double, idx long, lat double, lon double, speed double"


def roads(spark, ways):
    return spark.createDataFrame([(i, [(y * M, x * M) for y, x in p]) for i, p in ways], "way long, nodes array<struct<lat:double,lon:double>>")


def fixes(spark, rows):
    return spark.createDataFrame([(k, float(t), i, y * M, x * M, v) for i, (k, t, y, x, v) in enumerate(rows)], POINTS)


GRID = [(k, [(60 * k, 60 * x) for x in range(8)]) for k in range(8)] + [(10 + k, [(60 * y, 60 * k) for y in range(8)]) for k in range(8)]


def stroll(rng, n, track):
    y, x, out, t = 180.0, 180.0, [], 0
    dy, dx = 0, 2
    for i in range(n):
        if round(y) % 60 == 0 and round(x) % 60 == 0 and rng.random() < 0.6:
            dy, dx = rng.choice([(0, 2), (2, 0), (0, -2), (-2, 0)])
        y, x = min(max(y + dy, 0), 420), min(max(x + dx, 0), 420)
        t += 1 if i % 90 else 60
        out.append((track, t, y + rng.gauss(0, 4), x + rng.gauss(0, 4), None if i % 3 else 1.9))
    return out


def test_any_width_is_one_pass(spark):
    rng = random.Random(1)
    rows = stroll(rng, 230, 1) + stroll(rng, 65, 2) + stroll(rng, 1, 3) + [(1, 400, 180, 180, None), (1, 4000, 20, 20, None), (1, 4001, 21, 22, None)]
    points, ways = fixes(spark, rows).cache(), roads(spark, GRID).cache()
    got = [sorted(tuple(r) for r in map_pieces.matched(points, ways, width).collect()) for width in (10_000, 7)]
    assert len(got[0]) == len(rows) and got[1] == got[0]


def score(points, path, graph):
    """The weight of a path of (way, seg, lat, lon, off, share), from the description."""
    total = 0.0
    for k, (c, p) in enumerate(zip(path, points)):
        total += -0.5 * (c["d"] / 4.07) ** 2 - math.log(4.07 * math.sqrt(2 * math.pi)) - c["penalty"]
        if k:
            total += graph(k, path[k - 1], c)
    return total


def test_the_likeliest_of_all_paths(spark):
    """Every path through all candidates of a short walk, weighed by the piece's own steps; and steps restated for two straight roads."""
    rng = random.Random(3)
    rows = [(1, i, 4 + rng.gauss(0, 4), 6.0 * i, 1.4) for i in range(7)]
    ways = [(1, [(0, -50), (0, 100)]), (2, [(12, -50), (12, 100)])]
    got = map_pieces.matched(fixes(spark, rows), roads(spark, ways), 3).orderBy("idx").collect()
    y = {1: 0.0, 2: 12.0}

    def weight(path):
        total = 0.0
        for k, w in enumerate(path):
            off = abs(rows[k][2] - y[w])
            a, b = rows[max(0, k - 1)], rows[min(len(rows) - 1, k + 1)]
            angle = abs(math.degrees(math.atan2(b[2] - a[2], b[3] - a[3])))
            total += -0.5 * (off / 4.07) ** 2 - math.log(4.07 * math.sqrt(2 * math.pi)) - min(6, 0.5 * (max(0, angle - 10) / 20) ** 2)
            if k:
                gone = math.hypot(rows[k][2] - rows[k - 1][2], 6)
                route = 6.0 if w == path[k - 1] else math.inf
                step = abs(rows[k][2] - rows[k - 1][2] - (y[w] - y[path[k - 1]]))
                apart = 1000 if route == math.inf else abs(gone - route) + max(0, route - (2.4 + 5))
                total += -(apart + step) / 3 - math.log(3)
        return total

    best = max(itertools.product((1, 2), repeat=len(rows)), key=weight)
    assert tuple(r.way for r in got) == best


def test_heading_keeps_the_main_road(spark):
    """Passing a side road, a fix nearer to it than to the road walked stays on the road."""
    rows = [(1, 3 * i, 3.0 if x != 100 else 9.0, float(x), 1.4) for i, x in enumerate(range(40, 161, 5))]
    ways = [(1, [(0, 0), (0, 100), (0, 200)]), (2, [(0, 100), (80, 100)])]
    assert {r.way for r in map_pieces.matched(fixes(spark, rows), roads(spark, ways)).collect()} == {1}


def test_whole_walk(spark):
    """The events' walk: every point gets a place on a street within reach, whatever the width."""
    sf = "/root/testdata/sf0.001"
    n = junction_turns.street_walk(spark, sf).count()
    got = map_pieces.QUERIES["map_pieces"](spark, sf).collect()
    assert len(got) == n and all(r.off_m <= 40 for r in got)
    true = {(r.track, r.idx): r.way for r in junction_turns.street_walk(spark, sf).collect()}
    assert sum(true[r.track, r.idx] == r.way for r in got) > 0.9 * n


def test_ways_on_one_another(spark):
    """A hundred ways on each street: the nearest ten candidates are those of all, and a piece has each road once."""
    ways = [(k, [(60 * (k % 3), 60 * x) for x in range(5)]) for k in range(300)]
    segs = map_pieces.segments(roads(spark, ways))
    points = fixes(spark, [(1, k, 7.0 * k, 11.0 * k, None) for k in range(20)])
    got = sorted((r.idx, r["rank"], r.way, r.seg) for r in map_pieces.candidates(points, segs).collect())
    all_ = map_pieces.candidates(points, segs, most=1 << 30)
    assert got == sorted((r.idx, r["rank"], r.way, r.seg) for r in all_.where("rank <= 10").collect()) and len(got) == 200
    pieces = points.selectExpr("track", "0L as piece", "lat", "lon")
    assert map_pieces._roads_near(pieces, segs).count() == 12
    bounded = map_pieces.candidates(points, segs)._jdf.queryExecution().optimizedPlan().toString()
    assert "_copy" in bounded


def test_pieces_over_tasks_are_one_pass(spark):
    """Tracks in pieces of any width, dealt to tasks, and whole tracks in one: the same, with stretches off the streets and ways on one another."""
    rng = random.Random(7)
    rows = stroll(rng, 150, 1) + stroll(rng, 40, 2) + [(3, k, 5000.0, 5000.0 + k, None) for k in range(9)] + stroll(rng, 1, 4)
    rows = [(k, t, y + (3000 if 20 <= i % 50 < 23 or 60 < i < 76 else 0), x, v) for i, (k, t, y, x, v) in enumerate(rows)]
    points, ways = fixes(spark, rows).cache(), roads(spark, GRID + [(100 + k, p) for k, p in GRID[:5]]).cache()
    off = sum(y > 1000 for _, _, y, _, _ in rows)
    want = sorted(tuple(r) for r in map_pieces.matched(points, ways).collect())
    assert len(want) == len(rows) - off and off > 30
    for width, whole in ((7, 0), (64, 45), (7, 1000)):
        assert sorted(tuple(r) for r in map_pieces.matched(points, ways, width, whole).collect()) == want, (width, whole)


def test_points_go_to_tasks_once_and_roads_with_them(spark):
    """300 walks on one grid, each street there 30 times: a task gets its points, no candidates, and each place of a road once with ten names."""
    seen = spark.sparkContext.accumulator(0)
    most = spark.sparkContext.accumulator(0)
    was = map_pieces._whole

    def counted(rows, found, width):
        seen.add(rows.num_rows)
        most.add(len(found.a) > 112 or len(found.way) > 160 * 7 or int(found.copies.max()) > 10)
        return was(rows, found, width)

    rng = random.Random(2)
    rows = [r for k in range(300) for r in stroll(rng, 20, k)]
    ways = [(100 * copy + k, p) for k, p in GRID for copy in range(30)]
    map_pieces._whole = counted
    try:
        got = map_pieces.matched(fixes(spark, rows), roads(spark, ways)).collect()
    finally:
        map_pieces._whole = was
    assert len(got) == len(rows) == seen.value and most.value == 0
    assert {r.way // 100 for r in got} <= set(range(10))


def test_a_street_across_180_degrees(spark):
    """The same walk on the same streets gets the same ways at any longitude."""
    rng = random.Random(5)
    rows = [(1, 2.0 * k, rng.gauss(0, 5), 4.0 * k - 100, 2.0) for k in range(50)]
    ways = [(1, [(0, -150), (0, 150)]), (2, [(14, -150), (14, -90), (14, 150)])]
    wrap = lambda lon: (lon + 180) % 360 - 180
    found = []
    for east in (0.0, 180.0):
        points = spark.createDataFrame([(k, t, i, y * M, wrap(x * M + east), v) for i, (k, t, y, x, v) in enumerate(rows)], POINTS)
        lines = spark.createDataFrame([(i, [(y * M, wrap(x * M + east)) for y, x in p]) for i, p in ways], "way long, nodes array<struct<lat:double,lon:double>>")
        found.append([(r.idx, r.way, r.seg) for r in map_pieces.matched(points, lines).orderBy("idx").collect()])
    assert found[0] == found[1] and {w for _, w, _ in found[0]} == {1}


def test_pairs_are_weighed_some_at_a_time(monkeypatch):
    """On dense streets a point has ten candidates, a step a hundred pairs: no slice has more than it may, and the result is the same."""
    rng = random.Random(4)
    n = 60
    rows = {"track": [0] * n, "part": [0] * n, "idx": list(range(n)), "t": [40.0 * k for k in range(n)], "heading": pa.nulls(n, pa.float64()), "speed": [1.0] * n, "scale": [geo.DEGREE_M] * n}
    rows = pa.table(rows | {c: [rng.uniform(20, 80) * M for _ in range(n)] for c in ("lat", "lon")})
    segs = [(10 * k * M, 10 * x * M, 10 * k * M, 10 * (x + 1) * M, 90.0, [{"way": k, "seg": x}]) for k in range(10) for x in range(10)]
    names = pa.list_(pa.struct([("way", pa.int64()), ("seg", pa.int32())]))
    ways = pa.table([*(pa.array(c) for c in list(zip(*segs, strict=True))[:5]), pa.array([s[5] for s in segs], names)], names=["lat", "lon", "t", "speed", "heading", "names"])
    want = map_pieces._whole(rows, map_pieces._Roads(ways), 7)
    sizes = []
    monkeypatch.setattr(map_pieces, "PAIRS", 500)
    monkeypatch.setattr(map_pieces._Walks, "_weighed", lambda self, start, count, *rest, was=map_pieces._Walks._weighed: sizes.append(int(count.sum())) or was(self, start, count, *rest))
    assert map_pieces._whole(rows, map_pieces._Roads(ways), 7).equals(want) and want.num_rows == n
    assert len(sizes) > 5 and max(sizes) <= 500 and sum(sizes) == 100 * (n - 1)
