"""Passages, their decisions and controls against a walk written as loops, on small streets and on the events' own walk."""

import math
from collections import Counter

import pytest

import oracle
from dermotrace.functions import geo
from dermotrace.operators import junction_turns, junctions

M = 1 / geo.DEGREE_M
ROAD, SF = {"highway": "residential"}, "/root/testdata/sf0.001"


def far(a, b):
    y1, y2, dx = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    return 2 * geo.RADIUS_M * math.asin(math.sqrt(min(1, math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin(dx / 2) ** 2)))


def heading(a, b):
    y1, y2, dx = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    return math.degrees(math.atan2(math.sin(dx) * math.cos(y2), math.cos(y1) * math.sin(y2) - math.sin(y1) * math.cos(y2) * math.cos(dx))) % 360


def bend(a, b, c, d):
    return (heading(c, d) - heading(a, b) + 180) % 360 - 180


def name(turn):
    return "straight" if abs(turn) <= 25 else "reverse" if abs(turn) >= 135 else "turn" if abs(turn) >= 40 else "ambiguous"


def judged(fix, a, b, c, d):
    at, raw = [(fix[i]["lat"], fix[i]["lon"]) for i in (a, b, c, d)], [(fix[i]["raw_lat"], fix[i]["raw_lon"]) for i in (a, b, c, d)]
    turn, other = bend(*at), None if any(x is None for p in raw for x in p) else bend(*raw)
    return turn, other, name(turn) if other is None or name(other) == name(turn) else "ambiguous"


def plain_walk(fix, nodes, tags, with_controls):
    """One track's passages, or its controls: fixes and nodes are dicts, tags by way."""
    n, at = len(fix), [(f["lat"], f["lon"]) for f in fix]
    s = [0.0]
    for a, b in zip(at, at[1:]):
        s.append(s[-1] + far(a, b))
    on = [f["way"] is not None and not (f["dist"] is not None and f["dist"] > 20) for f in fix]
    look = lambda w: "|".join(tags.get(w, {}).get(k, "") for k in ("highway", "surface", "lit"))
    pavement = lambda w: tags.get(w, {}).get("highway") == "footway" and tags[w].get("footway") in ("sidewalk", "crossing")
    ends = lambda i, stop: (min(j for j in range(n) if s[j] > s[i] - 25 and not any(stop(k) for k in range(j, i))), max(j for j in range(n) if s[j] < s[i] + 25 and not any(stop(k) for k in range(i + 1, j + 1))))
    lone = []
    for node in nodes:
        d = [far(p, (node["lat"], node["lon"])) for p in at]
        group = []
        for i in range(n + 1):
            if i < n and d[i] <= 30:
                group.append(i)
                continue
            hits = sorted((d[k], k) for k in group if on[k] and d[k] <= 15 and (fix[k]["way"] in node["own_ways"] or pavement(fix[k]["way"])))
            group = []
            for _, k in hits:
                a, b = ends(k, lambda _: False)
                if s[k] - s[a] < 15 or s[b] - s[k] < 15:
                    continue

                def main(lo, hi):
                    seen = Counter(fix[x]["way"] for x in range(lo, hi + 1) if on[x])
                    own = {w: c for w, c in seen.items() if w in node["ways"]} or seen
                    return max(own, key=lambda w: own[w])  # the first met of equals

                way_in, way_out = main(a, k), main(k, b)
                choice, change = node["degree"] >= 3, look(way_in) != look(way_out)
                if choice or change:
                    turn, raw, decision = judged(fix, a, k, k, b)
                    lone.append(dict(i=k, node=node["key"], key=node["junction"], a=a, b=b, choice=choice, change=change, degree=node["degree"], way_in=way_in, way_out=way_out, decision=decision))
                    break
    lone.sort(key=lambda p: (p["i"], p["node"]))
    groups = []
    for p in lone:
        if groups and s[p["i"]] - s[groups[-1][-1]["i"]] <= 20 and s[p["i"]] - s[groups[-1][0]["i"]] <= 25:
            groups[-1].append(p)
        else:
            groups.append([p])
    out = []
    for g in groups:
        a, b, first, last = min(p["a"] for p in g), max(p["b"] for p in g), g[0], g[-1]
        turn, raw, decision = judged(fix, a, first["i"], last["i"], b)
        kind = "+".join(x for x in ("choice", "change") if any(p[x] for p in g))
        out.append((first["i"], min(p["key"] for p in g), kind, max(p["degree"] for p in g), decision, round(turn, 4), first["way_in"], last["way_out"], len(g), fix[first["i"]]["t"], fix[last["i"]]["t"], s[a], s[b]))
    if not with_controls:
        return [x[:-2] for x in out]
    spots = []
    for i in range(n):
        away = min((max(x[-2] - s[i], s[i] - x[-1], 0) for x in out), default=math.inf)
        if not on[i] or fix[i]["way"] not in tags or away < 30 or any(far(at[i], (m["lat"], m["lon"])) < 30 for m in nodes):
            continue
        a, b = ends(i, lambda k: fix[k]["way"] != fix[i]["way"])
        if s[i] - s[a] >= 15 and s[b] - s[i] >= 15 and judged(fix, a, i, i, b)[2] == "straight":
            spots.append((-away, i))
    kept = []
    for _, i in sorted(spots):
        if all(abs(s[i] - s[k]) >= 25 for k in kept):
            kept.append(i)
    return [(i, f"ctrl_{fix[i]['way']}_{fix[i]['idx']}", "control", 2, "control", fix[i]["way"], 1) for i in sorted(kept)]


def roads(spark, ways):
    return spark.createDataFrame([(i, t, [(y * M, x * M) for y, x in p]) for i, t, p in ways], "id long, tags map<string,string>, path array<struct<lat:double,lon:double>>")


def fixes(spark, tracks):
    """Tracks of (y, x, way[, dist[, raw y, raw x]]) in metres."""
    rows = [(k, float(i), i, p[0] * M, p[1] * M, p[2], float(p[3]) if len(p) > 3 else None, *((p[4] * M, p[5] * M) if len(p) > 4 else (None, None))) for k, track in enumerate(tracks) for i, p in enumerate(track)]
    return spark.createDataFrame(rows, "track long, t double, idx long, lat double, lon double, way long, dist double, raw_lat double, raw_lon double")


W, E, SIDE = 1, 2, 3
THREE = [(W, ROAD, [(0, 0), (0, 100)]), (E, ROAD, [(0, 100), (0, 200)]), (SIDE, ROAD, [(0, 100), (100, 100)])]


def along(step=4.0, back=False):
    xs = [60 + step * i for i in range(int(80 / step) + 1)]
    return [(0, x, W if x < 100 else E) for x in (xs[::-1] if back else xs)]


def got(spark, tracks, ways, controls=False):
    return junction_turns.classified(fixes(spark, tracks), roads(spark, ways), controls).orderBy("track", "i").collect()


def test_decisions(spark):
    turn = [(0, x, W) for x in range(60, 100, 4)] + [(y, 100, SIDE) for y in range(0, 41, 4)]
    reverse = [(0, x, W) for x in range(60, 101, 4)] + [(0, x, W) for x in range(96, 59, -4)]
    tracks = [along(), turn, reverse, [(*p, 0, 0, 60 + 4 * i) for i, p in enumerate(turn)], along()[9:11], along() + along(back=True), [(*p, 35) for p in along()], along(1.5), along(3), along(4.5), along(1.5) + along(1.5, True)]
    out = got(spark, tracks, THREE)
    by = {k: [r for r in out if r.track == k] for k in range(len(tracks))}
    assert {k: [r.decision for r in v] for k, v in by.items()} == {0: ["straight"], 1: ["turn"], 2: ["reverse"], 3: ["ambiguous"], 4: [], 5: ["straight"] * 2, 6: [], 7: ["straight"], 8: ["straight"], 9: ["straight"], 10: ["straight"] * 2}
    assert all(r.kind == "choice" and r.degree == 3 for r in out)
    assert abs(by[1][0].turn + 90) < 15 and (by[1][0].in_way, by[1][0].out_way) == (W, SIDE) and abs(by[3][0].raw_turn) < 15


def test_kinds(spark):
    path = {"highway": "footway"}
    assert [r.kind for r in got(spark, [along()], [(W, ROAD, [(0, 0), (0, 100)]), (E, path, [(0, 100), (0, 200)])])] == ["change"]
    assert got(spark, [along()], THREE[:2]) == []  # a way split in two is no junction
    through = [(W, ROAD, [(0, 0), (0, 100), (0, 200)]), (SIDE, ROAD, [(0, 100), (100, 100)])]
    (r,) = got(spark, [[(0, x, W) for x in range(60, 141, 4)]], through)
    assert (r.degree, r.decision) == (3, "straight")
    walk = [(5, x, 9) for x in range(60, 141, 4)]  # a pavement beside the road meets its nodes
    assert [r.decision for r in got(spark, [walk], [*THREE, (9, {"highway": "footway", "footway": "sidewalk"}, [(5, 0), (5, 200)])])] == ["straight"]


def test_merging_has_a_span(spark):
    """Nodes 15 m apart along a road: groups of at most 25 m, however long the chain."""
    ways = [(1, ROAD, [(0, x) for x in range(0, 301, 15)])] + [(10 + k, ROAD, [(0, 60 + 15 * k), (50, 60 + 15 * k)]) for k in range(9)]
    out = got(spark, [[(0, x, 1) for x in range(0, 301, 3)]], ways)
    assert sum(r.merged for r in out) == 9 and all(r.span <= 25 for r in out) and [r.merged for r in out] == [2, 2, 2, 2, 1]


def test_controls(spark):
    ways = [(1, ROAD, [(0, 0), (0, 100), (0, 250), (0, 300)]), (2, ROAD, [(0, 100), (50, 100)]), (3, ROAD, [(0, 250), (50, 250)])]
    out = got(spark, [[(0, x, 1) for x in range(0, 301, 3)]], ways, True)
    xs = [round(r.lon / M) for r in out if r.decision == "control"]
    assert [r.decision for r in out].count("straight") == 2 and any(abs(x - 175) <= 6 for x in xs)
    assert all(abs(x - 100) >= 30 and abs(x - 250) >= 30 for x in xs) and all(b - a >= 25 for a, b in zip(xs, xs[1:]))
    near = [(1, ROAD, [(0, 0), (0, 50), (0, 90), (0, 140)]), (2, ROAD, [(0, 50), (50, 50)]), (3, ROAD, [(0, 90), (50, 90)])]
    assert [r for r in got(spark, [[(0, x, 1) for x in range(30, 111, 3)]], near, True) if r.decision == "control"] == []


@pytest.mark.parametrize("controls", [False, True])
def test_whole_walk(spark, controls):
    """Every track of the events, on the streets made of them."""
    points, ways = junction_turns.street_walk(spark, SF), junction_turns.streets(spark, SF)
    nodes = [r.asDict() for r in junction_turns.crossings(ways).collect()]
    tags = {r.id: r.tags for r in ways.collect()}
    tracks = {}
    for r in points.orderBy("track", "t", "idx").collect():
        tracks.setdefault(r.track, []).append(r.asDict())
    want = Counter()
    for track, fix in tracks.items():
        of = [n for n in nodes if abs(n["lat"] - fix[0]["lat"]) < 0.2]
        want.update((track, *x) for x in plain_walk(fix, of, tags, controls))
    out = junction_turns.classified(points, ways, controls)
    if controls:
        made = Counter((r.track, r.i, r.key, r.kind, r.degree, r.decision, r.in_way, r.merged) for r in out.where("decision = 'control'").collect())
    else:
        made = Counter((r.track, r.i, r.key, r.kind, r.degree, r.decision, round(r.turn, 4), r.in_way, r.out_way, r.merged, r.enter, r.exit) for r in out.collect())
    assert made == want and len(want) > 1


def test_nodes_sql(spark):
    oracle.same(junctions.QUERIES["junction_nodes"](spark, SF), junctions.ORACLE_SQL["junction_nodes"], SF)


def test_ways_on_one_another_are_no_list_of_each_point(spark):
    """Visits meet a node's ways as rows: no join carries the list of them along with points."""
    points, ways = junction_turns.street_walk(spark, SF), junction_turns.streets(spark, SF)
    walk, found = junction_turns.walked(points), junction_turns.crossings(ways)
    near = junction_turns.near_nodes(walk, found)
    plan = junction_turns.visits(walk, found, near, ways)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan
