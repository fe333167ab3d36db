"""Rings of bands and contour lines against plain loops over squares."""

import math
from collections import defaultdict

import numpy as np
import pytest

from dermotrace.operators import isobands as ib


def frame(spark, cells):
    return spark.createDataFrame([(y, x, None if v is None else float(v)) for (y, x), v in cells.items()], "cy long, cx long, v double")


def cells_of(values, y0=0, x0=0):
    return {(y0 + y, x0 + x): v for y, row in enumerate(values) for x, v in enumerate(row)}


def squares(cells):
    there = {k for k, v in cells.items() if v is not None and not math.isnan(v)}
    return [k for k in there if {(k[0] + y, k[1] + x) for y, x in ib.PLACES} <= there]


def clipped(cells, square, low, high):
    """Polygons of a square's band: the sides clipped, saddles opened or closed by the middle; for areas."""
    pts = [(square[1] + x, square[0] + y, cells[square[0] + y, square[1] + x]) for y, x in ib.PLACES]

    def over(level):
        """Area of the part at or above a level."""
        up = [v >= level for *_, v in pts]
        if up[0] == up[2] and up[1] == up[3] and up[0] != up[1]:
            middle = sum(v for *_, v in pts) / 4 >= level
            # the corners that stand alone: high ones under a low middle, low ones under a high middle
            total = 0.0
            for i in range(4):
                if up[i] != middle:
                    v, p, q = pts[i][2], pts[(i + 1) % 4][2], pts[(i + 3) % 4][2]
                    total += abs((level - v) / (p - v) * (level - v) / (q - v)) / 2
            return 1 - total if middle else total
        ring = []
        for i in range(4):
            (x1, y1, v1), (x2, y2, v2) = pts[i], pts[(i + 1) % 4]
            if up[i]:
                ring.append((x1, y1))
            if up[i] != up[(i + 1) % 4]:
                s = (level - v1) / (v2 - v1)
                ring.append((x1 + s * (x2 - x1), y1 + s * (y2 - y1)))
        return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2

    return (over(low) if low is not None else 1.0) - (over(high) if high is not None else 0.0)


def inside(y, x, ring):
    odd = False
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
            odd = not odd
    return odd


def got(spark, cells, at):
    rings, points = ib.isobands(frame(spark, cells), at)
    shape = defaultdict(list)
    for r in points.collect():
        shape[r.ring].append((r.step, r.y, r.x))
    of = {}
    for ring, pts in shape.items():
        pts.sort()
        assert [p[0] for p in pts] == list(range(len(pts)))
        of[ring] = [p[1:] for p in pts]
    return {r.ring: r for r in rings.collect()}, of


def test_random_grids_with_holes(spark):
    """Five grids in one table: areas of bands, closed steps of at most a cell, and the ring around each hole."""
    at, rng, cells = [0.3, 0.5, 0.7], np.random.default_rng(5), {}
    for k, (n, gone) in enumerate(((9, 0.0), (12, 0.05), (12, 0.2), (15, 0.1), (3, 0.0))):
        v = rng.random((n, n))
        cells |= cells_of([[None if rng.random() < gone else float(x) for x in row] for row in v], 30 * k - 40, -20)
    rings, shape = got(spark, cells, at)
    assert set(rings) == set(shape) and any(r.hole for r in rings.values())
    sq = squares(cells)
    for band in range(4):
        low, high = (at[band - 1] if band else None), (at[band] if band < 3 else None)
        assert sum(r.area for r in rings.values() if r.band == band) == pytest.approx(sum(clipped(cells, s, low, high) for s in sq))
    assert sum(r.area for r in rings.values()) == pytest.approx(len(sq))
    for name, ring in shape.items():
        r = rings[name]
        assert len(ring) == r.n
        for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1], strict=True):
            assert max(abs(y1 - y2), abs(x1 - x2)) <= 1 + 1e-9
        area = sum(x1 * y2 - x2 * y1 for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1], strict=True)) / 2
        assert area == pytest.approx(r.area) and r.hole == (area < 0)
        if not r.hole:
            assert r.part_of == name
            continue
        # a place of the band beside the hole's longest edge lies in the ring that is named, and in none of that ring's holes
        (y1, x1), (y2, x2) = max(zip(ring, ring[1:] + ring[:1], strict=True), key=lambda e: math.dist(*e))
        d = math.dist((y1, x1), (y2, x2))
        y, x = (y1 + y2) / 2 + 1e-7 * (x2 - x1) / d, (x1 + x2) / 2 - 1e-7 * (y2 - y1) / d
        around = [o for o, q in rings.items() if q.band == r.band and not q.hole and inside(y, x, shape[o])]
        assert r.part_of == min(around, key=lambda o: rings[o].area)
        assert not any(inside(y, x, shape[o]) for o, q in rings.items() if q.hole and q.part_of == r.part_of)


def test_masks(spark):
    flat = [[1.0] * 6 for _ in range(6)]
    hole = cells_of(flat)
    hole[2, 2] = None
    # two squares that touch at a corner are two rings
    hole |= cells_of([[1, 1, None], [1, 1, 1], [None, 1, 1]], 20, 0)
    rings, _ = got(spark, hole, [0.5])
    assert sorted((r.band, r.hole, r.area, r.n) for r in rings.values()) == [(1, False, 1.0, 4), (1, False, 1.0, 4), (1, False, 25.0, 20), (1, True, -4.0, 8)] and len({r.part_of for r in rings.values()}) == 3
    # an island in a hole, values at the level, a NaN cell
    peak = cells_of([[0, 0, 0, 0, 0], [0, 2, 2, 2, 0], [0, 2, 0, 2, 0], [0, 2, 2, 2, 0], [0, 0, 0, 0, 0]]) | {(9, 9): float("nan")}
    rings, _ = got(spark, peak, [1.0, 2.0])
    assert sorted((r.band, r.hole) for r in rings.values()) == [(0, False), (0, False), (0, True), (1, False), (1, False), (1, True), (1, True), (2, False), (2, True)]
    assert sum(r.area for r in rings.values()) == pytest.approx(16)
    assert got(spark, {(0, 0): 1.0, (5, 5): None}, []) == ({}, {})


def test_lines(spark):
    slope = cells_of([[x for x in range(6)] for _ in range(4)]) | cells_of([[-(x * x) - y * y for x in range(-4, 5)] for y in range(-4, 5)], 20, 20)
    lines = ib.contour_lines(frame(spark, slope), [-9.5, 2.5]).collect()
    by = {(r.level, r.closed): r.points for r in lines}
    assert len(lines) == 2 and [(p.y, p.x) for p in by[2.5, False]] == [(y, 2.5) for y in (3, 2, 1, 0)]
    ring = by[-9.5, True]
    assert ring[0] == ring[-1] and len(set(ring)) == len(ring) - 1
    assert sum(a.x * b.y - b.x * a.y for a, b in zip(ring, ring[1:], strict=False)) > 0


def test_long_chains_and_cycles(spark):
    n = 3000
    links = [(f"c{i:05d}", f"c{(i + 1) % n:05d}") for i in range(n)] + [(f"p{i:05d}", f"p{i + 1:05d}" if i < 999 else None) for i in range(1000)] + [("t", "p00500"), ("o", "o")]
    rows = {r.key: r for r in ib.followed(spark.createDataFrame(links, "key string, nxt string")).collect()}
    assert all((r.chain, r.steps, r.closed) == ("c00000", (n - int(k[1:])) % n, True) for k, r in rows.items() if k[0] == "c")
    assert all((r.chain, r.steps, r.closed) == ("p00999", 999 - int(k[1:]), False) for k, r in rows.items() if k[0] == "p")
    assert (rows["t"].chain, rows["t"].steps, rows["o"].chain, rows["o"].closed) == ("p00999", 500, "o", True)
