"""Grids as rows (cy, cx, v): blur, upsampling, shading, levels and contour lines, all by equi-joins of a cell with its neighbours.

A stencil is exploded from each cell and summed by the cell that it reaches, which combines before the shuffle; a cell
without a value isn't there. Squares of four cells give their own contour segments.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.ranks import at_or_below
from ..sources.tables import POSITIONS_SQL, positions
from .spatial import cell_means

#: Weights of the blur (centre, sides, corners), its rounds, and the light of the shading (degrees).
BLUR, ROUNDS, SUN, HEIGHT = (4.0, 2.0, 1.0), 6, 315.0, 45.0


def _spread(grid: DataFrame, stencil: list[tuple[int, int, float]]) -> DataFrame:
    """(cy, cx, i, j, v): each value at the cells that it is a neighbour of; i, j: where it lies from there, w its weight."""
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in stencil))).alias("s")
    return grid.select("cy", "cx", "v", around).select((F.col("cy") - F.col("s.i")).alias("cy"), (F.col("cx") - F.col("s.j")).alias("cx"), "s.i", "s.j", "s.w", "v")


def blurred(grid: DataFrame, rounds: int = 1) -> DataFrame:
    """Weighted means of the cells around, over those that are there; a cell without a value gets none."""
    stencil = [(i, j, BLUR[abs(i) + abs(j)]) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    for _ in range(rounds):
        met = _spread(grid, stencil).groupBy("cy", "cx").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"), F.max((F.col("i") == 0) & (F.col("j") == 0)).alias("own"))
        grid = met.where("own").drop("own")
    return grid


def _corners(grid: DataFrame) -> DataFrame:
    """(cy, cx, a, b, c, d): squares of four cells: at (0, 0), (0, 1), (1, 1) and (1, 0)."""
    met = _spread(grid, [(0, 0, 1.0), (0, 1, 1.0), (1, 1, 1.0), (1, 0, 1.0)])
    at = lambda i, j: F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("v")))
    return met.groupBy("cy", "cx").agg(at(0, 0).alias("a"), at(0, 1).alias("b"), at(1, 1).alias("c"), at(1, 0).alias("d"), F.count("*").alias("n")).where("n = 4").drop("n")


def upsampled(grid: DataFrame, factor: int) -> DataFrame:
    """``factor`` cells to a side between the centres of four cells, on the bilinear surface; outside such squares nothing."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    fine = _corners(grid).withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    y, x = F.col("i") / factor, F.col("j") / factor
    v = F.col("a") * (1 - y) * (1 - x) + F.col("b") * (1 - y) * x + F.col("c") * y * x + F.col("d") * y * (1 - x)
    return fine.select((F.col("cy") * factor + F.col("i")).alias("cy"), (F.col("cx") * factor + F.col("j")).alias("cx"), v.alias("v"))


def smooth(grid: DataFrame, factor: int) -> DataFrame:
    """``factor`` cells to a side between cells, on the bicubic (Catmull-Rom) surface where all sixteen cells around are there.

    Elsewhere bilinear over those of the four corners that are there, their weights made up to one; nothing where these
    weigh nothing. A cell whose value is null or NaN isn't there.
    """
    around = range(-1, 3)
    met = _spread(grid.where(F.col("v").isNotNull() & ~F.isnan("v")), [(i, j, 1.0) for i in around for j in around])
    at = lambda i, j: F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("v"))).alias(f"v{i}{j}")
    squares = met.groupBy("cy", "cx").agg(F.count("*").alias("n"), *(at(i, j) for i in around for j in around))
    corners = [(0, 0), (0, 1), (1, 0), (1, 1)]
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    fine = squares.where(F.coalesce(*(F.col(f"v{i}{j}") for i, j in corners)).isNotNull()).withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    y, x = F.col("_i") / factor, F.col("_j") / factor
    cubic = lambda t: {-1: (2 * t * t - t * t * t - t) / 2, 0: (3 * t * t * t - 5 * t * t + 2) / 2, 1: (4 * t * t - 3 * t * t * t + t) / 2, 2: (t * t * t - t * t) / 2}
    linear = lambda t: {0: 1 - t, 1: t}
    full = sum(F.col(f"v{i}{j}") * cubic(y)[i] * cubic(x)[j] for i in around for j in around)
    part = sum(F.coalesce(F.col(f"v{i}{j}"), F.lit(0.0)) * linear(y)[i] * linear(x)[j] for i, j in corners)
    weight = sum(F.when(F.col(f"v{i}{j}").isNotNull(), linear(y)[i] * linear(x)[j]).otherwise(0.0) for i, j in corners)
    v = F.when(F.col("n") == 16, full).when(weight > 1e-6, part / weight)
    return fine.select((F.col("cy") * factor + F.col("_i")).alias("cy"), (F.col("cx") * factor + F.col("_j")).alias("cx"), v.alias("v")).where("v is not null")


def corridor(points: DataFrame, step_deg: float, reach_m: float, longest_m: float) -> DataFrame:
    """(cy, cx, d): how far each cell's centre is from the nearest stretch of a walk, for cells within ``reach_m``.

    A stretch joins positions that follow each other in a track; one of over ``longest_m`` is a gap and covers nothing. A
    lone position counts as itself. Stretches are cut where they are longer than a cell, and each piece reaches the
    cells around its middle only, so that a long one doesn't cover the whole box that it spans.
    """
    w = Window.partitionBy("track").orderBy("t", "idx")
    ends = points.where("lat is not null and lon is not null").select("lat", "lon", F.lead("lat").over(w).alias("lat2"), (F.col("lon") + geo.lon_difference(F.col("lon"), F.lead("lon").over(w))).alias("lon2"))
    cell_m = step_deg * geo.DEGREE_M
    long = geo.distance(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    gap = F.coalesce(long > longest_m, F.lit(True))
    ends = ends.select("lat", "lon", *(F.when(gap, F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("lat", "lat2"), ("lon", "lon2"))), F.when(gap, 1).otherwise(F.greatest(F.lit(1), F.ceil(long / cell_m))).alias("parts"))
    ends = ends.distinct()  # a stretch that is walked again is no nearer
    piece = ends.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("parts").cast("int"))))
    on = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * (k / F.col("parts"))
    middle = F.col("k") - 0.5
    y0, x0 = geo.cell(on("lat", "lat2", middle), on("lon", "lon2", middle), step_deg)
    ny = math.ceil(reach_m / cell_m + 0.5) + 1
    nx = F.ceil(ny / F.cos(F.radians(F.least(F.lit(89.9), F.greatest(F.abs("lat"), F.abs("lat2")) + reach_m / geo.DEGREE_M))))
    near = piece.select("lat", "lon", "lat2", "lon2", y0.alias("y0"), x0.alias("x0"), nx.alias("nx"))
    # what several pieces of a stretch reach is measured for each; the least is kept before the shuffle
    near = near.withColumn("cy", F.explode(F.sequence(F.col("y0") - ny, F.col("y0") + ny))).withColumn("cx", F.explode(F.sequence(F.col("x0") - F.col("nx"), F.col("x0") + F.col("nx"))))
    around = round(360 / step_deg)
    near = near.withColumn("cx", F.pmod(F.col("cx") + around // 2, F.lit(around)) - around // 2)
    d = geo.segment_distance((F.col("cy") + 0.5) * step_deg, (F.col("cx") + 0.5) * step_deg, F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return near.withColumn("d", d).where(F.col("d") <= reach_m).groupBy("cy", "cx").agg(F.min("d").alias("d"))


def shaded(grid: DataFrame, size_y: float, size_x: float, azimuth: float = SUN, altitude: float = HEIGHT, exaggeration: float = 1.0) -> DataFrame:
    """(cy, cx, shade): light on the surface from 0 to 1, by differences over eight neighbours; a missing neighbour is as high as the cell."""
    met = _spread(grid, [(i, j, 1.0) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    east = F.col("j") * (2 - F.abs("i"))
    north = F.col("i") * (2 - F.abs("j"))
    g = met.groupBy("cy", "cx").agg(F.max(F.when((F.col("i") == 0) & (F.col("j") == 0), F.col("v"))).alias("own"), F.sum(east * F.col("v")).alias("ev"), F.sum(east).alias("ew"), F.sum(north * F.col("v")).alias("nv"), F.sum(north).alias("nw")).where("own is not null")
    # what is missing counts with the cell's own height
    dx = (F.col("ev") - F.col("ew") * F.col("own")) * exaggeration / (8 * size_x)
    dy = (F.col("nv") - F.col("nw") * F.col("own")) * exaggeration / (8 * size_y)
    zenith, light = math.radians(90 - altitude), math.radians(azimuth)
    flat = F.sqrt(1 + dx * dx + dy * dy)
    # the surface's normal against the light's direction
    shade = (math.cos(zenith) - math.sin(zenith) * (math.sin(light) * dx + math.cos(light) * dy)) / flat
    return g.select("cy", "cx", F.greatest(F.lit(0.0), shade).alias("shade"))


def ranked(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``rank``: the share of values that are as low or lower; by ranges of values, not in one task."""
    below = at_or_below(df.select(value), value)
    return df.join(below.select(value, (F.col("below") / F.col("total")).alias("rank")), value)


def levels(grid: DataFrame, count: int) -> list[float]:
    """Nearest-rank quantiles that split the values into ``count`` + 1 parts: a handful of numbers."""
    below = at_or_below(grid.select("v"), "v")
    n = F.col("total")
    place = F.explode(F.array(*(F.least(n - 1, F.floor(n * k / F.lit(count + 1))) for k in range(1, count + 1)))).alias("place")
    met = below.select("v", "n", "below", place).where((F.col("place") < F.col("below")) & (F.col("place") >= F.col("below") - F.col("n")))
    return [r.v for r in met.select("v", "place").distinct().orderBy("place").collect()]


def contour_segments(grid: DataFrame, at: list[float]) -> DataFrame:
    """(level, y1, x1, y2, x2) in cells: where the surface crosses each level, a square of four cells at a time.

    Opposite corners above and below are joined by the square's mean. A corner at the level counts as above.
    """
    square = _corners(grid).withColumn("level", F.explode(F.array(*map(F.lit, at)) if at else F.array().cast("array<double>")))
    corner = {k: F.col(k) >= F.col("level") for k in "abcd"}
    sides = (("a", "b", 0, 0, 0, 1), ("b", "c", 0, 1, 1, 1), ("c", "d", 1, 1, 1, 0), ("d", "a", 1, 0, 0, 0))

    def crossing(p: str, q: str, y1: int, x1: int, y2: int, x2: int) -> Column:
        s = (F.col("level") - F.col(p)) / (F.col(q) - F.col(p))
        return F.when(corner[p] != corner[q], F.struct((F.col("cy") + y1 + s * (y2 - y1)).alias("y"), (F.col("cx") + x1 + s * (x2 - x1)).alias("x")))

    square = square.withColumns({f"s{i}": crossing(*side) for i, side in enumerate(sides)})
    high = (F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4 >= F.col("level")
    saddle = (corner["a"] == corner["c"]) & (corner["b"] == corner["d"]) & (corner["a"] != corner["b"])
    line = lambda p, q: F.struct(F.col(p).alias("p"), F.col(q).alias("q"))
    # the lines of a saddle go round the corners that the middle isn't joined with
    round_bd, round_ac = F.array(line("s0", "s1"), line("s2", "s3")), F.array(line("s3", "s0"), line("s1", "s2"))
    crossed = F.filter(F.array("s0", "s1", "s2", "s3"), lambda s: s.isNotNull())
    one = F.when(F.size(crossed) == 2, F.array(F.struct(crossed[0].alias("p"), crossed[1].alias("q")))).otherwise(F.array().cast("array<struct<p:struct<y:double,x:double>,q:struct<y:double,x:double>>>"))
    lines = F.when(saddle, F.when(corner["a"] == high, round_bd).otherwise(round_ac)).otherwise(one)
    out = square.select("level", F.explode(lines).alias("l"))
    return out.select("level", F.col("l.p.y").alias("y1"), F.col("l.p.x").alias("x1"), F.col("l.q.y").alias("y2"), F.col("l.q.x").alias("x2"))


def coverage(points: DataFrame, step_deg: float, reach_m: float) -> DataFrame:
    """(cy, cx, cover, rank): for each cell the walks near it, each with its nearest position's closeness, ranked among all cells."""
    lat, lon = F.col("lat"), F.col("lon")
    ny = math.ceil(reach_m / (step_deg * geo.DEGREE_M)) + 1
    cy, cx = geo.cell(lat, lon, step_deg)
    nx = F.ceil(ny / F.cos(F.radians(F.least(F.lit(89.9), F.abs(lat) + reach_m / geo.DEGREE_M))))
    near = points.select("track", lat, lon, cy.alias("y0"), cx.alias("x0"), nx.alias("nx"))
    near = near.withColumn("cy", F.explode(F.sequence(F.col("y0") - ny, F.col("y0") + ny))).withColumn("cx", F.explode(F.sequence(F.col("x0") - F.col("nx"), F.col("x0") + F.col("nx"))))
    d = geo.distance(lat, lon, (F.col("cy") + 0.5) * step_deg, (F.col("cx") + 0.5) * step_deg)
    close = near.withColumn("w", 1 - d / reach_m).where("w > 0").groupBy("cy", "cx", "track").agg(F.max("w").alias("w"))
    # exact sums: those of doubles hang on the order of many thousand walks, which no two runs share
    cover = F.sum(F.col("w").cast("decimal(20,18)")).cast("double")
    return ranked(close.groupBy("cy", "cx").agg(cover.alias("cover")), "cover").select("cy", "cx", "cover", "rank")


def _grid(spark, d):
    return cell_means(positions(spark, d), 0.001).select("cy", "cx", F.col("mean").alias("v"))


def _round(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


LEVELS = [45.0, 50.0, 55.0]
QUERIES = {
    "surface_blurred": lambda s, d: _round(blurred(_grid(s, d), 2)),
    "surface_fine": lambda s, d: _round(upsampled(_grid(s, d), 3)),
    "surface_smooth": lambda s, d: _round(smooth(_grid(s, d), 3)),
    "surface_corridor": lambda s, d: _round(corridor(positions(s, d), 0.001, 75.0, 300.0), 6),
    "surface_shaded": lambda s, d: _round(shaded(_grid(s, d), 111.0, 69.0)),
    "surface_coverage": lambda s, d: _round(coverage(positions(s, d), 0.001, 75.0)),
    "contour_segments": lambda s, d: _round(contour_segments(_grid(s, d), LEVELS), 6),
}
_G = f"""WITH {POSITIONS_SQL}, v0 AS (SELECT floor(lat / 0.001)::bigint AS cy, floor(lon / 0.001)::bigint AS cx, track, avg(value) AS v FROM p GROUP BY ALL), g AS (SELECT cy, cx, avg(v) AS v FROM v0 GROUP BY cy, cx),
st AS (SELECT i, j, CASE abs(i) + abs(j) WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 1 END AS w FROM range(-1, 2) a(i), range(-1, 2) b(j))"""
_BLUR = "(SELECT g.cy, g.cx, sum(n.v * w) / sum(w) AS v FROM {0} g, st JOIN {0} n ON n.cy = g.cy + i AND n.cx = g.cx + j GROUP BY g.cy, g.cx)"
_SQ = "q AS (SELECT g.cy, g.cx, g.v AS a, b.v AS b, c.v AS c, d.v AS d FROM g JOIN g b ON b.cy = g.cy AND b.cx = g.cx + 1 JOIN g c ON c.cy = g.cy + 1 AND c.cx = g.cx + 1 JOIN g d ON d.cy = g.cy + 1 AND d.cx = g.cx)"
ORACLE_SQL = {
    "surface_blurred": f"{_G}, g1 AS {_BLUR.format('g')}, g2 AS {_BLUR.format('g1')} SELECT cy, cx, round(v, 8) AS v FROM g2",
    "surface_fine": f"{_G}, {_SQ} SELECT cy * 3 + i AS cy, cx * 3 + j AS cx, round(a * (1 - i / 3) * (1 - j / 3) + b * (1 - i / 3) * (j / 3) + c * (i / 3) * (j / 3) + d * (i / 3) * (1 - j / 3), 8) AS v FROM q, range(3) x(i), range(3) y(j)",
    "surface_smooth": f"""{_G}, o AS (SELECT i, j FROM range(-1, 3) a(i), range(-1, 3) b(j)),
sq AS (SELECT cy - i AS cy, cx - j AS cx, i, j, v FROM g, o), k AS (SELECT t AS n, t / 3 AS t FROM range(3) r(t)),
w AS (SELECT n, i, CASE i WHEN -1 THEN (2 * t ** 2 - t ** 3 - t) / 2 WHEN 0 THEN (3 * t ** 3 - 5 * t ** 2 + 2) / 2 WHEN 1 THEN (4 * t ** 2 - 3 * t ** 3 + t) / 2 ELSE (t ** 3 - t ** 2) / 2 END AS c, CASE i WHEN 0 THEN 1 - t WHEN 1 THEN t ELSE 0 END AS l FROM k, range(-1, 3) r(i)),
f AS (SELECT cy * 3 + y.n AS cy, cx * 3 + x.n AS cx, count(*) AS n, sum(v * y.c * x.c) AS cubic, sum(v * y.l * x.l) AS lin, sum(y.l * x.l) AS wt FROM sq JOIN w y ON y.i = sq.i JOIN w x ON x.i = sq.j GROUP BY sq.cy, sq.cx, y.n, x.n)
SELECT cy, cx, round(CASE WHEN n = 16 THEN cubic ELSE lin / wt END, 8) AS v FROM f WHERE n = 16 OR wt > 1e-6""",
    "surface_corridor": f"""WITH {POSITIONS_SQL}, l AS (SELECT lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM p WINDOW w AS (PARTITION BY track ORDER BY t, idx)),
s AS (SELECT DISTINCT lat, lon, CASE WHEN near THEN lat2 ELSE lat END AS lat2, CASE WHEN near THEN lon2 ELSE lon END AS lon2 FROM (SELECT *, coalesce(sqrt(((lat2 - lat) * 111320) ** 2 + ((lon2 - lon) * 111320 * cos(radians(lat))) ** 2) <= 300, false) AS near FROM l)),
y AS (SELECT *, unnest(range(floor(least(lat, lat2) / 0.001)::bigint - 2, floor(greatest(lat, lat2) / 0.001)::bigint + 3)) AS cy FROM s), c AS (SELECT *, unnest(range(floor(least(lon, lon2) / 0.001)::bigint - 3, floor(greatest(lon, lon2) / 0.001)::bigint + 4)) AS cx FROM y),
a AS (SELECT cy, cx, (lon - (cx + 0.5) * 0.001) * k AS ax, (lat - (cy + 0.5) * 0.001) * 111320 AS ay, (lon2 - lon) * k AS dx, (lat2 - lat) * 111320 AS dy FROM (SELECT *, 111320 * cos(radians((cy + 0.5) * 0.001)) AS k FROM c)),
d AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0, least(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) ELSE 0 END AS u FROM a)
SELECT cy, cx, round(min(sqrt((ax + u * dx) ** 2 + (ay + u * dy) ** 2)), 6) AS d FROM d GROUP BY cy, cx HAVING min(sqrt((ax + u * dx) ** 2 + (ay + u * dy) ** 2)) <= 75""",
    "surface_shaded": f"""{_G}, n AS (SELECT g.cy, g.cx, sum(j * (2 - abs(i)) * (coalesce(h.v, g.v) - g.v)) / (8 * 69) AS dx, sum(i * (2 - abs(j)) * (coalesce(h.v, g.v) - g.v)) / (8 * 111) AS dy FROM g, st LEFT JOIN g h ON h.cy = g.cy + i AND h.cx = g.cx + j GROUP BY g.cy, g.cx)
SELECT cy, cx, round(greatest(0, (cos(radians(45)) - sin(radians(45)) * (sin(radians(315)) * dx + cos(radians(315)) * dy)) / sqrt(1 + dx * dx + dy * dy)), 8) AS shade FROM n""",
    "surface_coverage": f"""WITH {POSITIONS_SQL}, c AS (SELECT track, lat, lon, floor(lat / 0.001)::bigint + i AS cy, floor(lon / 0.001)::bigint + j AS cx FROM p, range(-2, 3) a(i), range(-4, 5) b(j)),
w AS (SELECT cy, cx, track, max(1 - sqrt((((cy + 0.5) * 0.001 - lat) * 111320) ** 2 + (((cx + 0.5) * 0.001 - lon) * 111320 * cos(radians(lat))) ** 2) / 75) AS w FROM c GROUP BY ALL),
s AS (SELECT cy, cx, sum(w) AS cover FROM w WHERE w > 0 GROUP BY cy, cx) SELECT cy, cx, round(cover, 8) AS cover, round(cume_dist() OVER (ORDER BY cover), 8) AS rank FROM s""",
}
