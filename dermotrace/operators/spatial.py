"""Surfaces, hotspots and map features: cells and equi-joins first, small grids and tracks last."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.tables import POSITIONS_SQL, positions
from .signal import in_tracks

#: Surface (softening and reach in metres, walks of the prior), hotspots (share, separation), map matching.
SOFTEN_M, REACH_M, PRIOR = 25.0, 75.0, 3.0
TOP_SHARE, APART_M = 0.02, 30.0
SIGMA_M, BETA_M, SEARCH_M, CANDIDATES, BREAK_S, BREAK_M, LOST_M = 4.07, 3.0, 40.0, 10, 30.0, 30.0, 1000.0

#: Searches of routes that a track keeps at a time.
KEPT = 1024


def cell_means(points: DataFrame, degrees: float, value: str = "value") -> DataFrame:
    """(cy, cx, tracks, n, mean): a track's mean in a cell is one vote."""
    cy, cx = geo.cell(F.col("lat"), F.col("lon"), degrees)
    votes = points.groupBy(cy.alias("cy"), cx.alias("cx"), "track").agg(F.avg(value).alias("v"), F.count(value).alias("n"))
    return votes.groupBy("cy", "cx").agg(F.count("*").alias("tracks"), F.sum("n").alias("n"), F.avg("v").alias("mean"))


def surface(points: DataFrame, step_deg: float, value: str = "value", reach_m: float = REACH_M) -> DataFrame:
    """(cy, cx, votes, level): inverse distance weighting within reach, one vote a track, shrunk towards zero by the prior.

    Points meet the cells around them by exploding a fixed stencil; sums of weights combine before the shuffle.
    """
    lat, lon = F.col("lat"), F.col("lon")
    high = reach_m / (step_deg * geo.DEGREE_M)
    ny, round_ = math.ceil(high) + 1, round(360 / step_deg)
    # at the stencil's edge nearest to a pole a cell is narrowest; no stencil is wider than the globe
    edge = F.least(F.lit(89.999), F.abs(lat) + reach_m / geo.DEGREE_M)
    nx = F.least(F.lit(round_ // 2), F.ceil(F.lit(high) / F.cos(F.radians(edge))) + 1)
    cy, cx = geo.cell(lat, lon, step_deg)
    near = points.select("track", lat, lon, F.col(value).alias("v"), cy.alias("y0"), cx.alias("x0"), nx.alias("nx"))
    near = near.withColumn("cy", F.explode(F.sequence(F.col("y0") - ny, F.col("y0") + ny))).withColumn("cx", F.explode(F.sequence(F.col("x0") - F.col("nx"), F.least(F.col("x0") + F.col("nx"), F.col("x0") - F.col("nx") + round_ - 1))))
    near = near.withColumn("cx", F.pmod(F.col("cx") + round_ // 2, F.lit(round_)) - round_ // 2)
    d = geo.distance(lat, lon, (F.col("cy") + 0.5) * step_deg, (F.col("cx") + 0.5) * step_deg)
    near = near.withColumn("d", d).where(F.col("d") <= reach_m).withColumn("w", 1 / F.pow(F.col("d") + SOFTEN_M, F.lit(2)))
    votes = near.groupBy("cy", "cx", "track").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("vote"))
    return votes.groupBy("cy", "cx").agg(F.count("*").alias("votes"), (F.sum("vote") / (F.count("*") + PRIOR)).alias("level"))


def hotspots(points: DataFrame, value: str = "value", share: float = TOP_SHARE, apart_m: float = APART_M) -> DataFrame:
    """(track, idx, rank): a track's largest values, no two nearer than ``apart_m``; max(1, share of its rows)."""

    def run(table: pa.Table) -> pa.Table:
        v, lat, lon, idx = (table.column(c).to_numpy() for c in (value, "lat", "lon", "idx"))
        most, kept = max(1, round(share * v.size)), []
        for i in sorted(range(v.size), key=lambda i: (-v[i], idx[i])):
            if len(kept) == most:
                break
            k = geo.DEGREE_M * math.cos(math.radians(lat[i]))
            if all(math.hypot((lat[j] - lat[i]) * geo.DEGREE_M, (lon[j] - lon[i]) * k) >= apart_m for j in kept):
                kept.append(i)
        return pa.table({"track": table.column("track").take(pa.array(kept, pa.int64())), "idx": pa.array(idx[kept]), "rank": pa.array(range(1, len(kept) + 1), pa.int32())})

    rows = points.where(F.col(value).isNotNull()).select("track", "idx", "lat", "lon", value)
    return rows.groupBy("track").applyInArrow(run, "track long, idx long, rank int")


def segments(ways: DataFrame) -> DataFrame:
    """(way, seg, a_lat, a_lon, b_lat, b_lon) of ways with ``way`` and ``nodes`` (array of struct lat, lon)."""
    at = ways.select("way", F.posexplode("nodes").alias("seg", "a"), "nodes")
    b = F.try_element_at("nodes", F.col("seg") + 2)
    return at.select("way", "seg", F.col("a.lat").alias("a_lat"), F.col("a.lon").alias("a_lon"), b.lat.alias("b_lat"), b.lon.alias("b_lon")).where("b_lat is not null")


def dealt(segs: DataFrame, size: float, reach_m: float) -> DataFrame:
    """``segs`` once for each cell (cy, cx) of ``size`` metres that its box and reach touch."""
    step, pad = size / geo.DEGREE_M, reach_m / geo.DEGREE_M
    low, high = F.least("a_lat", "b_lat") - pad, F.greatest("a_lat", "b_lat") + pad
    bands = segs.withColumn("cy", F.explode(F.sequence(F.floor(low / step), F.floor(high / step))))
    # in each band the columns from the western end on, the short way round; a pad that is as wide there as the reach is
    across = geo.lon_difference(F.col("a_lon"), F.col("b_lon"))
    west = F.when(across >= 0, F.col("a_lon")).otherwise(F.col("b_lon"))
    n = geo.band_columns(F.col("cy"), size)
    wide = 360 / n * (reach_m / size)
    from_, to = F.floor((west - wide + 180) / 360 * n), F.floor((west + F.abs(across) + wide + 180) / 360 * n)
    columns = F.array_distinct(F.transform(F.sequence(from_, F.least(to, from_ + n)), lambda c: F.pmod(c, n)))
    return bands.withColumn("cx", F.explode(columns))


def candidates(points: DataFrame, segs: DataFrame, reach_m: float = SEARCH_M, most: int = CANDIDATES) -> DataFrame:
    """Segments within reach of each point, the nearest first: a segment lies in the cells its box and reach touch."""
    size = 4 * reach_m
    if most < 1 << 30:  # of segments on one another, as far from any point, only the first can be among its nearest
        same = Window.partitionBy("a_lat", "a_lon", "b_lat", "b_lon").orderBy("way", "seg")
        segs = segs.withColumn("_copy", F.row_number().over(same)).where(F.col("_copy") <= most).drop("_copy")
    band = geo.band_of(F.col("lat"), size)
    pts = points.select("track", "t", "idx", "lat", "lon", band.alias("cy"), geo.column_of(F.col("lon"), band, size).alias("cx"))
    d = geo.segment_distance(*(F.col(c) for c in ("lat", "lon", "a_lat", "a_lon", "b_lat", "b_lon")))
    near = pts.join(dealt(segs, size, reach_m), ["cy", "cx"]).drop("cy", "cx").withColumn("d", d).where(F.col("d") <= reach_m)
    rank = F.row_number().over(Window.partitionBy("track", "idx").orderBy("d", "way", "seg"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most)


def routes(graph: dict, start, limit: float) -> dict:
    """Metres along the graph from a node to all within the limit (Dijkstra)."""
    best, queue = {start: 0.0}, [(0.0, start)]
    while queue:
        d, node = heapq.heappop(queue)
        if d > best.get(node, math.inf):
            continue
        for other, length in graph.get(node, {}).items():
            if (n := d + length) <= limit and n < best.get(other, math.inf):
                best[other] = n
                heapq.heappush(queue, (n, other))
    return best


def _project(lat, lon, c) -> tuple[float, float, float]:
    """(share along the segment, its length, metres off)."""
    k = geo.DEGREE_M * math.cos(math.radians(lat))
    ax, ay, bx, by = (c["a_lon"] - lon) * k, (c["a_lat"] - lat) * geo.DEGREE_M, (c["b_lon"] - lon) * k, (c["b_lat"] - lat) * geo.DEGREE_M
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    s = min(1.0, max(0.0, -(ax * dx + ay * dy) / size)) if size else 0.0
    return s, math.sqrt(size), math.hypot(ax + s * dx, ay + s * dy)


def viterbi(rows: list[dict], lost_m: float = LOST_M) -> list[dict]:
    """The likeliest candidate of each point (rows sorted by t, idx, rank; the graph is that of the track's candidates).

    A step costs the difference between its route and the distance gone, ``lost_m`` at most and where there is no route;
    so routes are searched up to the distance gone and ``lost_m`` more: a longer one can't cost less.
    """
    graph, points, nodes = defaultdict(dict), [], {}

    def node(lat, lon):
        if (at := nodes.get((lat, lon))) is None:
            at = nodes[lat, lon] = (round(lat, 6), round(lon, 6))
        return at

    for c in rows:
        s, length, d = _project(c["lat"], c["lon"], c)
        a, b = node(c["a_lat"], c["a_lon"]), node(c["b_lat"], c["b_lon"])
        c |= {"s": s, "length": length, "d": d, "a": a, "b": b}
        # a segment has a length for each point near it: the least is every route's
        if length < graph[a].get(b, math.inf):
            graph[a][b] = length
        if length < graph[b].get(a, math.inf):
            graph[b][a] = length
        if not points or points[-1][0]["idx"] != c["idx"]:
            points.append([])
        points[-1].append(c)
    found: dict = {}

    def ways_from(start, limit):
        """Nodes within the limit, and some further on: the last searches are kept as long as they reach far enough."""
        if start not in found or found[start][0] < limit:
            reach = max(limit, 1.5 * found[start][0]) if start in found else limit
            if len(found) >= KEPT:
                found.clear()
            found[start] = (reach, routes(graph, start, reach))
        return found[start][1]

    def route(p, q, limit):
        if (p["way"], p["seg"]) == (q["way"], q["seg"]):
            return abs(p["s"] - q["s"]) * p["length"]
        best = math.inf
        for e, lead in (("a", p["s"]), ("b", 1 - p["s"])):
            ways = ways_from(p[e], limit)
            for f, tail in (("a", q["s"]), ("b", 1 - q["s"])):
                if (along := ways.get(q[f], math.inf)) <= limit:
                    best = min(best, lead * p["length"] + along + tail * q["length"])
        return best

    emit = lambda c: -0.5 * (c["d"] / SIGMA_M) ** 2 - math.log(SIGMA_M * math.sqrt(2 * math.pi))
    out, score, back = [], [], []

    def finish(end):
        if score:
            k = max(range(len(score[-1])), key=lambda k: score[-1][k])
            chain = []
            for i in range(len(score) - 1, -1, -1):
                chain.append(points[end - len(score) + i][k])
                k = back[i][k]
            out.extend(reversed(chain))

    for i, now in enumerate(points):
        fresh = not score
        if score:
            a, b = points[i - 1][0], now[0]
            gone = math.hypot((b["lat"] - a["lat"]) * geo.DEGREE_M, (b["lon"] - a["lon"]) * geo.DEGREE_M * math.cos(math.radians(a["lat"])))
            fresh = b["t"] - a["t"] > BREAK_S and gone > BREAK_M
        if fresh:
            finish(i)
            score, back = [[emit(c) for c in now]], [[0] * len(now)]
            continue
        best, come = [], []
        for q in now:
            ways = []
            for k, p in enumerate(points[i - 1]):
                r = route(p, q, gone + lost_m)
                ways.append(score[-1][k] - min(abs(gone - r), lost_m) / BETA_M - math.log(BETA_M))
            k = max(range(len(ways)), key=lambda k: ways[k])
            best.append(ways[k] + emit(q))
            come.append(k)
        score.append(best)
        back.append(come)
    finish(len(points))
    return out


def map_matched(points: DataFrame, ways: DataFrame) -> DataFrame:
    """(track, idx, way, seg, lat, lon, off_m): hidden Markov map matching, whole tracks with their candidates.

    Points are dealt by track before they meet the streets: candidates are more rows, and take longer, than points.
    """
    schema = pa.schema([("track", pa.int64()), ("idx", pa.int64()), ("way", pa.int64()), ("seg", pa.int32()), ("lat", pa.float64()), ("lon", pa.float64()), ("off_m", pa.float64())])

    def run(tracks: list[pa.Table]) -> pa.Table:
        got = [c for table in tracks for c in viterbi(table.to_pylist())]
        cols = {"track": [c["track"] for c in got], "idx": [c["idx"] for c in got], "way": [c["way"] for c in got], "seg": [c["seg"] for c in got]}
        cols |= {x: [c[f"a_{x}"] + c["s"] * (c[f"b_{x}"] - c[f"a_{x}"]) for c in got] for x in ("lat", "lon")} | {"off_m": [c["d"] for c in got]}
        return pa.table(cols, schema=schema)

    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = candidates(points.repartition(n, "track"), segments(ways)).select("track", "t", "idx", "rank", "lat", "lon", "way", F.col("seg").cast("int").alias("seg"), "a_lat", "a_lon", "b_lat", "b_lon")
    return in_tracks(near, run, "track long, idx long, way long, seg int, lat double, lon double, off_m double", ("t", "idx", "rank"))


def street_grid(spark) -> DataFrame:
    """A square grid of ways around the derived coordinates, for the registered query.

    Made by Spark, so that its size is known: streets of unknown size had the points sent to every task, or shuffled to few cells.
    """
    k, along = F.expr("id div 2"), F.col("id") % 2 == 1
    place = lambda j: F.struct((F.lit(51.5) + F.lit(0.0012) * F.when(along, k).otherwise(j)).alias("lat"), (F.lit(-0.1) + F.lit(0.0012) * F.when(along, j).otherwise(k)).alias("lon"))
    return spark.range(0, 18, 1, 1).select(F.col("id").alias("way"), F.transform(F.sequence(F.lit(0), F.lit(8)), place).alias("nodes"))


QUERIES = {
    "cell_means": lambda s, d: cell_means(positions(s, d), 0.001).select("cy", "cx", "tracks", "n", F.round("mean", 8).alias("mean")),
    "surface": lambda s, d: surface(positions(s, d), 0.001).select("cy", "cx", "votes", F.round("level", 8).alias("level")),
    "hotspots": lambda s, d: hotspots(positions(s, d)),
    "map_candidates": lambda s, d: candidates(positions(s, d), segments(street_grid(s))).select("track", "idx", "way", "seg", F.round("d", 3).alias("d")),
    "map_matched": lambda s, d: map_matched(positions(s, d), street_grid(s)),
}
_GRID = """ways AS (SELECT 2 * k + a AS way, j AS seg, 51.5 + 0.0012 * CASE a WHEN 1 THEN k ELSE j END AS a_lat, -0.1 + 0.0012 * CASE a WHEN 1 THEN j ELSE k END AS a_lon,
  51.5 + 0.0012 * CASE a WHEN 1 THEN k ELSE j + 1 END AS b_lat, -0.1 + 0.0012 * CASE a WHEN 1 THEN j + 1 ELSE k END AS b_lon
  FROM range(9) r(k), range(2) s(a), range(8) q(j))"""
ORACLE_SQL = {
    "cell_means": f"""WITH {POSITIONS_SQL}, v AS (SELECT floor(lat / 0.001)::bigint AS cy, floor(lon / 0.001)::bigint AS cx, track, avg(value) AS v, count(value) AS n FROM p GROUP BY ALL)
SELECT cy, cx, count(*) AS tracks, sum(n)::bigint AS n, round(avg(v), 8) AS mean FROM v GROUP BY cy, cx""",
    "surface": f"""WITH {POSITIONS_SQL}, q AS (SELECT *, floor(lat / 0.001)::bigint AS y0, floor(lon / 0.001)::bigint AS x0 FROM p),
c AS (SELECT track, lat, lon, value, y0 + i AS cy, x0 + j AS cx FROM q, range(-2, 3) a(i), range(-4, 5) b(j)),
d AS (SELECT *, sqrt((((cy + 0.5) * 0.001 - lat) * 111320) ** 2 + (((cx + 0.5) * 0.001 - lon) * 111320 * cos(radians(lat))) ** 2) AS d FROM c),
v AS (SELECT cy, cx, track, sum(value / (d + 25) ** 2) / sum(1 / (d + 25) ** 2) AS vote FROM d WHERE d <= 75 GROUP BY ALL)
SELECT cy, cx, count(*) AS votes, round(sum(vote) / (count(*) + 3), 8) AS level FROM v GROUP BY cy, cx""",
    "map_candidates": f"""WITH {POSITIONS_SQL}, {_GRID},
x AS (SELECT track, idx, way, seg, 111320 * cos(radians(lat)) AS k, (a_lon - lon) * 111320 * cos(radians(lat)) AS ax, (a_lat - lat) * 111320 AS ay,
  (b_lon - a_lon) * 111320 * cos(radians(lat)) AS dx, (b_lat - a_lat) * 111320 AS dy FROM p, ways),
y AS (SELECT *, greatest(0, least(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS s FROM x),
z AS (SELECT *, sqrt((ax + s * dx) ** 2 + (ay + s * dy) ** 2) AS d FROM y)
SELECT track, idx, way, seg::int AS seg, round(d, 3) AS d FROM z WHERE d <= 40 QUALIFY row_number() OVER (PARTITION BY track, idx ORDER BY d, way, seg) <= 10""",
}
