"""Clusters of responses and the places that they make: leaders by density, dwell and energy within footprints, rank."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.tables import POSITIONS_SQL, positions

#: Radius of a cluster and how far apart leaders are; padding of a footprint; least dwell, visit, members; places; weight of walks.
RADIUS_M, APART, PAD_M, DWELL_S, VISIT_S, MEMBERS, PLACES, WALKS = 35.0, 1.8, 10.0, 5.0, 3.0, 3, 20, 0.5


def leaders(xy: np.ndarray, radius: float = RADIUS_M, apart: float = APART) -> np.ndarray:
    """Number of each point's cluster: the densest points lead; a point near a leader joins it, one nearer than ``apart`` radii the nearest."""
    n, cells = len(xy), {}
    key = np.floor(xy / radius).astype(np.int64)
    for i, (a, b) in enumerate(key.tolist()):
        cells.setdefault((a, b), []).append(i)
    cells = {k: np.array(v) for k, v in cells.items()}

    def near(i: int) -> np.ndarray:
        a, b = key[i].tolist()
        some = [cells[c] for u in (-1, 0, 1) for v in (-1, 0, 1) if (c := (a + u, b + v)) in cells]
        at = np.sort(np.concatenate(some))
        return at[((xy[at] - xy[i]) ** 2).sum(axis=1) <= radius * radius]

    density = np.array([near(i).size for i in range(n)])
    out, heads = np.full(n, -1), []
    for i in np.lexsort((np.arange(n), -density)).tolist():
        if out[i] >= 0:
            continue
        if heads:
            d = ((xy[heads] - xy[i]) ** 2).sum(axis=1)
            k = int(np.argmin(d))
            if d[k] <= (radius * apart) ** 2:
                out[i] = k
                continue
        around = near(i)
        out[around[out[around] < 0]] = len(heads)
        heads.append(i)
    return out


def clusters(peaks: DataFrame, area: str = "area", radius: float = RADIUS_M) -> DataFrame:
    """``peaks`` (lat, lon, idx, area) with ``cluster``: one Arrow group an area, as each leader rests on those before it. An area is a town, not a table."""
    schema = peaks.schema.add("cluster", "long")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        lat, lon = table.column("lat").to_numpy(), table.column("lon").to_numpy()
        k = geo.DEGREE_M * math.cos(math.radians(lat.mean()))
        made = leaders(np.column_stack(((lon - lon.mean()) * k, (lat - lat.mean()) * geo.DEGREE_M)), radius)
        return table.append_column("cluster", pa.array(made, pa.int64()))

    return peaks.where("lat is not null and lon is not null").groupBy(area).applyInArrow(run, schema)


def weight(amplitude: Column, reference: Column) -> Column:
    """An amplitude over the reference, from 0.55 to 3; 1 without a reference."""
    return F.when(reference > 0, F.greatest(F.lit(0.55), F.least(F.lit(3.0), amplitude / reference))).otherwise(1.0)


def candidate_places(members: DataFrame, least: int = MEMBERS, least_walks: int = 1) -> DataFrame:
    """(place, members, walks, lat, lon, mean_amplitude, max_amplitude, first): clusters with enough members, or of two walks or more."""
    g = members.groupBy("place").agg(F.count("*").alias("members"), F.count_distinct("track").alias("walks"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.avg(F.coalesce("amplitude", F.lit(0.0))).alias("mean_amplitude"), F.max(F.coalesce("amplitude", F.lit(0.0))).alias("max_amplitude"), F.min("t").alias("first"))
    return g.where(((F.col("members") >= least) | (F.col("walks") >= 2)) & (F.col("walks") >= least_walks))


def places(members: DataFrame, samples: DataFrame, seconds: float, radius: float = RADIUS_M, most: int = PLACES) -> DataFrame:
    """The ``most`` highest-ranked places of ``members`` (place, track, t, lat, lon, amplitude), by what ``samples`` (track, idx, lat, lon, phasic) say.

    A sample of ``seconds`` belongs to a place if it lies within the footprint of any of its members; samples meet members
    by cells of the footprint's size. Rate is energy a minute of dwell; rank is the rate times a root of the walks.
    """
    foot = radius / 2 + PAD_M
    found = candidate_places(members)
    kept = members.join(found.select("place", F.col("lat").alias("mid")), "place")
    near = kept.select("place", "mid", F.col("lat").alias("m_lat"), F.col("lon").alias("m_lon")).distinct().withColumn("c", F.explode(geo.near_cells(F.col("m_lat"), F.col("m_lon"), foot))).select("place", "mid", "m_lat", "m_lon", "c.cy", "c.cx")
    band = geo.band_of(F.col("lat"), foot)
    at = samples.where("lat is not null and lon is not null").select("track", "idx", "lat", "lon", "phasic", band.alias("cy"), geo.column_of(F.col("lon"), band, foot).alias("cx"))
    d = F.sqrt(F.pow((F.col("lat") - F.col("m_lat")) * geo.DEGREE_M, F.lit(2)) + F.pow(geo.lon_difference(F.col("m_lon"), F.col("lon")) * geo.lon_degree_m(F.col("mid")), F.lit(2)))
    inside = at.join(near, ["cy", "cx"]).where(d <= foot).groupBy("place", "track", "idx").agg(F.first("phasic").alias("phasic"))
    walks = inside.groupBy("place", "track").agg((F.count("*") * seconds).alias("dwell"), (F.sum(F.greatest("phasic", F.lit(0.0))) * seconds).alias("energy"))
    own = members.select("place", "track").distinct().withColumn("own", F.lit(True))
    seen = walks.join(own, ["place", "track"], "left").where(F.col("own") | (F.col("dwell") >= VISIT_S))
    g = seen.groupBy("place").agg(F.count("*").alias("visits"), F.sum("dwell").alias("dwell"), F.sum("energy").alias("energy"))
    out = found.join(g, "place", "left").fillna(0, ["visits", "dwell", "energy"])
    rate = F.col("energy") / F.greatest(F.col("dwell"), F.lit(DWELL_S)) * 60
    out = out.withColumns({"rate": rate, "visits": F.greatest("visits", "walks"), "provisional": F.col("walks") <= 1}).withColumn("rank", F.col("rate") * F.pow("walks", F.lit(WALKS)))
    top = out.orderBy(F.desc("rank"), "place").limit(most)  # a top list
    return top.withColumn("label", F.concat(F.lit("P"), F.row_number().over(Window.orderBy(F.desc("rank"), "place"))))


def blob_density(members: DataFrame, step_m: float = 5.0, sigma: float = 15.0) -> DataFrame:
    """(place, cy, cx, v): weighted Gaussian density of a place's members on a grid of metres around its middle, to three sigma."""
    mid = members.groupBy("place").agg(F.avg("lat").alias("mid_lat"), F.avg("lon").alias("mid_lon"), F.expr("percentile_approx(amplitude, 0.5)").alias("ref"))
    m = members.join(mid, "place")
    y, x = (F.col("lat") - F.col("mid_lat")) * geo.DEGREE_M, geo.lon_difference(F.col("mid_lon"), F.col("lon")) * geo.lon_degree_m(F.col("mid_lat"))
    reach = math.ceil(3 * sigma / step_m)
    m = m.select("place", y.alias("y"), x.alias("x"), weight(F.col("amplitude"), F.col("ref")).alias("w"))
    m = m.withColumn("cy", F.explode(F.sequence(F.floor(F.col("y") / step_m) - reach, F.floor(F.col("y") / step_m) + reach))).withColumn("cx", F.explode(F.sequence(F.floor(F.col("x") / step_m) - reach, F.floor(F.col("x") / step_m) + reach)))
    d2 = F.pow((F.col("cy") + 0.5) * step_m - F.col("y"), F.lit(2)) + F.pow((F.col("cx") + 0.5) * step_m - F.col("x"), F.lit(2))
    return m.where(d2 <= (3 * sigma) ** 2).groupBy("place", "cy", "cx").agg(F.sum(F.col("w") * F.exp(-d2 / (2 * sigma * sigma))).alias("v"))


def _members(spark, d):
    """Strong readings by cell, for the registered query."""
    p = positions(spark, d).where("value > 80")
    cy, cx = geo.cell(F.col("lat"), F.col("lon"), 0.001)
    return p.select((cy * 1_000_000 + cx).alias("place"), "track", "t", "idx", "lat", "lon", F.col("value").alias("amplitude"))


QUERIES = {
    "place_clusters": lambda s, d: clusters(positions(s, d).where("value > 80").select("track", "idx", "lat", "lon"), "track").select("track", "idx", "cluster"),
    "places": lambda s, d: places(_members(s, d), positions(s, d).withColumn("phasic", F.col("value") - 40), 10.0).select("place", "label", "members", "walks", "visits", F.round("dwell", 6).alias("dwell"), F.round("energy", 6).alias("energy"), F.round("rate", 6).alias("rate"), F.round("rank", 6).alias("rank"), "provisional", F.round("mean_amplitude", 6).alias("mean_amplitude"), F.round("max_amplitude", 6).alias("max_amplitude")),
    "place_blobs": lambda s, d: blob_density(_members(s, d).join(candidate_places(_members(s, d)).select("place"), "place")).groupBy("place").agg(F.count("*").alias("cells"), F.round(F.max("v"), 6).alias("top")),
}
_M = f"""WITH {POSITIONS_SQL}, m AS (SELECT floor(lat / 0.001)::bigint * 1000000 + floor(lon / 0.001)::bigint AS place, * FROM p WHERE value > 80),
f AS (SELECT place, count(*) AS members, count(DISTINCT track) AS walks, avg(lat) AS mid, avg(value) AS mean_amplitude, max(value) AS max_amplitude FROM m GROUP BY place HAVING count(*) >= 3 OR count(DISTINCT track) >= 2),
u AS (SELECT DISTINCT m.place, m.lat, m.lon, mid FROM m JOIN f USING (place)),
n AS (SELECT DISTINCT u.place, p.track, p.idx, p.value - 40 AS phasic FROM p JOIN u ON abs(p.lat - u.lat) * 111320 <= 27.5 AND sqrt(((p.lat - u.lat) * 111320) ** 2 + ((p.lon - u.lon) * 111320 * cos(radians(mid))) ** 2) <= 27.5),
w AS (SELECT place, track, count(*) * 10.0::double AS dwell, sum(greatest(phasic, 0)) * 10.0::double AS energy FROM n GROUP BY place, track),
g AS (SELECT w.place, count(*) AS visits, sum(dwell) AS dwell, sum(energy) AS energy FROM w WHERE dwell >= 3 OR EXISTS (FROM m WHERE m.place = w.place AND m.track = w.track) GROUP BY w.place),
r AS (SELECT f.*, greatest(coalesce(visits, 0), walks) AS visits, coalesce(dwell, 0) AS dwell, coalesce(energy, 0) AS energy, coalesce(energy, 0) / greatest(coalesce(dwell, 0), 5) * 60 AS rate FROM f LEFT JOIN g USING (place)),
k AS (SELECT *, rate * sqrt(walks) AS rank, row_number() OVER (ORDER BY rate * sqrt(walks) DESC, place) AS o FROM r)"""
ORACLE_SQL = {
    "places": f"""{_M} SELECT place, 'P' || o AS label, members, walks, visits, round(dwell, 6) AS dwell, round(energy, 6) AS energy, round(rate, 6) AS rate, round(rank, 6) AS rank, walks <= 1 AS provisional,
round(mean_amplitude, 6) AS mean_amplitude, round(max_amplitude, 6) AS max_amplitude FROM k WHERE o <= 20""",
}
