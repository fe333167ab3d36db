"""Values of a raster of Mercator pixels at places and in discs round them."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.lineage import shared_dir
from ..sources.raster_tiles import at_pixel, read_tiles, write_tiles
from ..sources.tables import POSITIONS_SQL, positions

#: Fixed value: lower values stand for no data.
LEAST = -1.5


def discs(points: DataFrame, pixels: DataFrame, zoom: int, radius_m: float, size: int = 256) -> DataFrame:
    """(track, idx, at, mean): the value of the pixel that a place (lat, lon) falls in and the mean of the pixels within ``radius_m``.

    ``pixels`` (py, px, v) are of the zoom's whole grid. The radius is whole pixels of the place's latitude, one at least;
    a pixel without a value, or one that stands for no data, counts as not there. Null where there is none. Each disc
    that some place has is summed once, however many places share it.
    """
    pts = points.where("lat is not null and lon is not null")
    y, x = at_pixel(zoom, size)
    r = F.greatest(F.lit(1), F.floor(F.lit(radius_m) / geo.metres_per_pixel(F.col("lat"), zoom, size) + 0.5).cast("int"))
    pts = pts.select("track", "idx", y.alias("cy"), x.alias("cx"), r.alias("r"))
    around = pts.select("cy", "cx", "r").distinct().withColumn("dy", F.explode(F.sequence(-F.col("r"), F.col("r"))))
    half = F.floor(F.sqrt(F.col("r") * F.col("r") - F.col("dy") * F.col("dy"))).cast("int")
    around = around.withColumn("dx", F.explode(F.sequence(-half, half)))
    there = pixels.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.col("v") > LEAST)).select("py", "px", F.col("v").cast("double").alias("v"))
    met = around.select("cy", "cx", "r", "dy", "dx", (F.col("cy") + F.col("dy")).alias("py"), (F.col("cx") + F.col("dx")).alias("px")).join(there, ["py", "px"])
    of = met.groupBy("cy", "cx", "r").agg(F.max(F.when((F.col("dy") == 0) & (F.col("dx") == 0), F.col("v"))).alias("at"), F.avg("v").alias("mean"))
    return pts.join(of, ["cy", "cx", "r"], "left").select("track", "idx", "at", "mean")


ZOOM, RADIUS_M = 13, 50.0


def _discs(spark, d):
    """Values of events as a raster, written as tiles and read back as pixels of the box that the places lie in."""
    p = positions(spark, d)
    y, x = at_pixel(ZOOM)
    raster = p.groupBy(y.alias("py"), x.alias("px")).agg(F.max("value").alias("v")).withColumn("z", F.lit(ZOOM))
    folder = f"{shared_dir(spark)}/tiles-{uuid4().hex}"
    if not write_tiles(raster, folder):
        return discs(p, raster, ZOOM, RADIUS_M)
    return discs(p, read_tiles(spark, folder, box="51.5,-0.1,51.51,-0.09"), ZOOM, RADIUS_M)


QUERIES = {"raster_discs": lambda s, d: _discs(s, d).select("track", "idx", F.round("at", 6).alias("at"), F.round("mean", 6).alias("mean"))}
_N = 1 << ZOOM
ORACLE_SQL = {
    "raster_discs": f"""WITH {POSITIONS_SQL}, u AS (SELECT *, (lon + 180) / 360 * {_N} AS x, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * {_N} AS y, greatest(1, floor({RADIUS_M} / (2 * {geo.MERCATOR_M} * cos(radians(lat)) / (256 * {_N})) + 0.5))::bigint AS r FROM p),
c AS (SELECT track, idx, value, r, floor(y)::bigint * 256 + floor((y - floor(y)) * 256)::bigint AS cy, floor(x)::bigint * 256 + floor((x - floor(x)) * 256)::bigint AS cx FROM u),
v AS (SELECT cy, cx, max(value)::float::double AS v FROM c GROUP BY cy, cx HAVING max(value) > {LEAST}), k AS (SELECT DISTINCT cy, cx, r FROM c),
m AS (SELECT k.cy, k.cx, k.r, max(v) FILTER (v.cy = k.cy AND v.cx = k.cx) AS "at", avg(v) AS mean FROM k JOIN v ON v.cy BETWEEN k.cy - r AND k.cy + r AND v.cx BETWEEN k.cx - r AND k.cx + r AND (v.cy - k.cy) ** 2 + (v.cx - k.cx) ** 2 <= r * r GROUP BY ALL)
SELECT track, idx, round("at", 6) AS "at", round(mean, 6) AS mean FROM c LEFT JOIN m USING (cy, cx, r)""",
}
