"""Places that a walk comes back to: touches of a cell's neighbourhood as sessions in time, pooled where a gap says that the walker had left.

Each point goes to the cells around it, whose width follows the latitude, so that the last touch of every near cell is a
window over that cell's own rows, and no track is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.tables import POSITIONS_SQL, positions

#: Metres of a spot and seconds after which a touch is another visit; a shorter walk has no revisits.
SPOT_M, GAP_S, LEAST_POINTS = 7.0, 15.0, 4


def touches(points: DataFrame, value: str = "value", metres: float = SPOT_M, gap_s: float = GAP_S) -> DataFrame:
    """(track, idx, own_y, own_x, cy, cx, v, back): each point with a value, once for each cell around it; back: it comes after a gap since the last point in that cell."""
    enough = F.count("*").over(Window.partitionBy("track")) >= LEAST_POINTS
    rows = points.withColumn("_enough", enough).where(F.col("_enough") & F.col(value).isNotNull() & ~F.isnan(value))
    band = geo.band_of(F.col("lat"), metres)
    rows = rows.select("track", "t", "idx", F.col(value).alias("v"), band.alias("own_y"), geo.column_of(F.col("lon"), band, metres).alias("own_x"), F.explode(geo.near_cells(F.col("lat"), F.col("lon"), metres)).alias("c"))
    own = (F.col("c.cy") == F.col("own_y")) & (F.col("c.cx") == F.col("own_x"))
    before = Window.partitionBy("track", "cy", "cx").orderBy("t", "idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("track", "t", "idx", "v", "own_y", "own_x", "c.cy", "c.cx", F.when(own, F.col("t")).alias("_here"))
    return rows.withColumn("back", F.coalesce(F.col("t") - F.last("_here", True).over(before) > gap_s, F.lit(False)))


def revisited(points: DataFrame, value: str = "value", metres: float = SPOT_M, gap_s: float = GAP_S) -> DataFrame:
    """(track, idx, back, value): where a point's cell, or one beside it, was touched again after a gap, the mean of all points around; elsewhere its own value.

    ``back`` is whether the point's cell is such a one. Rows without a value stay without one, and touch nothing.
    """
    met = touches(points, value, metres, gap_s)
    again = met.where("back").select("track", F.explode(F.array(F.struct("cy", "cx"), F.struct(F.col("own_y").alias("cy"), F.col("own_x").alias("cx")))).alias("c")).select("track", "c.cy", "c.cx").distinct()
    means = met.groupBy("track", "cy", "cx").agg(F.avg("v").alias("pooled")).join(again, ["track", "cy", "cx"], "left_semi")
    band = geo.band_of(F.col("lat"), metres)
    own = points.select("track", "idx", value, band.alias("cy"), geo.column_of(F.col("lon"), band, metres).alias("cx"))
    out = own.join(means, ["track", "cy", "cx"], "left")
    known = F.col(value).isNotNull() & F.col("pooled").isNotNull()
    return out.select("track", "idx", known.alias("back"), F.when(known, F.col("pooled")).otherwise(F.col(value)).alias(value))


def retraces(points: DataFrame, metres: float = 60.0, gap_s: float = GAP_S) -> DataFrame:
    """(track, retraces): whether a walk ever comes back to its own way."""
    met = touches(points.withColumn("_one", F.lit(1.0)), "_one", metres, gap_s)
    return points.select("track").distinct().join(met.groupBy("track").agg(F.max("back").alias("b")), "track", "left").select("track", F.coalesce("b", F.lit(False)).alias("retraces"))


_M, _GAP = 40.0, 86400.0
QUERIES = {
    "path_revisits": lambda s, d: revisited(positions(s, d), "value", _M, _GAP).select("track", "idx", "back", F.round("value", 6).alias("value")),
    "path_retraces": lambda s, d: retraces(positions(s, d), _M, _GAP),
}


def _cells(metres: float) -> str:
    """Common table expressions of the touches, for the oracle."""
    step = metres / geo.DEGREE_M
    n = f"greatest(1, floor(360 * cos(radians(least(90.0::DOUBLE, greatest(abs(cy * {step!r}::DOUBLE), abs((cy + 1) * {step!r}::DOUBLE))))) / {step!r}::DOUBLE))::BIGINT"
    return f"""q AS (SELECT *, count(*) OVER (PARTITION BY track) AS rows_ FROM p),
b AS (SELECT track, t, idx, lon, value, floor(lat / {step!r}::DOUBLE)::BIGINT AS own_y, i, floor(lat / {step!r}::DOUBLE)::BIGINT + i AS cy FROM q, range(-1, 2) r(i) WHERE rows_ >= 4),
n AS (SELECT *, {n} AS n FROM b), x AS (SELECT *, floor((lon + 180) / 360 * n)::BIGINT % n AS at_x FROM n),
o AS (SELECT track, idx, own_y, at_x AS own_x FROM x WHERE i = 0),
c AS (SELECT DISTINCT track, t, idx, value AS v, cy, (at_x + j + n) % n AS cx FROM x, range(-1, 2) r(j) WHERE value IS NOT NULL),
m AS (SELECT c.*, own_y, own_x, t - last_value(CASE WHEN cy = own_y AND cx = own_x THEN t END IGNORE NULLS) OVER (PARTITION BY c.track, cy, cx ORDER BY t, c.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {_GAP} AS back FROM c JOIN o ON o.track = c.track AND o.idx = c.idx)"""


ORACLE_SQL = {
    "path_revisits": f"""WITH {POSITIONS_SQL}, {_cells(_M)},
a AS (SELECT track, cy, cx FROM m WHERE back UNION SELECT track, own_y, own_x FROM m WHERE back),
k AS (SELECT track, cy, cx, avg(v) AS pooled FROM m SEMI JOIN a USING (track, cy, cx) GROUP BY ALL)
SELECT p.track, p.idx, value IS NOT NULL AND pooled IS NOT NULL AS back, round(CASE WHEN value IS NOT NULL THEN coalesce(pooled, value) END, 6) AS value
FROM p LEFT JOIN o ON o.track = p.track AND o.idx = p.idx LEFT JOIN k ON k.track = p.track AND k.cy = own_y AND k.cx = own_x""",
    "path_retraces": f"WITH {POSITIONS_SQL}, {_cells(_M)} SELECT p.track, coalesce(bool_or(back), false) AS retraces FROM (SELECT DISTINCT track FROM p) p LEFT JOIN m ON m.track = p.track GROUP BY p.track",
}
