"""Joins over time and space as equi-joins: as-of, interval, radius and one-to-one matching.

None compares all pairs: as-of carries the last row along one sort, an interval or radius join meets on buckets of the
tolerance's size and then compares. Radius cells have each band of latitude's own width, so that they hold at any
latitude and across 180 degrees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.stats import erf
from ..plans.lineage import cut
from ..sources.tables import EVENTS_SQL, POSITIONS_SQL, events, positions


def asof(left: DataFrame, right: DataFrame, value: str, direction: str = "backward") -> DataFrame:
    """Each left row (track, t, idx) with ``right_t`` and ``value`` of the last right row at or before it (forward: the next).

    One union and one window instead of a join. A right row at the same time counts.
    """
    both = left.select("track", "t", "idx", F.lit(1).alias("_side"), F.lit(None).cast("double").alias("right_t"), F.lit(None).cast(right.schema[value].dataType).alias(value))
    both = both.unionByName(right.select("track", "t", "idx", F.lit(0 if direction == "backward" else 2).alias("_side"), F.col("t").alias("right_t"), value))
    order = ["t", "_side", "idx"] if direction == "backward" else [F.desc("t"), F.desc("_side"), F.desc("idx")]
    w = Window.partitionBy("track").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # a running frame either way
    row = F.when(F.col("_side") != 1, F.struct("right_t", value))
    return both.withColumn("_row", F.last(row, True).over(w)).where("_side = 1").select("track", "t", "idx", "_row.right_t", f"_row.{value}")


def nearest(left: DataFrame, right: DataFrame, value: str, tolerance: float) -> DataFrame:
    """The right row nearest in time within the tolerance; the earlier of two as near."""
    return _nearer(asof(left, right, value), asof(left, right, value, "forward"), value, tolerance)


def asof_other(rows: DataFrame, value: str, direction: str = "backward") -> DataFrame:
    """``asof`` of each row with all other rows of its track: no row meets itself."""
    row = F.struct("idx", F.col("t").alias("right_t"), value)
    w, same = Window.partitionBy("track").orderBy("t", "idx"), Window.partitionBy("track", "t").orderBy("idx")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tied, beside = (F.last(row).over(whole), F.lag(row).over(w)) if direction == "backward" else (F.first(row).over(whole), F.lead(row).over(w))
    met = rows.withColumns({"_tied": tied, "_beside": beside})
    met = met.withColumn("_row", F.when(F.col("_tied.idx") != F.col("idx"), F.col("_tied")).otherwise(F.col("_beside")))
    return met.select("track", "t", "idx", "_row.right_t", f"_row.{value}")


def nearest_other(rows: DataFrame, value: str, tolerance: float) -> DataFrame:
    """``nearest`` of each row among all other rows of its track."""
    return _nearer(asof_other(rows, value), asof_other(rows, value, "forward"), value, tolerance)


def _nearer(b: DataFrame, f: DataFrame, value: str, tolerance: float) -> DataFrame:
    f = f.select("track", "idx", F.col("right_t").alias("_t"), F.col(value).alias("_value"))
    both = b.join(f, ["track", "idx"])
    later = F.col("right_t").isNull() | (F.col("_t") - F.col("t") < F.col("t") - F.col("right_t"))
    out = both.withColumn("_pick", F.when(later, F.struct(F.col("_t").alias("right_t"), F.col("_value").alias(value))).otherwise(F.struct("right_t", value)))
    near = F.abs(F.col("_pick.right_t") - F.col("t")) <= tolerance
    return out.select("track", "t", "idx", F.when(near, F.col("_pick.right_t")).alias("right_t"), F.when(near, F.col(f"_pick.{value}")).alias(value))


def within(left: DataFrame, right: DataFrame, seconds: float) -> DataFrame:
    """Pairs of a track no further apart than ``seconds``: (track, left_idx, right_idx, dt). Meets on buckets of that size."""
    a = left.select("track", F.col("idx").alias("left_idx"), F.col("t").alias("left_t"), F.floor(F.col("t") / seconds).alias("bucket"))
    b = right.select("track", F.col("idx").alias("right_idx"), F.col("t").alias("right_t"), F.explode(F.array(*(F.floor(F.col("t") / seconds) + k for k in (-1, 0, 1)))).alias("bucket"))
    dt = F.col("right_t") - F.col("left_t")
    return a.join(b, ["track", "bucket"]).where(F.abs(dt) <= seconds).select("track", "left_idx", "right_idx", dt.alias("dt"))


def matched(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs, the closest first (ties by the left, then the right idx): a row whose nearest is taken gets its next.

    In each round every pair that is the first for both of its rows is taken, and the other pairs of these rows go. That
    gives the same pairs as taking one after another, in as many rounds as there are pairs that wait for one another.
    """
    rest, taken = cut(pairs.select("track", "left_idx", "right_idx", "dt")), None
    while True:
        by = lambda side: F.row_number().over(Window.partitionBy("track", side).orderBy(F.abs("dt"), "left_idx", "right_idx"))
        ranked = rest.withColumns({"_a": by("left_idx"), "_b": by("right_idx")})
        first = cut(ranked.where("_a = 1 and _b = 1").drop("_a", "_b"))
        if first.isEmpty():
            return first if taken is None else taken
        taken = first if taken is None else taken.unionByName(first)
        rest = cut(rest.join(first.select("track", "left_idx"), ["track", "left_idx"], "left_anti").join(first.select("track", "right_idx"), ["track", "right_idx"], "left_anti"))


def unmatched(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """The entries (track, idx) that no pair has on its right: stored labels or exclusions without a row that shows them."""
    return entries.join(pairs.select("track", F.col("right_idx").alias("idx")), ["track", "idx"], "left_anti")


def relabelled(rows: DataFrame, entries: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """``rows`` with the ``column`` of the entry that each is paired with; rows without one keep their own."""
    new = pairs.select("track", F.col("left_idx").alias("idx"), F.col("right_idx").alias("_entry")).join(entries.select("track", F.col("idx").alias("_entry"), F.col(column).alias("_new")), ["track", "_entry"])
    return rows.join(new.drop("_entry"), ["track", "idx"], "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def density(samples: DataFrame, peaks: DataFrame, window: float) -> DataFrame:
    """Gaussian density of peaks a minute at each sample: sigma is a quarter of the window, cut at 3.5 sigma.

    Near a track's ends it is divided by the share of the kernel that lies inside the recording, a half at least.
    """
    sigma = window / 4
    weight = F.exp(-F.pow("dt", F.lit(2)) / (2 * sigma**2)) * 60 / (2.5066282746310002 * sigma)
    near = within(samples, peaks, 3.5 * sigma).groupBy("track", "left_idx").agg(F.sum(weight).alias("density"))
    whole, below = Window.partitionBy("track"), lambda x: 0.5 * (1 + erf(x / (sigma * 2**0.5)))
    inside = below(F.max("t").over(whole) - F.col("t")) - below(F.min("t").over(whole) - F.col("t"))
    marked = samples.withColumn("_inside", F.greatest(F.lit(0.5), inside))
    return marked.join(near.withColumnRenamed("left_idx", "idx"), ["track", "idx"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)) / F.col("_inside")).drop("_inside")


def radius_counts(points: DataFrame, features: DataFrame, metres: float) -> DataFrame:
    """Features within ``metres`` of each point, by a grid of cells of that size: (idx, n, nearest)."""
    band = geo.band_of(F.col("lat"), metres)
    pts = points.select("idx", "lat", "lon", band.alias("cy"), geo.column_of(F.col("lon"), band, metres).alias("cx"))
    near = geo.near_cells(F.col("f_lat"), F.col("f_lon"), metres)
    fts = features.select(F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon")).select("f_lat", "f_lon", F.explode(near).alias("c")).select("f_lat", "f_lon", "c.cy", "c.cx")
    d = geo.distance(F.col("lat"), F.col("lon"), F.col("f_lat"), F.col("f_lon"))
    hit = pts.join(fts, ["cy", "cx"]).withColumn("d", d).where(F.col("d") <= metres).groupBy("idx").agg(F.count("*").alias("n"), F.min("d").alias("nearest"))
    return points.select("idx").join(hit, "idx", "left").select("idx", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "nearest")


def _met(df):
    return df.select("track", "idx", F.round("right_t", 3).alias("right_t"), F.round("value", 4).alias("value"))


def _purchases(spark, d):
    return events(spark, d).where("kind = 'purchase'")


def _matched(spark, d):
    """Clicks with views, within four hours."""
    e = events(spark, d)
    return matched(within(e.where("kind = 'click'"), e.where("kind = 'view'"), 14400.0)).select("track", "left_idx", "right_idx", F.round("dt", 3).alias("dt"))


def _density(spark, d):
    e = events(spark, d)
    return density(e, e.where("value > 60"), 28800.0).select("track", "idx", F.round("density", 6).alias("density"))


def _radius(spark, d):
    p = positions(spark, d)
    return radius_counts(p, p.where("kind = 'purchase'").select("lat", "lon").distinct(), 60.0).select("idx", "n", F.round("nearest", 3).alias("nearest"))


def _unmatched(spark, d):
    e = events(spark, d)
    views = e.where("kind = 'view'")
    return unmatched(views, matched(within(e.where("kind = 'click'"), views, 14400.0))).select("track", "idx")


QUERIES = {
    "join_asof": lambda s, d: _met(asof(events(s, d), _purchases(s, d), "value")),
    "join_nearest": lambda s, d: _met(nearest(events(s, d), _purchases(s, d), "value", 7200.0)),
    "join_asof_other": lambda s, d: _met(asof_other(events(s, d), "value")),
    "join_nearest_other": lambda s, d: _met(nearest_other(events(s, d), "value", 7200.0)),
    "join_matched": _matched,
    "join_unmatched": _unmatched,
    "join_density": _density,
    "join_radius": _radius,
}

_TOTAL = "row_number() OVER (PARTITION BY track ORDER BY abs(dt), left_idx, right_idx)"
_GREEDY = f"""WITH RECURSIVE {EVENTS_SQL},
p AS (SELECT *, {_TOTAL} AS k FROM (SELECT a.track, a.idx AS left_idx, b.idx AS right_idx, b.t - a.t AS dt FROM e a JOIN e b ON a.track = b.track AND abs(b.t - a.t) <= 14400 WHERE a.kind = 'click' AND b.kind = 'view')),
g AS (
  SELECT track, k, [left_idx] AS ls, [right_idx] AS rs, left_idx, right_idx, dt, true AS ok FROM p WHERE k = 1
  UNION ALL
  SELECT track, k, CASE WHEN ok THEN list_append(ls, left_idx) ELSE ls END, CASE WHEN ok THEN list_append(rs, right_idx) ELSE rs END, left_idx, right_idx, dt, ok
  FROM (SELECT p.track, p.k, g.ls, g.rs, p.left_idx, p.right_idx, p.dt, NOT list_contains(g.ls, p.left_idx) AND NOT list_contains(g.rs, p.right_idx) AS ok FROM g JOIN p ON p.track = g.track AND p.k = g.k + 1))"""
_ERF = "(sign({0}) * (1 - (((((1.061405429::double * u{1} - 1.453152027::double) * u{1}) + 1.421413741::double) * u{1} - 0.284496736::double) * u{1} + 0.254829592::double) * u{1} * exp(-({0}) * ({0}))))"
ORACLE_SQL = {
    "join_asof": f"WITH {EVENTS_SQL}, b AS (SELECT * FROM e WHERE kind = 'purchase') SELECT e.track, e.idx, round(b.t, 3) AS right_t, round(b.value, 4) AS value FROM e ASOF LEFT JOIN b ON e.track = b.track AND e.t >= b.t",
    "join_nearest": f"""WITH {EVENTS_SQL},
n AS (SELECT a.track, a.idx, b.t, b.value, row_number() OVER (PARTITION BY a.track, a.idx ORDER BY abs(b.t - a.t), b.t) AS r
  FROM e a JOIN e b ON a.track = b.track AND b.kind = 'purchase' AND abs(b.t - a.t) <= 7200)
SELECT a.track, a.idx, round(n.t, 3) AS right_t, round(n.value, 4) AS value FROM e a LEFT JOIN n ON n.track = a.track AND n.idx = a.idx AND n.r = 1""",
    "join_asof_other": f"""WITH {EVENTS_SQL},
n AS (SELECT a.track, a.idx, b.t, b.value, row_number() OVER (PARTITION BY a.track, a.idx ORDER BY b.t DESC, b.idx DESC) AS r FROM e a JOIN e b ON a.track = b.track AND b.t <= a.t AND b.idx != a.idx)
SELECT a.track, a.idx, round(n.t, 3) AS right_t, round(n.value, 4) AS value FROM e a LEFT JOIN n ON n.track = a.track AND n.idx = a.idx AND n.r = 1""",
    "join_nearest_other": f"""WITH {EVENTS_SQL},
n AS (SELECT a.track, a.idx, b.t, b.value, row_number() OVER (PARTITION BY a.track, a.idx ORDER BY abs(b.t - a.t), b.t, CASE WHEN b.t <= a.t THEN -b.idx ELSE b.idx END) AS r FROM e a JOIN e b ON a.track = b.track AND abs(b.t - a.t) <= 7200 AND b.idx != a.idx)
SELECT a.track, a.idx, round(n.t, 3) AS right_t, round(n.value, 4) AS value FROM e a LEFT JOIN n ON n.track = a.track AND n.idx = a.idx AND n.r = 1""",
    "join_matched": f"{_GREEDY} SELECT track, left_idx, right_idx, round(dt, 3) AS dt FROM g WHERE ok",
    "join_unmatched": f"{_GREEDY} SELECT track, idx FROM e WHERE kind = 'view' AND NOT EXISTS (FROM g WHERE ok AND g.track = e.track AND g.right_idx = e.idx)",
    "join_density": f"""WITH {EVENTS_SQL}, k AS (SELECT * FROM e WHERE value > 60),
s AS (SELECT e.track, e.idx, e.t, coalesce(sum(exp(-1 * ((k.t - e.t) ** 2) / (2 * 7200.0 ** 2)) * 60 / (2.5066282746310002e0 * 7200)), 0) AS d FROM e LEFT JOIN k ON k.track = e.track AND abs(k.t - e.t) <= 25200 GROUP BY e.track, e.idx, e.t),
z AS (SELECT *, (max(t) OVER (PARTITION BY track) - t) / (7200 * sqrt(2)) AS x1, (min(t) OVER (PARTITION BY track) - t) / (7200 * sqrt(2)) AS x2 FROM s),
u AS (SELECT *, 1 / (1 + 0.3275911::double * abs(x1)) AS u1, 1 / (1 + 0.3275911::double * abs(x2)) AS u2 FROM z)
SELECT track, idx, round(d / greatest(0.5, 0.5 * {_ERF.format("x1", 1)} - 0.5 * {_ERF.format("x2", 2)}), 6) AS density FROM u""",
    "join_radius": f"""WITH {POSITIONS_SQL}, f AS (SELECT DISTINCT lat, lon FROM p WHERE kind = 'purchase'),
d AS (SELECT p.idx, sqrt(((f.lat - p.lat) * 111320) ** 2 + ((f.lon - p.lon) * 111320 * cos(radians(p.lat))) ** 2) AS d FROM p JOIN f ON abs(f.lat - p.lat) * 111320 <= 60)
SELECT p.idx, count(d) FILTER (d <= 60) AS n, round(min(d) FILTER (d <= 60), 3) AS nearest FROM p LEFT JOIN d USING (idx) GROUP BY p.idx""",
}
