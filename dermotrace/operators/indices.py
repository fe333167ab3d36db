"""Derived indices: z-scored combinations, radio levels, unit and band rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import EVENTS_SQL, events
from .windows import AREA, area, by_time, rolling_percentile, standardise

#: Weights of the combined and of the three-part index, and the reach of radio levels (dBm).
COMBINED = (0.3, 0.7)
TRIPLE = (0.1, 0.45, 0.45)
RSSI_TOP = -30.0
#: Walking speed bands (upper limit m/s, name).
BANDS = ((0.3, "standing"), (1.0, "slow"), (1.8, "walking"), (3.0, "fast"))


def combined(tonic: Column, auc: Column) -> Column:
    return COMBINED[0] * standardise(tonic) + COMBINED[1] * standardise(auc)


def triple(tonic: Column, auc: Column, density: Column) -> Column:
    return TRIPLE[0] * standardise(tonic) + TRIPLE[1] * standardise(auc) + TRIPLE[2] * standardise(density)


def band_level(rssi: Column, floor: float) -> Column:
    """0 at the floor, 1 at the top."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rssi - floor) / (RSSI_TOP - floor)))


def fog(levels: list[Column]) -> Column:
    """Root mean square of band levels, times a hundred; a missing band counts for nothing."""
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in levels), F.lit(0))
    total = sum((F.coalesce(c * c, F.lit(0.0)) for c in levels), F.lit(0.0))
    return F.when(n > 0, 100 * F.sqrt(total / n))


def speed_band(speed: Column) -> Column:
    out = F.lit("running")
    for limit, name in reversed(BANDS):
        out = F.when(speed < limit, name).otherwise(out)
    return F.when(speed.isNotNull(), out)


def microsiemens(value: Column, unit: str) -> Column:
    """From nS, uS or ohm; nothing conducts at zero ohm or less."""
    if unit == "ns":
        return value / 1000
    return F.when(value > 0, 1e6 / value).otherwise(0.0) if unit == "ohm" else value


def radio_peak(bands: list[Column], rise: float = 3.5) -> Column:
    """In any band not below both neighbours and above one of them by ``rise``."""
    w = by_time()
    found = F.lit(False)
    for c in bands:
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        found = found | F.coalesce((c >= before) & (c >= after) & ((c - before >= rise) | (c - after >= rise)), F.lit(False))
    return found


def indexed(df: DataFrame) -> DataFrame:
    made = df.withColumns({"tonic": rolling_percentile(F.col("value"), 10, 0.1), "auc": area("value", 43200.0, 0.5)})
    return made.withColumn("index", combined(F.col("tonic"), F.col("auc")))


def _radio(spark, d):
    e = events(spark, d)
    bands = [-(F.col("value") % 70) - 30, -(F.col("value") * 3 % 80) - 25]
    return e.select("track", "idx", F.round(fog([band_level(b, -100.0) for b in bands]), 4).alias("fog"), speed_band(F.col("value") / 20).alias("band"), radio_peak(bands).alias("peak"))


QUERIES = {
    "index_combined": lambda s, d: indexed(events(s, d)).select("track", "idx", F.round("index", 8).alias("index")),
    "index_radio": _radio,
}
_W = "PARTITION BY track ORDER BY t, idx"
_LEVEL = "greatest(0, least(1, (({0}) + 100) / 70))"
_PEAK = "coalesce({0} >= lag({0}) OVER w AND {0} >= lead({0}) OVER w AND ({0} - lag({0}) OVER w >= 3.5 OR {0} - lead({0}) OVER w >= 3.5), false)"
ORACLE_SQL = {
    "index_combined": f"""WITH {EVENTS_SQL}, {AREA},
f AS (SELECT *, list_sort(list(value) OVER ({_W} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)) AS fr, area / 0.5 AS auc FROM ar),
g AS (SELECT *, fr[least(floor(len(fr) * 0.1), len(fr) - 1)::int + 1] AS tonic FROM f)
SELECT track, idx, round(0.3 * (tonic - avg(tonic) OVER p) / CASE WHEN stddev_pop(tonic) OVER p > 0 THEN stddev_pop(tonic) OVER p ELSE 1 END
  + 0.7 * (auc - avg(auc) OVER p) / CASE WHEN stddev_pop(auc) OVER p > 0 THEN stddev_pop(auc) OVER p ELSE 1 END, 8) AS "index"
FROM g WINDOW p AS (PARTITION BY track)""",
    "index_radio": f"""WITH {EVENTS_SQL}, b AS (SELECT *, -(value % 70) - 30 AS x, -(value * 3 % 80) - 25 AS y FROM e)
SELECT track, idx, round(100 * sqrt(({_LEVEL.format("x")} ** 2 + {_LEVEL.format("y")} ** 2) / 2), 4) AS fog,
  CASE WHEN value / 20 < 0.3 THEN 'standing' WHEN value / 20 < 1.0 THEN 'slow' WHEN value / 20 < 1.8 THEN 'walking' WHEN value / 20 < 3.0 THEN 'fast' WHEN value IS NOT NULL THEN 'running' END AS band,
  {_PEAK.format("x")} OR {_PEAK.format("y")} AS peak FROM b WINDOW w AS ({_W})""",
}
