"""Response delay: a body's reading at a time belongs to the place of some seconds before. As-of joins of a track with itself.

All meet by one union of the rows with the moments asked about and one window: linear in the rows, no pairs. A moment
outside the recording meets nothing. Times that differ by under a microsecond are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import POSITIONS_SQL, positions
from .windows import by_time

#: Least, most and usual delay in seconds; times this close are equal.
LEAST_S, MOST_S, USUAL_S, EPS_S = 0.0, 8.0, 2.0, 1e-6


def normalised(seconds: Column) -> Column:
    """Within the limits; what is no number is the usual delay."""
    number = seconds.cast("double")
    return F.when(number.isNull() | F.isnan(number), USUAL_S).otherwise(F.greatest(F.lit(LEAST_S), F.least(F.lit(MOST_S), number)))


def _met(df: DataFrame, shift: float, columns: list[str]) -> DataFrame:
    """Each row with ``at`` (t + shift), ``_k``: the last row at or before it, and ``_next``: the row after that one."""
    row = F.struct("t", "idx", *columns)
    known = df.select("track", "t", "idx", row.alias("_row"), F.lead(row).over(by_time()).alias("_after"))
    kept = known.select("track", F.col("t").alias("_at"), F.lit(0).alias("_side"), "idx", "t", F.struct("_row", "_after").alias("_pair"))
    asked = known.select("track", (F.col("t") + shift + EPS_S).alias("_at"), F.lit(1).alias("_side"), "idx", "t", F.lit(None).cast(kept.schema["_pair"].dataType).alias("_pair"))
    w = Window.partitionBy("track").orderBy("_at", "_side", "idx").rowsBetween(Window.unboundedPreceding, 0)
    met = kept.unionByName(asked).withColumn("_pair", F.last("_pair", True).over(w)).where("_side = 1")
    return met.select("track", "t", "idx", (F.col("t") + shift).alias("at"), F.col("_pair._row").alias("_k"), F.col("_pair._after").alias("_next"))


def nearest_row(df: DataFrame, shift: float, columns: list[str]) -> DataFrame:
    """(track, t, idx, row): the row nearest to ``t + shift`` as a struct (t, idx, columns), the earlier of two as near; null outside."""
    m = _met(df, shift, columns)
    ended = F.col("_next").isNull() & (F.col("at") > F.col("_k.t") + EPS_S)
    later = F.col("_next.t") - F.col("at") < F.col("at") - F.col("_k.t")
    return m.select("track", "t", "idx", F.when(ended, None).when(later, F.col("_next")).otherwise(F.col("_k")).alias("row"))


def place_rows(df: DataFrame, delay: float) -> DataFrame:
    """(track, t, idx, place_idx): the row where the reading of ``idx`` was caused; null outside or without a position."""
    got = nearest_row(df, -delay, ["lat", "lon"])
    return got.select("track", "t", "idx", F.when(F.col("row.lat").isNotNull() & F.col("row.lon").isNotNull(), F.col("row.idx")).alias("place_idx"))


def places(df: DataFrame, delay: float) -> DataFrame:
    """(track, t, idx, lat, lon): the position at ``t - delay``, between two rows on the line; at a gap that of the row before."""
    m = _met(df, -delay, ["lat", "lon"])
    span = F.col("_next.t") - F.col("_k.t")
    share = F.when(span > 0, (F.col("at") - F.col("_k.t")) / span).otherwise(0.0)
    still = (share <= EPS_S) | F.col("_next.lat").isNull() | F.col("_next.lon").isNull()
    between = lambda c: F.when(F.coalesce(still, F.lit(True)), F.col(f"_k.{c}")).otherwise(F.col(f"_k.{c}") + share * (F.col(f"_next.{c}") - F.col(f"_k.{c}")))
    placed = F.col("_k.lat").isNotNull() & F.col("_k.lon").isNotNull()
    return m.select("track", "t", "idx", F.when(placed, between("lat")).alias("lat"), F.when(placed, between("lon")).alias("lon"))


def by_place(df: DataFrame, value: str, delay: float) -> DataFrame:
    """(track, t, idx, value): at each place the reading that it caused; null where there is none yet."""
    return nearest_row(df, delay, [value]).select("track", "t", "idx", F.col(f"row.{value}").alias(value))


def placed_at_every_delay(df: DataFrame, most: float = MOST_S) -> DataFrame:
    """``df`` with ``placed``: every row from ``most`` seconds before up to the row itself has a position."""
    missing = F.when(F.col("lat").isNull() | F.col("lon").isNull(), F.row_number().over(by_time()))
    marked = df.withColumns({"_r": F.row_number().over(by_time()), "_gap": F.max(missing).over(by_time().rowsBetween(Window.unboundedPreceding, 0))})
    from_ = _met(marked, -most, ["_r"]).select("track", "idx", F.col("_k._r").alias("_from"))
    both = marked.join(from_, ["track", "idx"])
    return both.withColumn("placed", F.coalesce(F.col("_from").isNotNull() & (F.col("_gap").isNull() | (F.col("_gap") < F.col("_from"))), F.lit(False))).drop("_r", "_gap", "_from")


def _gappy(spark, d):
    """Every ninth row has no position."""
    p = positions(spark, d)
    some = lambda c: F.when(F.col("idx") % 9 != 0, F.col(c))
    return p.withColumns({"lat": some("lat"), "lon": some("lon")})


DELAY = 7200.0
QUERIES = {
    "delay_place_rows": lambda s, d: place_rows(_gappy(s, d), DELAY).select("track", "idx", "place_idx"),
    "delay_places": lambda s, d: places(_gappy(s, d), DELAY).select("track", "idx", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon")),
    "delay_by_place": lambda s, d: by_place(_gappy(s, d), "value", DELAY).select("track", "idx", "value"),
    "delay_placed": lambda s, d: placed_at_every_delay(_gappy(s, d), 86400.0).select("track", "idx", "placed"),
}
_GAPPY = f"""{POSITIONS_SQL}, g AS (SELECT track, t, idx, value, CASE WHEN idx % 9 != 0 THEN lat END AS lat, CASE WHEN idx % 9 != 0 THEN lon END AS lon, row_number() OVER (PARTITION BY track ORDER BY t, idx) AS r FROM p),
n AS (SELECT *, lead(t) OVER w AS t2, lead(idx) OVER w AS idx2, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(value) OVER w AS value2 FROM g WINDOW w AS (PARTITION BY track ORDER BY t, idx)),
m AS (SELECT g.track, g.idx, g.r, g.t + {{0}} AS moment, n.t AS kt, n.idx AS kidx, n.lat AS klat, n.lon AS klon, n.value AS kvalue, n.r AS kr, t2, idx2, lat2, lon2, value2
  FROM g ASOF LEFT JOIN n ON g.track = n.track AND g.t + {{0}} + 1e-6::double >= n.t),
h AS (SELECT *, CASE WHEN kt IS NULL OR (t2 IS NULL AND moment > kt + 1e-6::double) THEN 0 WHEN t2 - moment < moment - kt THEN 2 ELSE 1 END AS pick FROM m)"""
ORACLE_SQL = {
    "delay_place_rows": f"WITH {_GAPPY.format('-7200')} SELECT track, idx, CASE pick WHEN 1 THEN CASE WHEN klat IS NOT NULL THEN kidx END WHEN 2 THEN CASE WHEN lat2 IS NOT NULL THEN idx2 END END AS place_idx FROM h",
    "delay_places": f"""WITH {_GAPPY.format('-7200')}, s AS (SELECT *, CASE WHEN t2 > kt THEN (moment - kt) / (t2 - kt) ELSE 0 END AS f FROM h)
SELECT track, idx, round(CASE WHEN f <= 1e-6::double OR lat2 IS NULL THEN klat ELSE klat + f * (lat2 - klat) END, 8) AS lat, round(CASE WHEN f <= 1e-6::double OR lat2 IS NULL THEN klon ELSE klon + f * (lon2 - klon) END, 8) AS lon FROM s""",
    "delay_by_place": f"WITH {_GAPPY.format('7200')} SELECT track, idx, CASE pick WHEN 1 THEN kvalue WHEN 2 THEN value2 END AS value FROM h",
    "delay_placed": f"""WITH {_GAPPY.format('-86400')}, l AS (SELECT track, idx, max(CASE WHEN lat IS NULL THEN r END) OVER (PARTITION BY track ORDER BY r ROWS UNBOUNDED PRECEDING) AS gap FROM g)
SELECT h.track, h.idx, kr IS NOT NULL AND (gap IS NULL OR gap < kr) AS placed FROM h JOIN l ON l.track = h.track AND l.idx = h.idx""",
}
