"""Radio levels of bands, calibration dwells, and how fast a response rises: group sums and expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import EVENTS_SQL, events

#: Level that is noise whatever the band, rise over a band's floor that is a signal, least reach, gamma and gain of shown levels, lowest floor (dBm, dB).
HARD_FLOOR, RISE, REACH, GAMMA, GAIN, LOWEST = -90.0, 3.0, 5.0, 0.75, 1.15, -110.0
#: Bands of rise speed by their upper edge, and the rise expected of a response (seconds, of a height, to the power).
SPEEDS = ((0.625, "Very drawn-out"), (0.875, "Drawn-out"), (1.125, "Typical"), (1.375, "Brief"), (float("inf"), "Sharp"))
RISE_S, HEIGHT, POWER, ARTEFACT_S = 1.3, 0.2, 0.075, 0.5


def is_active(floor: Column, peak: Column) -> Column:
    """A band with more than noise in it."""
    return F.coalesce((peak > HARD_FLOOR) & (peak - floor >= RISE), F.lit(False))


def shown_level(level: Column, floor: Column, peak: Column, gain: float = GAIN) -> Column:
    """0 for noise, up to 1 at the band's peak, with more contrast low down; 0 without a level or in a band that isn't active."""
    least = F.greatest(F.lit(HARD_FLOOR), floor + RISE)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (level - least) / F.greatest(F.lit(REACH), peak - least)))
    return F.when(is_active(floor, peak) & (level > least), F.least(F.lit(1.0), F.pow(share, F.lit(GAMMA)) * gain)).otherwise(0.0)


def band_stats(df: DataFrame, bands: list[str]) -> DataFrame:
    """(track, band, low, high, active) of each band's levels."""
    long = df.select("track", F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).alias("v")) for b in bands))).alias("x")).select("track", "x.*")
    g = long.groupBy("track", "band").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return g.withColumn("active", is_active(F.col("low"), F.col("high")))


def band_floors(df: DataFrame, bands: list[str]) -> DataFrame:
    """(track, band, floor, sigma): the element at a tenth of the sorted levels, by rank, no lower than the lowest floor; population deviation."""
    long = df.select("track", F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).alias("v")) for b in bands))).alias("x")).select("track", "x.*").where("v is not null")
    w = Window.partitionBy("track", "band")
    ranked = long.withColumns({"_r": F.row_number().over(w.orderBy("v")) - 1, "_n": F.count("*").over(w)})
    return ranked.groupBy("track", "band").agg(F.greatest(F.lit(LOWEST), F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 10), F.col("v")))).alias("floor"), F.stddev_pop("v").alias("sigma"))


def dwell(df: DataFrame, x: str, low: float, high: float, key: str = "track") -> DataFrame:
    """(key, n, inside, below, above, mean, sigma, mean_all): mean and sample deviation of the values within the gate; 0 without enough."""
    inside = F.when(F.col(x).between(low, high), F.col(x))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(key).agg(F.count(x).alias("n"), F.count(inside).alias("inside"), F.count_if(F.col(x) < low).alias("below"), F.count_if(F.col(x) > high).alias("above"), zero(F.avg(inside)).alias("mean"), zero(F.stddev_samp(inside)).alias("sigma"), zero(F.avg(x)).alias("mean_all"))


def expected_rise(height: Column) -> Column:
    """Seconds: larger responses rise more slowly."""
    return F.when(height > 0, RISE_S * F.pow(height / HEIGHT, F.lit(POWER))).otherwise(RISE_S)


def speed_factor(rise: Column, height: Column) -> Column:
    """The expected rise over the measured one, to two decimals; 1 without a rise."""
    return F.when(rise > 0, F.floor(F.try_divide(expected_rise(height), rise) * 100 + 0.5) / 100).otherwise(1.0)


def speed_label(factor: Column) -> Column:
    out = F.lit(SPEEDS[-1][1])
    for edge, name in reversed(SPEEDS[:-1]):
        out = F.when(factor < edge, name).otherwise(out)
    return F.when(factor > 0, out)


def speed_index(factor: Column) -> Column:
    """1 to 5 by label; 0 for a factor of nothing."""
    out = F.lit(len(SPEEDS))
    for i, (edge, _) in reversed(list(enumerate(SPEEDS[:-1], 1))):
        out = F.when(factor < edge, i).otherwise(out)
    return F.when(factor > 0, out).otherwise(0)


def speed_summary(peaks: DataFrame) -> DataFrame:
    """(track, dominant, mean_factor, artefacts, one count for each label) of peaks with rise and height; of equal counts the faster label leads."""
    p = peaks.withColumn("factor", speed_factor(F.col("rise"), F.col("height")))
    p = p.withColumns({"label": speed_label(F.col("factor")), "i": speed_index(F.col("factor"))})
    counts = {name: F.count_if(F.col("label") == name) for _, name in SPEEDS}
    g = p.groupBy("track").agg(F.avg("factor").alias("mean_factor"), F.count_if((F.col("rise") > 0) & (F.col("rise") < ARTEFACT_S)).alias("artefacts"), *(c.alias(n) for n, c in counts.items()))
    top = F.array_max(F.array(*(F.struct(F.col(f"`{n}`").alias("n"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (_, n) in enumerate(SPEEDS))))
    return g.withColumn("dominant", top["name"])


def _levels(spark, d):
    e = events(spark, d)
    return e.withColumns({"rssi_815": -(F.col("value") % 70) - 30, "rssi_868": -(F.col("value") * 3 % 80) - 25})


def _shown(spark, d):
    e = _levels(spark, d)
    s = band_stats(e, ["rssi_868"]).select("track", "low", "high")
    return e.join(s, "track").select("track", "idx", F.round(shown_level(F.col("rssi_868"), F.col("low"), F.col("high")), 6).alias("level"))


def _speeds(spark, d):
    e = events(spark, d).withColumns({"rise": F.col("value") / 40, "height": (F.col("idx") % 9) / 10.0})
    return speed_summary(e).select("track", "dominant", F.round("mean_factor", 6).alias("mean_factor"), "artefacts", *(F.col(f"`{n}`").alias(n.replace("-", "_").replace(" ", "_").lower()) for _, n in SPEEDS))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


QUERIES = {
    "radio_bands": lambda s, d: _rounded(band_stats(_levels(s, d), ["rssi_815", "rssi_868"])),
    "radio_floors": lambda s, d: _rounded(band_floors(_levels(s, d), ["rssi_815", "rssi_868"])),
    "radio_levels": _shown,
    "radio_dwell": lambda s, d: _rounded(dwell(events(s, d), "value", 20.0, 60.0)),
    "response_speeds": _speeds,
}
_B = f"{EVENTS_SQL}, b AS (SELECT track, idx, 'rssi_815' AS band, -(value % 70) - 30 AS v FROM e UNION ALL SELECT track, idx, 'rssi_868', -(value * 3 % 80) - 25 FROM e)"
_ACTIVE = "coalesce({1} > -90 AND {1} - {0} >= 3, false)"
_LABEL = "CASE WHEN f < 0.625 THEN 'Very drawn-out' WHEN f < 0.875 THEN 'Drawn-out' WHEN f < 1.125 THEN 'Typical' WHEN f < 1.375 THEN 'Brief' ELSE 'Sharp' END"
ORACLE_SQL = {
    "radio_bands": f"WITH {_B} SELECT track, band, round(min(v), 6) AS low, round(max(v), 6) AS high, {_ACTIVE.format('min(v)', 'max(v)')} AS active FROM b GROUP BY track, band",
    "radio_floors": f"WITH {_B} SELECT track, band, round(greatest(-110, list_sort(list(v))[count(v) // 10 + 1]), 6) AS floor, round(stddev_pop(v), 6) AS sigma FROM b WHERE v IS NOT NULL GROUP BY track, band",
    "radio_levels": f"""WITH {_B}, s AS (SELECT track, min(v) AS lo, max(v) AS hi FROM b WHERE band = 'rssi_868' GROUP BY track), x AS (SELECT b.track, b.idx, v, lo, hi, greatest(-90, lo + 3) AS edge FROM b JOIN s USING (track) WHERE band = 'rssi_868')
SELECT track, idx, round(CASE WHEN {_ACTIVE.format('lo', 'hi')} AND v > edge THEN least(1, greatest(0, least(1, (v - edge) / greatest(5, hi - edge))) ** 0.75 * 1.15) ELSE 0 END, 6) AS level FROM x""",
    "radio_dwell": f"""WITH {EVENTS_SQL} SELECT track, count(value) AS n, count(*) FILTER (value BETWEEN 20 AND 60) AS inside, count(*) FILTER (value < 20) AS below, count(*) FILTER (value > 60) AS above,
round(coalesce(avg(value) FILTER (value BETWEEN 20 AND 60), 0), 6) AS mean, round(coalesce(stddev_samp(value) FILTER (value BETWEEN 20 AND 60), 0), 6) AS sigma, round(coalesce(avg(value), 0), 6) AS mean_all FROM e GROUP BY track""",
    "response_speeds": f"""WITH {EVENTS_SQL}, h AS (SELECT track, value / 40 AS rise, (idx % 9) / 10.0::double AS height FROM e), f AS (SELECT *, CASE WHEN rise > 0 THEN floor(CASE WHEN height > 0 THEN 1.3::double * (height / 0.2::double) ** 0.075::double ELSE 1.3::double END / rise * 100 + 0.5) / 100 ELSE 1.0 END AS f FROM h),
l AS (SELECT *, {_LABEL} AS label FROM f), c AS (SELECT track, avg(f) AS mean_factor, count(*) FILTER (rise > 0 AND rise < 0.5) AS artefacts, count(*) FILTER (f > 0 AND label = 'Very drawn-out') AS very_drawn_out, count(*) FILTER (label = 'Drawn-out') AS drawn_out,
  count(*) FILTER (label = 'Typical') AS typical, count(*) FILTER (label = 'Brief') AS brief, count(*) FILTER (label = 'Sharp') AS sharp FROM l GROUP BY track)
SELECT track, CASE greatest(very_drawn_out, drawn_out, typical, brief, sharp) WHEN sharp THEN 'Sharp' WHEN brief THEN 'Brief' WHEN typical THEN 'Typical' WHEN drawn_out THEN 'Drawn-out' ELSE 'Very drawn-out' END AS dominant,
  round(mean_factor, 6) AS mean_factor, artefacts, very_drawn_out, drawn_out, typical, brief, sharp FROM c""",
}
