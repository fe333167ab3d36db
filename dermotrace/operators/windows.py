"""Window operators over tracks: Column expressions on frames that are cut at a track's ends.

Every function takes the value column and a frame or window; a null value is left out of sorted frames and sums. All
of it is one sort by (track, time) and stays in the JVM; frames of one length share that sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.tables import EVENTS_SQL, events

ORDER = ("t", "idx")


def by_time(track: str = "track") -> WindowSpec:
    return Window.partitionBy(track).orderBy(*ORDER)


def rows(half: int, track: str = "track") -> WindowSpec:
    """Centred frame of ``half`` rows to each side."""
    return by_time(track).rowsBetween(-half, half)


def whole(track: str = "track") -> WindowSpec:
    return Window.partitionBy(track)


def rank_of(values: Column, p: float) -> Column:
    """Nearest-rank element floor(n * p) of an array (the upper median at 0.5); the last one at most."""
    n = F.size(values)
    return F.element_at(F.array_sort(values), F.least(F.floor(n * F.lit(p)), n - 1).cast("int") + 1)


def rolling_percentile(x: Column, half: int, p: float) -> Column:
    return rank_of(F.collect_list(x).over(rows(half)), p)


def rolling_min(x: Column, half: int) -> Column:
    return F.min(x).over(rows(half))


def moving_average(x: Column, half: int) -> Column:
    return F.avg(x).over(rows(half))


def hampel(df: DataFrame, x: str, half: int, n_sigma: float = 3.0, out: str | None = None) -> DataFrame:
    """Values further from the rolling median than ``n_sigma`` scaled MADs (1e-5 at least) become the median."""
    out = out or x
    framed = df.withColumn("_frame", F.collect_list(x).over(rows(half))).withColumn("_median", rank_of(F.col("_frame"), 0.5))
    mad = rank_of(F.transform("_frame", lambda v: F.abs(v - F.col("_median"))), 0.5)
    far = F.abs(F.col(x) - F.col("_median")) > F.greatest(F.lit(n_sigma * 1.4826) * mad, F.lit(1e-5))
    return framed.withColumn(out, F.when(far, F.col("_median")).otherwise(F.col(x))).drop("_frame", "_median")


def standardise(x: Column) -> Column:
    """z-score within a track; a constant track has zeros."""
    sigma = F.stddev_pop(x).over(whole())
    return (x - F.avg(x).over(whole())) / F.when(sigma > 0, sigma).otherwise(1.0)


def noise_floor(df: DataFrame, x: str, half: int) -> DataFrame:
    """Standard deviation of first differences in the frame over the root of two, 1e-6 at least."""
    d = df.withColumn("_d", F.col(x) - F.lag(x).over(by_time()))
    return d.withColumn("noise", F.greatest(F.coalesce(F.stddev_pop("_d").over(rows(half)), F.lit(0.0)) / F.lit(2**0.5), F.lit(1e-6))).drop("_d")


def area(x: str, half_s: float, fs: float = 1.0) -> Column:
    """Integral of the positive part within ``half_s`` seconds to each side: the sum over the rate ``fs``.

    Where the frame reaches over an end of the track it is scaled to the whole frame, from half of it at least.
    """
    total = F.expr(f"sum(greatest({x}, 0D)) over (partition by track order by t range between {float(half_s)}D preceding and {float(half_s)}D following)")
    t, first, last = F.col("t"), F.min("t").over(whole()), F.max("t").over(whole())
    covered = F.least(t + half_s, last) - F.greatest(t - half_s, first)
    scale = F.when((covered > 0) & (covered < 2 * half_s), 2 * half_s / F.greatest(covered, F.lit(float(half_s)))).otherwise(1.0)
    return total / fs * scale


def percentile_rank(x: Column) -> Column:
    """Share of a track's values that are as low or lower; 0.5 for a single one."""
    return F.when(F.count(x).over(whole()) <= 1, 0.5).otherwise(F.cume_dist().over(Window.partitionBy("track").orderBy(x)))


def local_maximum(x: Column) -> Column:
    """Above the row before and not below the row after."""
    return (x > F.lag(x).over(by_time())) & (x >= F.lead(x).over(by_time()))


def responses(df: DataFrame, half_outlier: int = 5, half_baseline: int = 10, threshold: float = 20.0) -> DataFrame:
    """Outliers replaced, rolling 10th percentile as baseline, positive rest, its local maxima over the threshold."""
    clean = hampel(df, "value", half_outlier, out="clean")
    phasic = clean.withColumn("tonic", rolling_percentile(F.col("clean"), half_baseline, 0.1)).withColumn("phasic", F.greatest(F.col("clean") - F.col("tonic"), F.lit(0.0)))
    return phasic.withColumn("peak", F.coalesce(local_maximum(F.col("phasic")), F.lit(False)) & (F.col("phasic") > threshold))


def response_summary(df: DataFrame) -> DataFrame:
    """Per track: rows, responses, responses an hour and their mean amplitude."""
    hours = (F.max("t") - F.min("t")) / 3600
    n = F.count_if("peak")
    return responses(df).groupBy("track").agg(F.count("*").alias("n_rows"), n.alias("n_peaks"), F.round(n / F.when(hours > 0, hours), 4).alias("per_hour"), F.round(F.coalesce(F.avg(F.when(F.col("peak"), F.col("phasic"))), F.lit(0.0)), 4).alias("mean_amplitude"))


def _query(build):
    return lambda spark, sf_dir: build(events(spark, sf_dir))


def _rounded(c: Column, name: str) -> Column:
    return F.round(c, 4).alias(name)


QUERIES = {
    "window_hampel": _query(lambda e: hampel(e, "value", 5, out="clean").select("track", "idx", _rounded(F.col("clean"), "clean"))),
    "window_percentile": _query(lambda e: e.select("track", "idx", _rounded(rolling_percentile(F.col("value"), 10, 0.1), "p10"), _rounded(rolling_percentile(F.col("value"), 3, 0.5), "median"), _rounded(rolling_min(F.col("value"), 6), "low"))),
    "window_standardise": _query(lambda e: e.select("track", "idx", (F.round(standardise(F.col("value")), 4) + F.lit(0.0)).alias("z"), _rounded(percentile_rank(F.col("value")), "rank"), F.round(moving_average(F.col("value"), 4), 8).alias("smooth"))),
    "window_noise_floor": _query(lambda e: noise_floor(e, "value", 8).select("track", "idx", _rounded(F.col("noise"), "noise"))),
    "window_area": _query(lambda e: e.select("track", "idx", _rounded(area("value", 43200.0, 0.5), "area"))),
    "response_summary": _query(response_summary),
}

_W = "PARTITION BY track ORDER BY t, idx"
_RANK = "list_sort({0})[least(floor(len({0}) * {1}), len({0}) - 1)::int + 1]"
_HAMPEL = f"""
f AS (SELECT *, list(value) FILTER (value IS NOT NULL) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS fr FROM e),
m AS (SELECT *, {_RANK.format("fr", 0.5)} AS med FROM f),
d AS (SELECT *, list_transform(fr, lambda v: abs(v - med)) AS dev FROM m),
h AS (SELECT track, t, idx, CASE WHEN abs(value - med) > greatest(4.4478 * {_RANK.format("dev", 0.5)}, 1e-5) THEN med ELSE value END AS clean FROM d)"""

AREA = """ac AS (SELECT *, sum(greatest(value, 0)) OVER (PARTITION BY track ORDER BY t RANGE BETWEEN 43200 PRECEDING AND 43200 FOLLOWING) AS total,
  least(t + 43200, max(t) OVER (PARTITION BY track)) - greatest(t - 43200, min(t) OVER (PARTITION BY track)) AS covered FROM e),
ar AS (SELECT *, total * CASE WHEN covered > 0 AND covered < 86400 THEN 86400 / greatest(covered, 43200) ELSE 1 END AS area FROM ac)"""
ORACLE_SQL = {
    "window_hampel": f"WITH {EVENTS_SQL}, {_HAMPEL} SELECT track, idx, round(clean, 4) AS clean FROM h",
    "window_percentile": f"""WITH {EVENTS_SQL},
f AS (SELECT track, idx, list(value) OVER ({_W} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS a, list(value) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS b,
  min(value) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS low FROM e)
SELECT track, idx, round({_RANK.format("a", 0.1)}, 4) AS p10, round({_RANK.format("b", 0.5)}, 4) AS median, round(low, 4) AS low FROM f""",
    "window_standardise": f"""WITH {EVENTS_SQL}
SELECT track, idx, round((value - avg(value) OVER p) / CASE WHEN stddev_pop(value) OVER p > 0 THEN stddev_pop(value) OVER p ELSE 1 END, 4) + 0.0 AS z,
  round(CASE WHEN count(value) OVER p <= 1 THEN 0.5 ELSE cume_dist() OVER (PARTITION BY track ORDER BY value) END, 4) AS rank,
  round(avg(value) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 8) AS smooth FROM e WINDOW p AS (PARTITION BY track)""",
    "window_noise_floor": f"""WITH {EVENTS_SQL}, d AS (SELECT track, idx, t, value - lag(value) OVER ({_W}) AS d FROM e)
SELECT track, idx, round(greatest(coalesce(stddev_pop(d) OVER ({_W} ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING), 0) / sqrt(2), 1e-6), 4) AS noise FROM d""",
    "window_area": f"""WITH {EVENTS_SQL}, {AREA}
SELECT track, idx, round(area / 0.5, 4) AS area FROM ar""",
    "response_summary": f"""WITH {EVENTS_SQL}, {_HAMPEL},
b AS (SELECT *, list(clean) OVER ({_W} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS fr FROM h),
ph AS (SELECT track, t, idx, greatest(clean - {_RANK.format("fr", 0.1)}, 0) AS phasic FROM b),
pk AS (SELECT *, coalesce(phasic > lag(phasic) OVER ({_W}) AND phasic >= lead(phasic) OVER ({_W}), false) AND phasic > 20 AS peak FROM ph)
SELECT track, count(*) AS n_rows, count(*) FILTER (peak) AS n_peaks, round(count(*) FILTER (peak) / nullif((max(t) - min(t)) / 3600, 0), 4) AS per_hour,
  round(coalesce(avg(phasic) FILTER (peak), 0), 4) AS mean_amplitude FROM pk GROUP BY track""",
}
