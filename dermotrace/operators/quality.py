"""Quality reports of recordings: noise, outliers, spikes, flat stretches, fixes, counters, telemetry lines.

All are windows by (track, time) and combining aggregates; no recording is gathered into an array but for the frames of a
rolling median.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import EVENTS_SQL, POSITIONS_SQL, events, positions
from .islands import numbered
from .windows import by_time, rank_of, rows

#: Metres a second of a knot, the speed under which a fix is slow, edges of dilution classes.
KNOT_MPS, SLOW_MPS = 0.514444, 0.3
DILUTION = (1.0, 1.5, 2.0, 3.0, 5.0)
#: Fixed value: how much more noise counts as more, and how much less as less.
MORE, LESS = 1.2, 0.8


def basic_stats(df: DataFrame, key: str, x: str) -> DataFrame:
    """n, mean, population deviation and its share of the mean in per cent; zeros under two values."""
    n, mean, sigma = F.count(x), F.avg(x), F.stddev_pop(x)
    known = n > 1
    zero = lambda c: F.when(known, c).otherwise(0.0)
    return df.groupBy(key).agg(n.alias("n"), zero(mean).alias("mean"), zero(sigma).alias("sigma"), F.when(known & (mean > 0), sigma / mean * 100).otherwise(0.0).alias("cv_pct"))


def difference_stats(df: DataFrame, key: str, x: str) -> DataFrame:
    """Mean size, deviation, root mean square and largest size of the steps between rows; zeros without a step."""
    d = df.withColumn("_d", F.col(x) - F.lag(x).over(by_time(key)))
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return d.groupBy(key).agg(zero(F.avg(F.abs("_d")), "mean_step"), zero(F.stddev_pop("_d"), "sigma_step"), zero(F.sqrt(F.avg(F.col("_d") * F.col("_d"))), "rms_step"), zero(F.max(F.abs("_d")), "most_step"))


def outliers(df: DataFrame, x: str, half: int = 50, n_sigma: float = 3.0) -> DataFrame:
    """``outlier``: further from the rolling median than so many deviations of the track; only where the frame is whole."""
    frame = df.withColumns({"_f": F.collect_list(x).over(rows(half)), "_s": F.stddev_pop(x).over(Window.partitionBy("track"))})
    whole = F.size("_f") == 2 * half + 1
    return frame.withColumn("outlier", F.coalesce(whole & (F.abs(F.col(x) - rank_of(F.col("_f"), 0.5)) > n_sigma * F.col("_s")), F.lit(False))).drop("_f", "_s")


def spikes(df: DataFrame, x: str, threshold: float = 50.0) -> DataFrame:
    """``spike``: a step over the threshold and another one back."""
    to, back = F.col(x) - F.lag(x).over(by_time()), F.lead(x).over(by_time()) - F.col(x)
    return df.withColumn("spike", F.coalesce((F.abs(to) > threshold) & (F.abs(back) > threshold) & (to * back < 0), F.lit(False)))


def window_sigmas(df: DataFrame, x: str, size: int = 10) -> DataFrame:
    """``window_sigma`` of each row and the ``size`` - 1 after it; null where the track ends before."""
    w = by_time().rowsBetween(0, size - 1)
    return df.withColumn("window_sigma", F.when(F.count(x).over(w) == size, F.stddev_pop(x).over(w)))


def flat_regions(df: DataFrame, x: str, most_step: float = 15.0, least_rows: int = 10) -> DataFrame:
    """(track, region, start, end, n, sigma): runs of rows with steps under the limit."""
    step = F.abs(F.col(x) - F.lag(x).over(by_time()))
    split = numbered(df, F.coalesce(step >= most_step, F.lit(True)), "region")
    return split.groupBy("track", "region").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"), F.stddev_pop(x).alias("sigma")).where(F.col("n") >= least_rows)


def block_noise(df: DataFrame, x: str, size: int = 10, valid: float = 0.0) -> DataFrame:
    """(track, block, noise, level): peak to peak and mean of whole blocks of rows, all of them valid."""
    block = df.withColumn("block", F.floor((F.row_number().over(by_time()) - 1) / size))
    g = block.groupBy("track", "block").agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("level"))
    return g.where((F.col("n") == size) & (F.col("low") >= valid)).select("track", "block", (F.col("high") - F.col("low")).alias("noise"), "level")


def interpolated_percentile(df: DataFrame, key: str, x: str, share: float) -> DataFrame:
    """(key, value): between the two nearest ranks, found by rank and not by gathering."""
    w = Window.partitionBy(key)
    ranked = df.where(F.col(x).isNotNull()).withColumns({"_r": F.row_number().over(w.orderBy(x)) - 1, "_k": (F.count(x).over(w) - 1) * F.lit(share)})
    weight = F.greatest(F.lit(0.0), 1 - F.abs(F.col("_r") - F.col("_k")))
    return ranked.where(F.abs(F.col("_r") - F.col("_k")) < 1).groupBy(key).agg(F.sum(F.col(x) * weight).alias("value"))


def trimmed(df: DataFrame, x: str) -> DataFrame:
    """Without a track's rows before its first value over zero and after its last one; a track without any stays whole."""
    w = by_time().rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("track").orderBy(F.desc("t"), F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    some = F.when(F.col(x) > 0, 1).otherwise(0)
    marked = df.withColumn("_on", some).withColumns({"_a": F.max("_on").over(w), "_b": F.max("_on").over(back), "_any": F.max("_on").over(Window.partitionBy("track"))})
    return marked.where("_any = 0 or (_a = 1 and _b = 1)").drop("_on", "_a", "_b", "_any")


def noise_report(df: DataFrame, x: str, spike: float = 50.0, most_step: float = 15.0, half: int = 50) -> DataFrame:
    """A row for each track: how many rows are left of it, spread, steps, outliers, spikes, rolling and flat deviations."""
    clean = trimmed(df, x)
    total = df.groupBy("track").agg(F.count("*").alias("n_total"))
    marks = window_sigmas(spikes(outliers(clean, x, half), x, spike), x)
    counts = marks.groupBy("track").agg(F.count("*").alias("n"), (F.max(x) - F.min(x)).alias("range"), F.count_if("outlier").alias("outliers"), F.count_if("spike").alias("spikes"), F.avg("window_sigma").alias("window_mean"))
    flat = flat_regions(clean, x, most_step).groupBy("track").agg(F.count("*").alias("flat_regions"), F.avg("sigma").alias("flat_mean"))
    out = total.join(counts, "track", "left").join(basic_stats(clean, "track", x).drop("n"), "track", "left").join(difference_stats(clean, "track", x), "track", "left").join(flat, "track", "left")
    return out.withColumns({"zeros": F.col("n_total") - F.coalesce("n", F.lit(0)), "flat_regions": F.coalesce("flat_regions", F.lit(0).cast("long")), "snr": F.when(F.col("mean_step") > 0, F.col("range") / F.col("mean_step")).otherwise(0.0)})


def compared(reports: DataFrame, other: DataFrame, metrics: list[str]) -> DataFrame:
    """(track, metric, a, b, change_pct, verdict) of two reports of the same tracks."""
    long = lambda df, name: df.select("track", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics))).alias("x")).select("track", "x.*")
    both = long(reports, "a").join(long(other, "b"), ["track", "metric"])
    share = F.col("b") / F.col("a")
    verdict = F.when(share > MORE, "more").when(share < LESS, "less").otherwise("alike")
    return both.where("a != 0").select("track", "metric", "a", "b", ((share - 1) * 100).alias("change_pct"), verdict.alias("verdict"))


def dilution_class(hdop: Column) -> Column:
    out = F.lit(len(DILUTION))
    for i, edge in reversed(list(enumerate(DILUTION))):
        out = F.when(hdop <= edge, i).otherwise(out)
    return F.when(hdop > 0, out)


def fix_report(fixes: DataFrame) -> DataFrame:
    """A row for each track of fixes (lat, lon, hdop, sats, speed_kts): ranges, slow share, extent in metres."""
    real = lambda c: F.when(F.col(c) > 0, F.col(c))
    slow = F.count_if(F.coalesce("speed_kts", F.lit(0.0)) * KNOT_MPS < SLOW_MPS)
    south = (F.max("lat") - F.min("lat")) * 111_320
    east = (F.max("lon") - F.min("lon")) * 111_320 * F.cos(F.radians(F.avg("lat")))
    found = fixes.where("lat is not null and lon is not null")
    g = found.groupBy("track").agg(F.count("*").alias("fixes"), *(f(real(c)).alias(f"{c}_{n}") for c in ("hdop", "sats") for n, f in (("low", F.min), ("high", F.max), ("mean", F.avg))), F.avg(F.coalesce("speed_kts", F.lit(0.0))).alias("speed_mean"), slow.alias("slow"), south.alias("south_m"), east.alias("east_m"))
    return g.withColumn("extent_m", F.sqrt(F.col("south_m") * F.col("south_m") + F.col("east_m") * F.col("east_m")))


def dilution_histogram(fixes: DataFrame) -> DataFrame:
    g = fixes.where("lat is not null and hdop > 0").groupBy("track", dilution_class(F.col("hdop")).alias("class")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("track")))


def quality_over_time(fixes: DataFrame, size: int = 200) -> DataFrame:
    """(track, part, start, hdop and sats low, high, mean) of every ``size`` fixes."""
    real = lambda c: F.when(F.col(c) > 0, F.col(c))
    part = F.floor((F.row_number().over(by_time()) - 1) / size)
    return fixes.where("lat is not null").withColumn("part", part).groupBy("track", "part").agg(F.min("t").alias("start"), *(f(real(c)).alias(f"{c}_{n}") for c in ("hdop", "sats") for n, f in (("low", F.min), ("high", F.max), ("mean", F.avg))))


def counter_jumps(df: DataFrame, counter: str) -> DataFrame:
    """Rows where a counter is higher than at the last row that had one, with ``before``."""
    before = F.last(counter, True).over(by_time().rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("before", before).where(F.col(counter) > F.col("before"))


def telemetry(spark: SparkSession, path: str, marks: tuple[str, ...] = ("TELEMETRY", "HEARTBEAT")) -> DataFrame:
    """(file, kind, ts_ms, fields map<string,string>) of log lines ``<ms> ... <mark> key=value ...``; other lines are left out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    kind = F.regexp_extract("value", rf"\b({'|'.join(marks)})\b", 1)
    pairs = F.regexp_extract_all("value", F.lit(r"(\w+)=(\S+)"), 0)
    fields = F.map_from_entries(F.array_distinct(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1), F.substring_index(p, "=", -1)))))
    return lines.where(kind != "").select("file", kind.alias("kind"), F.regexp_extract("value", r"^\D*(\d+)", 1).cast("long").alias("ts_ms"), fields.alias("fields"))


def rolling_level(df: DataFrame, x: str, size: int = 200) -> DataFrame:
    """``level``: the mean of a centred frame, cut at a track's ends."""
    return df.withColumn("level", F.avg(x).over(rows(size // 2)))


def rise_peaks(df: DataFrame, x: str, least_rise: float = 20.0, look_rows: int = 40, rise_s: tuple[float, float] = (0.5, 4.0)) -> DataFrame:
    """Local maxima over the lowest of the rows before, with rise and rise time; of the lowest the earliest counts."""
    back = by_time().rowsBetween(-look_rows, -1)
    trough = F.min(F.struct(F.col(x).alias("v"), F.col("t").alias("t"))).over(back)
    place, n = F.row_number().over(by_time()), F.count("*").over(Window.partitionBy("track"))
    top = (F.col(x) > F.lag(x).over(by_time())) & (F.col(x) >= F.lead(x).over(by_time()))
    found = df.withColumns({"_trough": trough, "_place": place, "_n": n, "_top": top}).where("_top and _place > " + str(look_rows) + " and _place <= _n - 5 and _n >= 20")
    found = found.withColumns({"rise": F.col(x) - F.col("_trough.v"), "rise_s": F.col("t") - F.col("_trough.t")})
    return found.where((F.col("rise") >= least_rise) & F.col("rise_s").between(*rise_s)).drop("_trough", "_place", "_n", "_top")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def _fixes(spark, d):
    p = positions(spark, d)
    return p.withColumns({"hdop": F.when(F.col("idx") % 11 != 0, (F.col("idx") % 60) / 10.0), "sats": (F.col("idx") % 14).cast("int"), "speed_kts": (F.col("idx") % 9) / 4.0})


def _report(spark, d):
    r = noise_report(events(spark, d), "value", spike=30.0, most_step=25.0, half=10)
    return _rounded(r.select("track", "n_total", "n", "range", "outliers", "spikes", "window_mean", "mean", "sigma", "cv_pct", "mean_step", "sigma_step", "rms_step", "most_step", "zeros", "snr"))


def _compared(spark, d):
    e = events(spark, d)
    side = lambda rest: basic_stats(e.where(f"idx % 2 = {rest}"), "track", "value").join(difference_stats(e.where(f"idx % 2 = {rest}"), "track", "value"), "track")
    return _rounded(compared(side(0), side(1), ["n", "mean", "sigma", "cv_pct", "rms_step"]))


QUERIES = {
    "quality_noise": _report,
    "quality_compared": _compared,
    "quality_flat": lambda s, d: _rounded(flat_regions(events(s, d), "value", 45.0, 3).select("track", F.col("start").alias("start"), "end", "n", "sigma")),
    "quality_blocks": lambda s, d: _rounded(block_noise(events(s, d), "value")),
    "quality_percentile": lambda s, d: _rounded(interpolated_percentile(events(s, d), "track", "value", 0.95)),
    "quality_fixes": lambda s, d: _rounded(fix_report(_fixes(s, d))),
    "quality_dilution": lambda s, d: _rounded(dilution_histogram(_fixes(s, d))),
    "quality_over_time": lambda s, d: _rounded(quality_over_time(_fixes(s, d), 20)),
    "quality_counters": lambda s, d: counter_jumps(events(s, d).withColumn("counter", F.floor(F.col("value") / 20)), "counter").select("track", "idx", "before", "counter"),
    "quality_level": lambda s, d: _rounded(rolling_level(events(s, d), "value", 20).select("track", "idx", "level")),
    "quality_rises": lambda s, d: _rounded(rise_peaks(events(s, d), "value", 20.0, 4, (3600.0, 172800.0)).select("track", "idx", "rise", "rise_s")),
}
_W = "PARTITION BY track ORDER BY t, idx"
_FIX = f"""{POSITIONS_SQL}, f AS (SELECT track, t, idx, lat, lon, CASE WHEN idx % 11 != 0 THEN (idx % 60) / 10.0::double END AS hdop, (idx % 14)::int AS sats, (idx % 9) / 4.0::double AS speed_kts FROM p)"""
_STEP_AGG = "coalesce(avg(abs(d)), 0) AS mean_step, coalesce(stddev_pop(d), 0) AS sigma_step, coalesce(sqrt(avg(d * d)), 0) AS rms_step"
ORACLE_SQL = {
    "quality_noise": f"""WITH {EVENTS_SQL}, a AS (SELECT *, row_number() OVER ({_W}) AS r FROM e),
b AS (SELECT track, count(*) AS n_total, min(r) FILTER (value > 0) AS lo, max(r) FILTER (value > 0) AS hi FROM a GROUP BY track),
c AS (SELECT a.*, n_total FROM a JOIN b USING (track) WHERE lo IS NULL OR r BETWEEN lo AND hi),
f AS (SELECT *, list(value) OVER ({_W} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS fr, stddev_pop(value) OVER (PARTITION BY track) AS s, value - lag(value) OVER ({_W}) AS d, lead(value) OVER ({_W}) - value AS d2,
  count(value) OVER ({_W} ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS wn, stddev_pop(value) OVER ({_W} ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ws FROM c),
g AS (SELECT track, max(n_total) AS n_total, count(*) AS n, max(value) - min(value) AS range, count(*) FILTER (len(fr) = 21 AND abs(value - list_sort(fr)[11]) > 3 * s) AS outliers,
  count(*) FILTER (abs(d) > 30 AND abs(d2) > 30 AND d * d2 < 0) AS spikes, avg(ws) FILTER (wn = 10) AS window_mean, CASE WHEN count(value) > 1 THEN avg(value) ELSE 0 END AS mean,
  CASE WHEN count(value) > 1 THEN stddev_pop(value) ELSE 0 END AS sigma, {_STEP_AGG}, coalesce(max(abs(d)), 0) AS most_step FROM f GROUP BY track)
SELECT track, n_total, n, round(range, 6) AS range, outliers, spikes, round(window_mean, 6) AS window_mean, round(mean, 6) AS mean, round(sigma, 6) AS sigma, round(CASE WHEN mean > 0 THEN sigma / mean * 100 ELSE 0 END, 6) AS cv_pct,
  round(mean_step, 6) AS mean_step, round(sigma_step, 6) AS sigma_step, round(rms_step, 6) AS rms_step, round(most_step, 6) AS most_step, n_total - n AS zeros, round(CASE WHEN mean_step > 0 THEN range / mean_step ELSE 0 END, 6) AS snr FROM g""",
    "quality_compared": f"""WITH {EVENTS_SQL}, x AS (SELECT *, idx % 2 AS side, value - lag(value) OVER (PARTITION BY track, idx % 2 ORDER BY t, idx) AS d FROM e),
g AS (SELECT track, side, count(value)::double AS n, CASE WHEN count(value) > 1 THEN avg(value) ELSE 0 END AS mean, CASE WHEN count(value) > 1 THEN stddev_pop(value) ELSE 0 END AS sigma,
  CASE WHEN count(value) > 1 AND avg(value) > 0 THEN stddev_pop(value) / avg(value) * 100 ELSE 0 END AS cv_pct, coalesce(sqrt(avg(d * d)), 0) AS rms_step FROM x GROUP BY track, side),
u AS (UNPIVOT g ON n, mean, sigma, cv_pct, rms_step INTO NAME metric VALUE v)
SELECT a.track, a.metric, round(a.v, 6) AS a, round(b.v, 6) AS b, round((b.v / a.v - 1) * 100, 6) AS change_pct, CASE WHEN b.v / a.v > 1.2 THEN 'more' WHEN b.v / a.v < 0.8 THEN 'less' ELSE 'alike' END AS verdict
FROM u a JOIN u b ON a.track = b.track AND a.metric = b.metric AND a.side = 0 AND b.side = 1 WHERE a.v != 0""",
    "quality_flat": f"""WITH {EVENTS_SQL}, s AS (SELECT *, CASE WHEN abs(value - lag(value) OVER ({_W})) < 45 THEN 0 ELSE 1 END AS f FROM e),
n AS (SELECT *, sum(f) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS region FROM s)
SELECT track, round(min(t), 6) AS start, round(max(t), 6) AS "end", count(*) AS n, round(stddev_pop(value), 6) AS sigma FROM n GROUP BY track, region HAVING count(*) >= 3""",
    "quality_blocks": f"""WITH {EVENTS_SQL}, b AS (SELECT *, (row_number() OVER ({_W}) - 1) // 10 AS block FROM e)
SELECT track, block, round(max(value) - min(value), 6) AS noise, round(avg(value), 6) AS level FROM b GROUP BY track, block HAVING count(value) = 10 AND min(value) >= 0""",
    "quality_percentile": f"WITH {EVENTS_SQL} SELECT track, round(quantile_cont(value, 0.95), 6) AS value FROM e WHERE value IS NOT NULL GROUP BY track",
    "quality_fixes": f"""WITH {_FIX}, g AS (SELECT track, count(*) AS fixes, min(hdop) FILTER (hdop > 0) AS hdop_low, max(hdop) FILTER (hdop > 0) AS hdop_high, avg(hdop) FILTER (hdop > 0) AS hdop_mean,
  min(sats) FILTER (sats > 0) AS sats_low, max(sats) FILTER (sats > 0) AS sats_high, avg(sats) FILTER (sats > 0) AS sats_mean, avg(speed_kts) AS speed_mean, count(*) FILTER (speed_kts * 0.514444::double < 0.3) AS slow,
  (max(lat) - min(lat)) * 111320 AS south_m, (max(lon) - min(lon)) * 111320 * cos(radians(avg(lat))) AS east_m FROM f GROUP BY track)
SELECT track, fixes, round(hdop_low, 6) AS hdop_low, round(hdop_high, 6) AS hdop_high, round(hdop_mean, 6) AS hdop_mean, sats_low, sats_high, round(sats_mean, 6) AS sats_mean, round(speed_mean, 6) AS speed_mean, slow,
  round(south_m, 6) AS south_m, round(east_m, 6) AS east_m, round(sqrt(south_m * south_m + east_m * east_m), 6) AS extent_m FROM g""",
    "quality_dilution": f"""WITH {_FIX}, g AS (SELECT track, CASE WHEN hdop <= 1 THEN 0 WHEN hdop <= 1.5 THEN 1 WHEN hdop <= 2 THEN 2 WHEN hdop <= 3 THEN 3 WHEN hdop <= 5 THEN 4 ELSE 5 END AS class, count(*) AS n FROM f WHERE hdop > 0 GROUP BY ALL)
SELECT track, class, n, round(n / sum(n) OVER (PARTITION BY track), 6) AS share FROM g""",
    "quality_over_time": f"""WITH {_FIX}, q AS (SELECT *, (row_number() OVER ({_W}) - 1) // 20 AS part FROM f)
SELECT track, part, round(min(t), 6) AS start, round(min(hdop) FILTER (hdop > 0), 6) AS hdop_low, round(max(hdop) FILTER (hdop > 0), 6) AS hdop_high, round(avg(hdop) FILTER (hdop > 0), 6) AS hdop_mean,
  min(sats) FILTER (sats > 0) AS sats_low, max(sats) FILTER (sats > 0) AS sats_high, round(avg(sats) FILTER (sats > 0), 6) AS sats_mean FROM q GROUP BY track, part""",
    "quality_counters": f"""WITH {EVENTS_SQL}, c AS (SELECT *, floor(value / 20)::bigint AS counter FROM e), b AS (SELECT *, last_value(counter IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
SELECT track, idx, before, counter FROM b WHERE counter > before""",
    "quality_level": f"WITH {EVENTS_SQL} SELECT track, idx, round(avg(value) OVER ({_W} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 6) AS level FROM e",
    "quality_rises": f"""WITH {EVENTS_SQL}, p AS (SELECT *, row_number() OVER ({_W}) AS r, count(*) OVER (PARTITION BY track) AS n, lag(value) OVER ({_W}) AS a, lead(value) OVER ({_W}) AS b FROM e),
c AS (SELECT * FROM p WHERE value > a AND value >= b AND r > 4 AND r <= n - 5 AND n >= 20),
w AS (SELECT c.track, c.idx, c.t, c.value, q.value AS v, q.t AS qt, row_number() OVER (PARTITION BY c.track, c.idx ORDER BY q.value, q.t) AS k FROM c JOIN p q ON q.track = c.track AND q.r BETWEEN c.r - 4 AND c.r - 1)
SELECT track, idx, round(value - v, 6) AS rise, round(t - qt, 6) AS rise_s FROM w WHERE k = 1 AND value - v >= 20 AND t - qt BETWEEN 3600 AND 172800""",
}
