"""Gaps and islands: run-length encoding, flat runs, sessions, settling. Two windows and one aggregate each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import EVENTS_SQL, events
from .windows import by_time


def numbered(df: DataFrame, starts: Column, name: str = "island") -> DataFrame:
    """Numbers islands within a track: a row where ``starts`` holds (or is null) begins one."""
    flag = F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)
    return df.withColumn("_start", flag).withColumn(name, F.sum("_start").over(by_time().rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def runs(df: DataFrame, column: str) -> DataFrame:
    """Run-length encoding: (track, island, value of the column, start, end, n)."""
    split = numbered(df, ~F.col(column).eqNullSafe(F.lag(column).over(by_time())))
    return split.groupBy("track", "island").agg(F.first(column).alias(column), F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"))


def flat_runs(df: DataFrame, value: str, least_seconds: float) -> DataFrame:
    """Runs of one identical value that last so long."""
    return runs(df, value).where((F.col("end") - F.col("start")) >= least_seconds)


def merged(spans: DataFrame, gap_seconds: float) -> DataFrame:
    """(track, start, end, n): spans of a track that lie no further apart than the gap become one."""
    w = Window.partitionBy("track").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.when(F.col("start") - reach <= gap_seconds, 0).otherwise(1)
    split = spans.withColumn("_cut", cut).withColumn("_span", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return split.groupBy("track", "_span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_span")


def sessions(df: DataFrame, gap_seconds: float) -> DataFrame:
    """(track, start, end, n): rows of a track with no longer pause between them."""
    return merged(df.select("track", F.col("t").alias("start"), F.col("t").alias("end")), gap_seconds)


def settled(df: DataFrame, value: str, share: float, hold: int, within_s: float = 10.0) -> DataFrame:
    """(track, t): the first row that ends ``hold`` changes in a row of no more than ``share`` of the larger value, within so long of the first row.

    A track that doesn't settle in this time ends at its last row within it.
    """
    before = F.lag(value).over(by_time())
    calm = F.when(F.abs(F.col(value) - before) / F.greatest(F.abs(value), F.abs(before), F.lit(1e-9)) <= share, 1).otherwise(0)
    early = df.withColumn("_calm", calm).withColumn("_first", F.min("t").over(Window.partitionBy("track"))).where(F.col("t") - F.col("_first") <= within_s)
    held = early.withColumn("_held", F.sum("_calm").over(by_time().rowsBetween(1 - hold, 0)))
    return held.groupBy("track").agg(F.coalesce(F.min(F.when(F.col("_held") == hold, F.col("t"))), F.max("t")).alias("t"))


QUERIES = {
    "islands_runs": lambda spark, d: runs(events(spark, d), "kind").select("track", "island", "kind", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n"),
    "islands_sessions": lambda spark, d: sessions(events(spark, d), 21600.0).select("track", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n"),
    "islands_settled": lambda spark, d: settled(events(spark, d), "value", 0.5, 3, 864000.0).select("track", F.round("t", 3).alias("t")),
}

_W = "PARTITION BY track ORDER BY t, idx"
ORACLE_SQL = {
    "islands_runs": f"""WITH {EVENTS_SQL}, s AS (SELECT *, CASE WHEN lag(kind) OVER ({_W}) IS DISTINCT FROM kind THEN 1 ELSE 0 END AS f FROM e),
n AS (SELECT *, sum(f) OVER ({_W} ROWS UNBOUNDED PRECEDING)::bigint AS island FROM s)
SELECT track, island, min(kind) AS kind, round(min(t), 3) AS start, round(max(t), 3) AS "end", count(*) AS n FROM n GROUP BY track, island""",
    "islands_sessions": f"""WITH {EVENTS_SQL}, s AS (SELECT *, CASE WHEN t - lag(t) OVER ({_W}) <= 21600 THEN 0 ELSE 1 END AS f FROM e),
n AS (SELECT *, sum(f) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS span FROM s)
SELECT track, round(min(t), 3) AS start, round(max(t), 3) AS "end", count(*) AS n FROM n GROUP BY track, span""",
    "islands_settled": f"""WITH {EVENTS_SQL}, c AS (SELECT *, lag(value) OVER ({_W}) AS b, min(t) OVER (PARTITION BY track) AS t0 FROM e),
d AS (SELECT *, CASE WHEN abs(value - b) / greatest(abs(value), abs(b), 1e-9) <= 0.5 THEN 1 ELSE 0 END AS calm FROM c WHERE t - t0 <= 864000),
h AS (SELECT *, sum(calm) OVER ({_W} ROWS 2 PRECEDING) AS held FROM d)
SELECT track, round(coalesce(min(t) FILTER (held = 3), max(t)), 3) AS t FROM h GROUP BY track""",
}
