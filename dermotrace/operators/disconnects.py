"""Sensor disconnects: flat spans, merged, followed to where the signal settles, confirmed by a jump, and bridged.

Windows and equi-joins on row numbers; a span is one row, whatever its length. Nothing is gathered by track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import EVENTS_SQL, events
from .windows import by_time

#: Shortest flat run and longest pause between runs of a span (seconds); a calm change, how many of them, within what time; the jump of a disconnect.
FLAT_S, MERGE_S, CALM, HOLD, SETTLE_S, JUMP = 0.5, 3.0, 0.15, 3, 10.0, 3.0


def jump_ratio(a: Column, b: Column) -> Column:
    """The larger over the smaller size, whichever comes first."""
    return F.greatest(F.abs(a), F.abs(b)) / F.greatest(F.least(F.abs(a), F.abs(b)), F.lit(1e-9))


def _flat(r: DataFrame, flat_s: float, merge_s: float) -> DataFrame:
    """(track, span, start, flat_end, end_t, next_start): merged flat runs by row number."""
    w = Window.partitionBy("track").orderBy("r")
    change = F.when(F.col("value").eqNullSafe(F.lag("value").over(w)), 0).otherwise(1)
    runs = r.withColumn("_c", change).withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("track", "_run").agg(F.min("r").alias("start"), F.max("r").alias("stop"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("value").alias("n"))
    runs = runs.where((F.col("t1") - F.col("t0") >= flat_s) & (F.col("n") > 0))
    by = Window.partitionBy("track").orderBy("start")
    apart = F.when(F.col("t0") - F.lag("t1").over(by) <= merge_s, 0).otherwise(1)
    spans = runs.withColumn("_a", apart).withColumn("span", F.sum("_a").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("track", "span").agg(F.min("start").alias("start"), F.max("stop").alias("flat_end"), F.max("t1").alias("end_t"))
    return spans.withColumn("next_start", F.lead("start").over(Window.partitionBy("track").orderBy("span")))


def spans(df: DataFrame, flat_s: float = FLAT_S, merge_s: float = MERGE_S, calm: float = CALM, hold: int = HOLD, settle_s: float = SETTLE_S, jump: float = JUMP) -> DataFrame:
    """(track, span, start, end, repaired, left_t, left_v, right_t, right_v) of confirmed disconnects; rows are numbered from 1.

    A span ends where ``hold`` changes in a row are calm, or at the last row that the search may reach. A span that is open
    at either end of the recording is told but not repaired.
    """
    r = df.select("track", "t", "idx", "value", F.row_number().over(by_time()).alias("r"))
    flat = _flat(r, flat_s, merge_s)
    w = Window.partitionBy("track").orderBy("r")
    before = F.lag("value").over(w)
    change = F.abs(F.col("value") - before) / F.greatest(F.abs("value"), F.abs(before), F.lit(1e-9))
    # each row knows the last span whose flat run has ended before it, and looks for its settling
    ends = flat.select("track", F.col("flat_end").alias("r"), F.struct("span", "flat_end", "end_t", "next_start").alias("_s"))
    seen = r.withColumn("_calm", F.when(change <= calm, 1).otherwise(0)).join(ends, ["track", "r"], "left").withColumn("_s", F.last("_s", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    seen = seen.where("_s is not null and r < coalesce(_s.next_start, r + 1)").where(F.col("t") - F.col("_s.end_t") <= settle_s)
    in_span = Window.partitionBy("track", "_s.span").orderBy("r")
    held = F.sum("_calm").over(in_span.rowsBetween(1 - hold, 0))
    seen = seen.withColumn("_held", held)
    settle = seen.groupBy("track", F.col("_s.span").alias("span")).agg(F.coalesce(F.min(F.when(F.col("_held") == hold, F.col("r"))), F.max("r")).alias("settle"))
    n = r.groupBy("track").agg(F.max("r").alias("rows"))
    s = flat.join(settle, ["track", "span"], "left").join(n, "track").withColumn("end", F.coalesce("settle", "flat_end"))
    values = lambda name: r.select("track", F.col("r").alias(name), F.struct("t", "value").alias(f"_{name}"))
    s = s.withColumns({"left": F.col("start") - 1, "right": F.when((F.col("end") + 1 <= F.col("rows")) & (F.col("end") + 1 < F.coalesce("next_start", F.col("end") + 2)), F.col("end") + 1)})
    s = s.join(values("left"), ["track", "left"], "left").join(values("right"), ["track", "right"], "left").join(values("start"), ["track", "start"])
    has_left, has_right, flat_v = F.col("_left").isNotNull(), F.col("_right").isNotNull(), F.col("_start.value")
    far = lambda side: F.coalesce(jump_ratio(flat_v, F.col(f"_{side}.value")) >= jump, F.lit(False))
    confirmed = (~has_left & ~has_right) | (has_left & far("left")) | (has_right & far("right"))
    repaired = F.col("_left.value").isNotNull() & F.col("_right.value").isNotNull()
    return s.where(confirmed).select("track", "span", "start", "end", repaired.alias("repaired"), F.col("_left.t").alias("left_t"), F.col("_left.value").alias("left_v"), F.col("_right.t").alias("right_t"), F.col("_right.value").alias("right_v"))


def repaired(df: DataFrame, **options) -> DataFrame:
    """``df`` with ``repaired`` values: within repaired spans on a line between the rows beside, else as they are; ``off`` within any span."""
    found = spans(df, **options)
    r = df.withColumn("_r", F.row_number().over(by_time()))
    s = found.select("track", F.col("start").alias("_r"), F.struct("end", "repaired", "left_t", "left_v", "right_t", "right_v").alias("_s"))
    marked = r.join(s, ["track", "_r"], "left").withColumn("_s", F.last("_s", True).over(Window.partitionBy("track").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)))
    off = F.coalesce(F.col("_r") <= F.col("_s.end"), F.lit(False))
    dt = F.col("_s.right_t") - F.col("_s.left_t")
    share = F.when(dt > 0, (F.col("t") - F.col("_s.left_t")) / dt).otherwise(0.0)
    bridged = F.col("_s.left_v") + (F.col("_s.right_v") - F.col("_s.left_v")) * share
    return marked.withColumns({"off": off, "repaired": F.when(off & F.col("_s.repaired"), bridged).otherwise(F.col("value"))}).drop("_r", "_s")


OPTIONS = {"flat_s": 3600.0, "merge_s": 86400.0, "calm": 0.3, "hold": 2, "settle_s": 432000.0, "jump": 2.0}


def _stepped(spark, d):
    """Values in steps, so that some stay the same for a while."""
    return events(spark, d).withColumn("value", F.floor(F.col("value") / 40) * 10.0 + 1)


QUERIES = {
    "disconnect_spans": lambda s, d: spans(_stepped(s, d), **OPTIONS).select("track", "start", "end", "repaired", "left_v", "right_v"),
    "disconnect_repaired": lambda s, d: repaired(_stepped(s, d), **OPTIONS).select("track", "idx", "off", F.round("repaired", 8).alias("repaired")),
}
_SPANS = f"""{EVENTS_SQL}, r AS (SELECT track, t, idx, floor(value / 40) * 10.0::double + 1 AS value, row_number() OVER (PARTITION BY track ORDER BY t, idx) AS r FROM e),
c AS (SELECT *, CASE WHEN value IS NOT DISTINCT FROM lag(value) OVER w AND r > 1 THEN 0 ELSE 1 END AS c, lag(value) OVER w AS pv FROM r WINDOW w AS (PARTITION BY track ORDER BY r)),
u AS (SELECT *, sum(c) OVER (PARTITION BY track ORDER BY r ROWS UNBOUNDED PRECEDING) AS run FROM c),
runs AS (SELECT track, min(r) AS start, max(r) AS stop, min(t) AS t0, max(t) AS t1 FROM u GROUP BY track, run HAVING max(t) - min(t) >= 3600 AND count(value) > 0),
a AS (SELECT *, CASE WHEN t0 - lag(t1) OVER (PARTITION BY track ORDER BY start) <= 86400 THEN 0 ELSE 1 END AS a FROM runs),
b AS (SELECT *, sum(a) OVER (PARTITION BY track ORDER BY start ROWS UNBOUNDED PRECEDING) AS span FROM a),
flat AS (SELECT *, lead(start) OVER (PARTITION BY track ORDER BY span) AS nx FROM (SELECT track, span, min(start) AS start, max(stop) AS flat_end, max(t1) AS end_t FROM b GROUP BY track, span)),
seen AS (SELECT f.track, f.span, c.r, CASE WHEN abs(c.value - c.pv) / greatest(abs(c.value), abs(c.pv), 1e-9) <= 0.3 THEN 1 ELSE 0 END AS calm FROM flat f JOIN c ON c.track = f.track AND c.r > f.flat_end AND (nx IS NULL OR c.r < nx) AND c.t - f.end_t <= 432000),
held AS (SELECT *, sum(calm) OVER (PARTITION BY track, span ORDER BY r ROWS 1 PRECEDING) AS held FROM seen),
settle AS (SELECT track, span, coalesce(min(r) FILTER (held = 2), max(r)) AS settle FROM held GROUP BY track, span),
s AS (SELECT f.*, coalesce(settle, flat_end) AS "end", n FROM flat f LEFT JOIN settle USING (track, span) JOIN (SELECT track, count(*) AS n FROM r GROUP BY track) USING (track)),
x AS (SELECT s.*, l.t AS left_t, l.value AS left_v, q.t AS right_t, q.value AS right_v, z.value AS v, l.track IS NOT NULL AS hl, q.track IS NOT NULL AS hr FROM s
  LEFT JOIN r l ON l.track = s.track AND l.r = s.start - 1 LEFT JOIN r q ON q.track = s.track AND q.r = s."end" + 1 AND (nx IS NULL OR s."end" + 1 < nx) JOIN r z ON z.track = s.track AND z.r = s.start),
k AS (SELECT *, hl AND hr AS repaired FROM x WHERE (NOT hl AND NOT hr) OR (hl AND greatest(abs(v), abs(left_v)) / greatest(least(abs(v), abs(left_v)), 1e-9) >= 2) OR (hr AND greatest(abs(v), abs(right_v)) / greatest(least(abs(v), abs(right_v)), 1e-9) >= 2))"""
ORACLE_SQL = {
    "disconnect_spans": f'WITH {_SPANS} SELECT track, start, "end", repaired, left_v, right_v FROM k',
    "disconnect_repaired": f"""WITH {_SPANS} SELECT r.track, r.idx, k.track IS NOT NULL AS off,
round(CASE WHEN k.repaired THEN left_v + (right_v - left_v) * CASE WHEN right_t > left_t THEN (r.t - left_t) / (right_t - left_t) ELSE 0 END ELSE r.value END, 8) AS repaired
FROM r LEFT JOIN k ON k.track = r.track AND r.r BETWEEN k.start AND k."end" """,
}
