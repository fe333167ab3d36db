"""Responses tagged with the driver impulses that made them: an interval join whose intervals differ by row.

An interval meets the impulses of its first and last bucket one by one, and of the buckets between only each one's
strongest and their number, so that a long interval costs as many rows as it has buckets, however many impulses there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import EVENTS_SQL, events

#: Fixed values (seconds): an onset that isn't known before the apex, reach before the onset, reach of the nearest impulse instead.
ONSET_S, BEFORE_S, NEAR_S = 1.5, 0.5, 2.0
BUCKET_S = 4.0
#: What a response without an impulse counts as.
TYPICAL, TYPICAL_SCALE, TYPICAL_BAND = "typical", 1.0, 2


def tagged(peaks: DataFrame, impulses: DataFrame, bucket_s: float = BUCKET_S) -> DataFrame:
    """(track, idx, impulse, n_impulses, label, scale, band) for each peak (track, idx, t, onset).

    Of the impulses (track, idx, t, height, label, scale, band) from half a second before the onset to the apex the
    strongest counts, of equal ones the first; without any, the nearest to the onset within two seconds, of equally near
    ones the first. A null onset is ``ONSET_S`` before the apex.
    """
    start = F.coalesce("onset", F.col("t") - ONSET_S)
    at = peaks.select("track", F.col("idx").alias("peak"), start.alias("start"), (start - BEFORE_S).alias("lo"), F.col("t").alias("hi"))
    at = at.withColumns({"b0": F.floor(F.col("lo") / bucket_s), "b1": F.floor(F.col("hi") / bucket_s)})
    found = F.struct("idx", "label", "scale", "band")
    marks = impulses.select("track", "t", F.floor(F.col("t") / bucket_s).alias("bucket"), "height", F.struct(F.coalesce("height", F.lit(float("-inf"))).alias("h"), (-F.col("t")).alias("t"), (-F.col("idx")).alias("i"), found.alias("x")).alias("best"))
    whole = marks.groupBy("track", "bucket").agg(F.max("best").alias("best"), F.count("*").alias("n"))
    inner = at.where("b1 - b0 > 1").select("track", "peak", F.explode(F.sequence(F.col("b0") + 1, F.col("b1") - 1)).alias("bucket")).join(whole, ["track", "bucket"]).select("track", "peak", "best", "n")
    edges = at.where("lo <= hi").select("track", "peak", "lo", "hi", F.explode(F.array_distinct(F.array("b0", "b1"))).alias("bucket")).join(marks, ["track", "bucket"]).where((F.col("t") >= F.col("lo")) & (F.col("t") <= F.col("hi"))).select("track", "peak", "best", F.lit(1).cast("long").alias("n"))
    within = inner.unionByName(edges).groupBy("track", "peak").agg(F.max("best")["x"].alias("x"), F.sum("n").alias("n"))
    out = at.select("track", "peak", "start").join(within, ["track", "peak"], "left")
    near = out.where("x is null").select("track", "peak", "start", F.explode(F.array(*(F.floor(F.col("start") / NEAR_S) + k for k in (-1, 0, 1)))).alias("bucket"))
    spots = impulses.select("track", "t", F.col("idx").alias("i"), F.floor(F.col("t") / NEAR_S).alias("bucket"), found.alias("y"))
    near = near.join(spots, ["track", "bucket"]).withColumn("d", F.abs(F.col("t") - F.col("start"))).where(F.col("d") <= NEAR_S).groupBy("track", "peak").agg(F.min(F.struct("d", "t", "i", "y"))["y"].alias("y"))
    out = out.join(near, ["track", "peak"], "left").withColumn("x", F.coalesce("x", "y"))
    return out.select("track", F.col("peak").alias("idx"), F.col("x.idx").alias("impulse"), F.coalesce("n", F.when(F.col("x").isNotNull(), 1).otherwise(0).cast("long")).alias("n_impulses"), F.coalesce("x.label", F.lit(TYPICAL)).alias("label"), F.coalesce("x.scale", F.lit(TYPICAL_SCALE)).alias("scale"), F.coalesce("x.band", F.lit(TYPICAL_BAND)).alias("band"))


def speeds(tags: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(track, n, mean_scale, dominant) of tagged responses; of labels as frequent the first of ``labels``."""
    place = F.coalesce(*(F.when(F.col("label") == x, F.lit(i)) for i, x in enumerate(labels)))
    by = tags.groupBy("track", "label").agg(F.count("*").alias("n"), F.sum("scale").alias("s"))
    return by.groupBy("track").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean_scale"), F.max(F.when(place.isNotNull(), F.struct("n", -place, "label")))["label"].alias("dominant"))


LABELS = ("quick", TYPICAL, "slow")


def _events(spark, d) -> DataFrame:
    """Clicks are peaks, an hour a second, with onsets up to two hundred hours before; the other events are impulses."""
    e = events(spark, d).withColumn("t", F.col("t") / 3600)
    peaks = e.where("kind = 'click'").select("track", "idx", "t", F.when(F.col("idx") % 4 != 0, F.col("t") - F.col("idx") % 50 * 4.0).alias("onset"))
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("idx") % 3 + 1).cast("int"))
    return tagged(peaks, e.where("kind != 'click'").select("track", "idx", "t", F.round("value", 0).alias("height"), label.alias("label"), (F.col("idx") % 7 / 4.0).alias("scale"), (F.col("idx") % 5).cast("int").alias("band")))


QUERIES = {
    "response_tagged": _events,
    "response_dominant": lambda s, d: speeds(_events(s, d), LABELS).withColumn("mean_scale", F.round("mean_scale", 6)),
}
_TAGS = f"""{EVENTS_SQL}, h AS (SELECT track, idx, t / 3600 AS t, kind, round(value, 0) AS height, ['quick', 'typical', 'slow'][idx % 3 + 1] AS label, (idx % 7) / 4.0::DOUBLE AS scale, (idx % 5)::INT AS band FROM e),
k AS (SELECT track, idx, t, coalesce(CASE WHEN idx % 4 <> 0 THEN t - idx % 50 * 4.0::DOUBLE END, t - 1.5) AS start FROM h WHERE kind = 'click'), i AS (SELECT * FROM h WHERE kind <> 'click'),
a AS (SELECT k.track, k.idx, count(*) AS n, arg_max(i, (coalesce(i.height, -1e300), -i.t, -i.idx)) AS x FROM k JOIN i ON i.track = k.track AND i.t BETWEEN k.start - 0.5 AND k.t GROUP BY ALL),
b AS (SELECT k.track, k.idx, arg_min(i, (abs(i.t - k.start), i.t, i.idx)) AS y FROM k JOIN i ON i.track = k.track AND abs(i.t - k.start) <= 2 GROUP BY ALL),
g AS (SELECT k.track, k.idx, coalesce(n, CASE WHEN y IS NULL THEN 0 ELSE 1 END) AS n_impulses, coalesce(x, y) AS z FROM k LEFT JOIN a USING (track, idx) LEFT JOIN b USING (track, idx)),
tags AS (SELECT track, idx, z.idx AS impulse, n_impulses, coalesce(z.label, 'typical') AS label, coalesce(z.scale, 1.0) AS scale, coalesce(z.band, 2) AS band FROM g)"""
ORACLE_SQL = {
    "response_tagged": f"WITH {_TAGS} SELECT * FROM tags",
    "response_dominant": f"""WITH {_TAGS}, c AS (SELECT track, label, count(*) AS n, sum(scale) AS s FROM tags GROUP BY ALL)
SELECT track, sum(n)::BIGINT AS n, round(sum(s) / sum(n), 6) AS mean_scale, arg_max(label, (n, -list_position(['quick', 'typical', 'slow'], label))) AS dominant FROM c GROUP BY track""",
}
