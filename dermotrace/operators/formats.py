"""Queries over the text and geodesy functions: labels, times, distances, tiles, boxes and rings of every row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text
from ..sources.tables import EVENTS_SQL, POSITIONS_SQL, events, positions


def _labels(spark, d):
    e = events(spark, d)
    start = F.when(F.col("idx") % 3 == 0, F.lit(0)).otherwise(F.floor("t") - F.col("idx"))
    since = F.floor(F.col("value") * 97) + 0.25
    raw = F.concat(F.lit("  a\r\n "), F.col("kind"), F.lit('."x" \n'), F.col("idx").cast("string"), F.lit(" "))
    at = F.timestamp_seconds(F.floor("t"))
    return e.select(
        "track", "idx", text.clean_label(raw).alias("label"), text.safe_name(F.concat("kind", F.lit(" & co."), F.col("idx").cast("string"))).alias("name"),
        text.csv_cell(raw).alias("cell"), text.is_relative(start).alias("relative"), text.clock_time(start, since).alias("clock"), text.date_long(start, since).alias("long"),
        text.date_short(start, since).alias("short"), text.duration_compact(since).alias("compact"), text.duration(since - 40).alias("duration"), text.distance(F.col("value") * 31).alias("distance"),
        text.file_stamp(at).alias("stamp"), text.tick_seconds(F.col("idx")).alias("ticks"),
        text.unix_epoch(F.year(at), F.month(at), F.dayofmonth(at), F.hour(at), F.minute(at), F.second(at)).alias("epoch"),
    )


def _tiles(spark, d):
    p = positions(spark, d)
    lat, lon = F.col("lat"), F.col("lon")
    made = p.select("track", "idx", geo.tile_pixel(lat, lon, 14).alias("t"), geo.metres_per_pixel(lat, 14).alias("mpp"), geo.metres_to_pixels(F.lit(50.0), lat, 14).alias("px50"), geo.node_key(lat, lon).alias("node"), geo.snap_alpha(F.col("value") % 40, 25.0).alias("alpha"))
    b = geo.tile_box(F.col("t.x"), F.col("t.y"), 14)
    return made.select("track", "idx", F.col("t.x").alias("x"), F.col("t.y").alias("y"), "t.px", "t.py", F.round(b["west"], 2).alias("west"), F.round(b["north"], 2).alias("north"), F.round("mpp", 6).alias("mpp"), F.round("px50", 6).alias("px50"), "node", F.round("alpha", 6).alias("alpha"))


def _boxes(spark, d):
    """The box of each track, against the box of all tracks."""
    b = geo.box(positions(spark, d), 0.1, ["track"]).select("track", F.struct(*geo.BOX).alias("b"))
    whole = geo.union_box(b.select("b.*")).select(F.struct(*geo.BOX).alias("w"))
    both = b.crossJoin(F.broadcast(whole))  # one row
    wide = geo.widened(F.col("b"), 100.0)
    return both.select(
        "track", F.round(geo.box_km2(F.col("b")), 6).alias("km2"), F.round(geo.box_km2(wide), 6).alias("wide_km2"), geo.box_holds(F.col("w"), F.col("b")).alias("held"),
        geo.box_holds(F.col("b"), F.col("w")).alias("holds"), geo.boxes_meet(F.col("b"), F.col("w")).alias("meet"), F.round("b.south", 8).alias("south"), F.round("b.east", 8).alias("east"),
    )


def _rings(spark, d):
    """All positions of each track as a ring: area, centroid, and the path after a pass of corner cutting."""
    return geo.ring_summary(positions(spark, d), ("t", "idx")).select("track", F.round(F.col("area") * 1e6, 8).alias("area"), *(F.round(c, 8).alias(c) for c in ("lat", "lon")), F.col("n").cast("int").alias("n"), F.round("sum_lat", 8).alias("sum_lat"))


QUERIES = {"format_labels": _labels, "geo_tiles": _tiles, "geo_boxes": _boxes, "geo_rings": _rings}

ORACLE_SQL = {
    "format_labels": f"""WITH {EVENTS_SQL},
r AS (SELECT *, CASE WHEN idx % 3 = 0 THEN 0 ELSE floor(t)::bigint - idx END AS s, floor(value * 97) + 0.25 AS n, '  a' || chr(13) || chr(10) || ' ' || kind || '."x" ' || chr(10) || idx || ' ' AS raw FROM e),
c AS (SELECT *, floor(n + 0.5)::bigint AS q, to_timestamp(floor(s + n)::bigint) AT TIME ZONE 'UTC' AS moment, to_timestamp(floor(t)::bigint) AT TIME ZONE 'UTC' AS ev, greatest(0, floor(n))::bigint AS w, CASE WHEN n - 40 >= 0 THEN floor(n - 39.5)::bigint ELSE 0 END AS du FROM r),
k AS (SELECT *, CASE WHEN s < 86400 THEN CASE WHEN q >= 3600 THEN (q // 3600) || ':' || lpad((q % 3600 // 60)::varchar, 2, '0') ELSE (q // 60)::varchar END || ':' || lpad((q % 60)::varchar, 2, '0') ELSE strftime(moment, '%H:%M:%S') END AS clock FROM c)
SELECT track, idx, 'a ' || kind || '."x" ' || idx AS label, regexp_replace(kind, '[^a-zA-Z0-9._-]', '_', 'g') || '___co' AS name,
  '"' || replace(raw, '"', '""') || '"' AS cell, s < 86400 AS relative, clock,
  CASE WHEN s < 86400 THEN clock ELSE day(moment) || CASE WHEN day(moment) BETWEEN 11 AND 13 THEN 'th' WHEN day(moment) % 10 = 1 THEN 'st' WHEN day(moment) % 10 = 2 THEN 'nd' WHEN day(moment) % 10 = 3 THEN 'rd' ELSE 'th' END || strftime(moment, ' %b %Y') END AS long,
  CASE WHEN s < 86400 THEN clock ELSE strftime(moment, '%d.%m.%Y') END AS short,
  CASE WHEN w >= 3600 THEN (w // 3600) || 'h ' || lpad((w % 3600 // 60)::varchar, 2, '0') || 'm' WHEN w >= 60 THEN (w // 60) || 'm ' || lpad((w % 60)::varchar, 2, '0') || 's' ELSE w || 's' END AS compact,
  CASE WHEN du >= 3600 THEN (du // 3600) || 'h ' || (du % 3600 // 60) || 'm' WHEN du >= 60 THEN (du // 60) || 'm ' || (du % 60) || 's' ELSE du || 's' END AS duration,
  CASE WHEN value * 31 <= 0 OR value IS NULL THEN '0 m' WHEN value * 31 >= 1000 THEN printf('%.1f km', value * 31 / 1000) ELSE floor(value * 31 + 0.5)::bigint || ' m' END AS distance,
  strftime(ev, '%Y-%m-%d_%H-%M-%S') AS stamp, idx / 10 AS ticks, floor(t)::bigint AS epoch
FROM k""",
    "geo_tiles": f"""WITH {POSITIONS_SQL}, w AS (SELECT *, (lon + 180) / 360 * 16384 AS x, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384 AS y, value % 40 AS off FROM p)
SELECT track, idx, floor(x)::bigint AS x, floor(y)::bigint AS y, floor((x - floor(x)) * 256)::bigint AS px, floor((y - floor(y)) * 256)::bigint AS py,
  round(floor(x) * (40075016.685578488::double / 16384) - 20037508.342789244::double, 2) AS west, round(20037508.342789244::double - floor(y) * (40075016.685578488::double / 16384), 2) AS north,
  round(40075016.685578488::double * cos(radians(lat)) / (256 * 16384), 6) AS mpp, round(50 / (40075016.685578488::double * cos(radians(lat)) / (256 * 16384)), 6) AS px50,
  printf('%.6f,%.6f', lat, lon) AS node, round(CASE WHEN off >= 25 THEN 0 ELSE 0.5 * (1 + cos(pi() * off / 25)) END, 6) AS alpha FROM w""",
    "geo_boxes": f"""WITH {POSITIONS_SQL}, m AS (SELECT track, min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM p GROUP BY track),
x AS (SELECT track, a - (b - a) * 0.1::double AS s, b + (b - a) * 0.1::double AS n, c - (d - c) * 0.1::double AS w, d + (d - c) * 0.1::double AS e FROM m),
u AS (SELECT min(s) AS us, max(n) AS un, min(w) AS uw, max(e) AS ue FROM x)
SELECT track, round((n - s) * 111.32::double * (e - w) * 111.32::double * cos(radians((s + n) / 2)), 6) AS km2,
  round((n - s + 200 / 111320.0::double) * 111.32::double * (e - w + 200 / (111320.0::double * cos(radians((s + n) / 2)))) * 111.32::double * cos(radians((s + n) / 2)), 6) AS wide_km2,
  us - 0.0005::double <= s AND un + 0.0005::double >= n AND uw - 0.0005::double <= w AND ue + 0.0005::double >= e AS held,
  s - 0.0005::double <= us AND n + 0.0005::double >= un AND w - 0.0005::double <= uw AND e + 0.0005::double >= ue AS holds,
  s <= un AND n >= us AND w <= ue AND e >= uw AS meet, round(s, 8) AS south, round(e, 8) AS east FROM x, u""",
    "geo_rings": f"""WITH {POSITIONS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t, idx) AS r FROM p),
n AS (SELECT *, count(*) OVER (PARTITION BY track) AS n, coalesce(lead(lat) OVER w, first_value(lat) OVER (PARTITION BY track ORDER BY r)) AS lat2, coalesce(lead(lon) OVER w, first_value(lon) OVER (PARTITION BY track ORDER BY r)) AS lon2,
  lead(lat) OVER w AS nl, lag(lat) OVER w AS pl FROM f WINDOW w AS (PARTITION BY track ORDER BY r))
SELECT track, round(CASE WHEN max(n) < 3 THEN 0 ELSE abs(sum(lon * lat2 - lon2 * lat)) / 2 END * 1e6, 8) AS area, round(avg(lat), 8) AS lat, round(avg(lon), 8) AS lon,
  (CASE WHEN max(n) < 3 THEN max(n) ELSE 2 * max(n) END)::int AS n,
  round(CASE WHEN max(n) < 3 THEN sum(lat) ELSE sum(CASE WHEN nl IS NULL OR pl IS NULL THEN lat ELSE 0 END) + coalesce(sum(lat + nl), 0) END, 8) AS sum_lat FROM n GROUP BY track""",
}
