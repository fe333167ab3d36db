"""Geodesy as Column expressions (degrees in, metres out)."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Metres of a degree of latitude, and the mean radius of the earth.
DEGREE_M = 111_320.0
RADIUS_M = 6_371_000.0


def lon_degree_m(lat: Column) -> Column:
    return F.lit(DEGREE_M) * F.cos(F.radians(lat))


def lon_difference(lon1: Column, lon2: Column) -> Column:
    """Degrees from the first longitude to the second, the short way round."""
    d = lon2 - lon1
    return d - 360 * F.rint(d / 360)


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular, at the first point's latitude; the short way across 180 degrees."""
    return F.sqrt(F.pow((lat2 - lat1) * DEGREE_M, F.lit(2)) + F.pow(lon_difference(lon1, lon2) * lon_degree_m(lat1), F.lit(2)))


def band_columns(band: Column, metres: float) -> Column:
    """Number of cells around the globe in a band of latitude: each is ``metres`` wide or more wherever in the band."""
    step = metres / DEGREE_M
    edge = F.least(F.lit(90.0), F.greatest(F.abs(band * step), F.abs((band + 1) * step)))
    return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(edge)) / step)).cast("long")


def band_of(lat: Column, metres: float) -> Column:
    return F.floor(lat / (metres / DEGREE_M))


def column_of(lon: Column, band: Column, metres: float) -> Column:
    """The cell of a longitude in a band; unlike a fixed width in degrees, this holds at any latitude and across 180 degrees."""
    n = band_columns(band, metres)
    return F.pmod(F.floor((lon + 180) / 360 * n), n)


def near_cells(lat: Column, lon: Column, metres: float) -> Column:
    """Array of the cells (cy, cx) that hold every point within ``metres``: in each band that band's own columns."""
    cells = []
    for i in (-1, 0, 1):
        band = band_of(lat, metres) + i
        cx = column_of(lon, band, metres)
        cells += [F.struct(band.alias("cy"), F.pmod(cx + j, band_columns(band, metres)).alias("cx")) for j in (-1, 0, 1)]
    return F.array_distinct(F.array(*cells))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * RADIUS_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """Smallest angle between two bearings."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360 - d)


def turn_label(turn: Column) -> Column:
    size = F.abs(turn)
    return F.when(size <= 25, "straight").when(size >= 135, "reverse").when(size >= 40, "turn").otherwise("ambiguous")


def segment_projection(lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    """Struct (lat, lon, share, distance) of the nearest point of a segment; share runs from 0 at a to 1 at b."""
    k = lon_degree_m(lat)
    ax, ay = lon_difference(lon, a_lon) * k, (a_lat - lat) * DEGREE_M
    dx, dy = lon_difference(a_lon, b_lon) * k, (b_lat - a_lat) * DEGREE_M
    size = dx * dx + dy * dy
    s = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / size))).otherwise(0.0)
    off = F.sqrt(F.pow(ax + s * dx, F.lit(2)) + F.pow(ay + s * dy, F.lit(2)))
    return F.struct((a_lat + s * (b_lat - a_lat)).alias("lat"), (a_lon + s * lon_difference(a_lon, b_lon)).alias("lon"), s.alias("share"), off.alias("distance"))


def segment_distance(lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    """Distance to a segment, in a plane at the point's latitude; a segment without length is a point."""
    return segment_projection(lat, lon, a_lat, a_lon, b_lat, b_lon)["distance"]


def in_polygon(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule for a closed ring of (lat, lon)."""
    inside = F.lit(False)
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 == y2:
            continue
        crosses = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1)
        inside = inside != crosses
    return inside


def tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Web Mercator tile numbers."""
    n = float(1 << zoom)
    y = (1 - F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / F.pi()) / 2 * n
    return F.floor((lon + 180) / 360 * n), F.floor(y)


def cell(lat: Column, lon: Column, degrees: float) -> tuple[Column, Column]:
    return F.floor(lat / degrees), F.floor(lon / degrees)


#: Fixed value: half the circumference of the Mercator square, in metres.
MERCATOR_M = 20_037_508.342789244


def tile_pixel(lat: Column, lon: Column, zoom: int, size: int = 256) -> Column:
    """Struct (x, y, px, py): the tile and the pixel within it."""
    n = float(1 << zoom)
    x = (lon + 180) / 360 * n
    y = (1 - F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / F.pi()) / 2 * n
    within = lambda v: F.floor((v - F.floor(v)) * size)
    return F.struct(F.floor(x).alias("x"), F.floor(y).alias("y"), within(x).alias("px"), within(y).alias("py"))


def tile_box(x: Column, y: Column, zoom: int) -> Column:
    """Struct (west, south, east, north) of a tile in Mercator metres."""
    side = 2 * MERCATOR_M / (1 << zoom)
    return F.struct((x * side - MERCATOR_M).alias("west"), (MERCATOR_M - (y + 1) * side).alias("south"), ((x + 1) * side - MERCATOR_M).alias("east"), (MERCATOR_M - y * side).alias("north"))


def metres_per_pixel(lat: Column, zoom: int, size: int = 256) -> Column:
    return 2 * MERCATOR_M * F.cos(F.radians(lat)) / (size * float(1 << zoom))


def metres_to_pixels(metres: Column, lat: Column, zoom: int) -> Column:
    return metres / metres_per_pixel(lat, zoom)


def node_key(lat: Column, lon: Column) -> Column:
    """Nodes with the same six decimals are one."""
    return F.format_string("%.6f,%.6f", lat, lon)


def snap_alpha(distance_: Column, radius: float) -> Column:
    """1 on the road, 0 at the radius, a cosine between."""
    return F.when(distance_ >= radius, 0.0).otherwise(0.5 * (1 + F.cos(F.pi() * distance_ / radius)))


BOX = ("south", "north", "west", "east")


def box(df, margin: float = 0.0, by: list[str] | None = None):
    """(south, north, west, east) of positions (lat, lon), widened by a share of its sides."""
    made = df.groupBy(*(by or [])).agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
    pad_y, pad_x = (F.col("north") - F.col("south")) * margin, (F.col("east") - F.col("west")) * margin
    return made.select(*(by or []), (F.col("south") - pad_y).alias("south"), (F.col("north") + pad_y).alias("north"), (F.col("west") - pad_x).alias("west"), (F.col("east") + pad_x).alias("east"))


def union_box(df, by: list[str] | None = None):
    """The box around all boxes."""
    return df.groupBy(*(by or [])).agg(F.min("south").alias("south"), F.max("north").alias("north"), F.min("west").alias("west"), F.max("east").alias("east"))


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["south"] <= b["north"]) & (a["north"] >= b["south"]) & (a["west"] <= b["east"]) & (a["east"] >= b["west"])


def box_holds(outer: Column, inner: Column, slack: float = 0.0005) -> Column:
    return (outer["south"] - slack <= inner["south"]) & (outer["north"] + slack >= inner["north"]) & (outer["west"] - slack <= inner["west"]) & (outer["east"] + slack >= inner["east"])


def widened(b: Column, metres: float) -> Column:
    """A box (struct) with a margin in metres, at its middle latitude."""
    y, x = F.lit(metres / DEGREE_M), metres / lon_degree_m((b["south"] + b["north"]) / 2)
    return F.struct((b["south"] - y).alias("south"), (b["north"] + y).alias("north"), (b["west"] - x).alias("west"), (b["east"] + x).alias("east"))


def box_km2(b: Column) -> Column:
    """Area of a box, at its middle latitude."""
    high, wide = (b["north"] - b["south"]) * (DEGREE_M / 1000), (b["east"] - b["west"]) * lon_degree_m((b["south"] + b["north"]) / 2) / 1000
    return F.greatest(F.lit(0.0), high * wide)


def ring_area(ring: Column) -> Column:
    """Area in square degrees of a ring (array of struct lat, lon), closed or not."""
    n = F.size(ring)
    cross = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + ring[i]["lon"] * ring[(i + 1) % n]["lat"] - ring[(i + 1) % n]["lon"] * ring[i]["lat"])
    return F.when(n < 3, 0.0).otherwise(F.abs(cross) / 2)


def centroid(points: Column) -> Column:
    """Mean of an array of struct (lat, lon)."""
    n = F.size(points)
    mean = lambda c: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[c]) / n
    return F.when(n > 0, F.struct(mean("lat").alias("lat"), mean("lon").alias("lon")))


def smoothed_corners(points: Column, closed: bool = False) -> Column:
    """One pass of corner cutting: each side gives the points at its quarters; an open path keeps its ends."""
    n = F.size(points)
    ends = F.arrays_zip(F.slice(points, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(points, 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    mix = lambda a, b, w: F.struct((a["lat"] * (1 - w) + b["lat"] * w).alias("lat"), (a["lon"] * (1 - w) + b["lon"] * w).alias("lon"))
    sides = F.flatten(F.transform(ends, lambda s: F.array(mix(s["a"], s["b"], 0.25), mix(s["a"], s["b"], 0.75))))
    out = F.concat(sides, F.slice(sides, 1, 1)) if closed else F.concat(F.slice(points, 1, 1), sides, F.slice(points, -1, 1))
    return F.when(n < 3, points).otherwise(out)


def ring_summary(points, order: tuple[str, ...]):
    """(track, area, lat, lon, n, sum_lat): square degrees of each track's positions as a ring, their mean, and size and sum of latitudes of the path after a pass of corner cutting.

    Each position meets the one after it, so a ring of any length is never one value.
    """
    w = Window.partitionBy("track").orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = [F.lead(c).over(w) for c in ("lat", "lon")]
    side = points.select("track", "lat", "lon", after[0].alias("_lat"), *(F.coalesce(a, F.first(c).over(whole)).alias(f"_{c}2") for a, c in zip(after, ("lat", "lon"), strict=True)), F.lag("lat").over(w).alias("_before"))
    n = F.count("*")
    ends = F.sum(F.when(F.col("_lat").isNull() | F.col("_before").isNull(), F.col("lat")).otherwise(0.0))
    cut = ends + F.coalesce(F.sum(F.col("lat") + F.col("_lat")), F.lit(0.0))  # a side gives its quarters: together its ends
    return side.groupBy("track").agg(
        F.when(n < 3, 0.0).otherwise(F.abs(F.sum(F.col("lon") * F.col("_lat2") - F.col("_lon2") * F.col("lat"))) / 2).alias("area"),
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.when(n < 3, n).otherwise(2 * n).alias("n"), F.when(n < 3, F.sum("lat")).otherwise(cut).alias("sum_lat"),
    )
