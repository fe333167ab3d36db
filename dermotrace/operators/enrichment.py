"""Environment of positions: map features by class, areas, raster samples, turns, exposure summaries."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.lineage import cut
from ..sources.tables import POSITIONS_SQL, positions
from .windows import by_time

#: Tags that make a feature green, water or canopy; road classes for vehicles and major ones.
GREEN = {"leisure": ("park", "garden", "nature_reserve"), "landuse": ("grass", "forest", "meadow", "recreation_ground", "village_green", "orchard"), "natural": ("wood", "scrub", "grassland", "heath", "wetland")}
WATER = {"natural": ("water", "wetland"), "waterway": ("river", "canal", "stream", "drain", "ditch"), "landuse": ("basin", "reservoir")}
CANOPY = {"natural": ("wood",), "landuse": ("forest",)}
VEHICLES = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "service", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link")
MAJOR = ("motorway", "trunk", "primary", "secondary")
#: Highway tags that are no road, and amenities that count.
NO_ROAD = ("bus_stop", "platform", "street_lamp", "traffic_signals", "crossing", "stop", "give_way", "milestone", "speed_camera", "passing_place", "turning_circle", "turning_loop", "mini_roundabout", "motorway_junction", "elevator", "emergency_bay", "rest_area", "services", "proposed", "construction", "planned", "razed", "dismantled", "abandoned")
AMENITIES = ("cafe", "restaurant", "pub", "fast_food", "bar", "school", "university", "hospital", "clinic", "library", "place_of_worship", "parking", "fuel")
#: Metres of a lane, reach of a tree's crown, search radius, reach of distances, nearness that makes a vehicle road the walker's own; "nothing near".
LANE_M, CROWN_M, RADIUS_M, CAP_M, OWN_ROAD_M, NOTHING = 3.25, 10.0, 50.0, 150.0, 25.0, 999.0


def tagged(tags: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """Whether any tag (map column) has one of its values."""
    found = F.lit(False)
    for key, values in rules.items():
        found = found | F.coalesce(F.element_at(tags, key).isin(*values), F.lit(False))
    return found


def feature_class(tags: Column) -> Column:
    road = F.element_at(tags, "highway")
    tree = F.coalesce(F.element_at(tags, "natural").isin("tree", "tree_row"), F.lit(False))
    return F.when(tagged(tags, CANOPY) | tree, "canopy").when(tagged(tags, GREEN), "green").when(tagged(tags, WATER), "water").when(road.isin(*VEHICLES), "road").when(road.isNotNull(), "path").otherwise("other")


def around(points: DataFrame, features: DataFrame, metres: float) -> DataFrame:
    """(track, idx, class, n, nearest): features of each class within reach, by cells of that size."""
    band = geo.band_of(F.col("lat"), metres)
    pts = points.select("track", "idx", "lat", "lon", band.alias("cy"), geo.column_of(F.col("lon"), band, metres).alias("cx"))
    near = geo.near_cells(F.col("f_lat"), F.col("f_lon"), metres)
    fts = features.select("class", F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon")).select("class", "f_lat", "f_lon", F.explode(near).alias("c")).select("class", "f_lat", "f_lon", "c.cy", "c.cx")
    d = geo.distance(F.col("lat"), F.col("lon"), F.col("f_lat"), F.col("f_lon"))
    return pts.join(fts, ["cy", "cx"]).withColumn("d", d).where(F.col("d") <= metres).groupBy("track", "idx", "class").agg(F.count("*").alias("n"), F.min("d").alias("nearest"))


def inside(points: DataFrame, areas: DataFrame, degrees: float = 0.002) -> DataFrame:
    """(track, idx, area) of points in polygons (``area``, ``ring``: closed array of struct lat, lon): cells of the box, then even-odd."""
    low = lambda c: F.array_min(F.transform("ring", lambda p: p[c]))
    high = lambda c: F.array_max(F.transform("ring", lambda p: p[c]))
    cells = lambda c: F.explode(F.sequence(F.floor(low(c) / degrees), F.floor(high(c) / degrees)))
    dealt = areas.select("area", "ring", cells("lat").alias("cy")).select("area", "ring", "cy", cells("lon").alias("cx"))
    pts = points.select("track", "idx", "lat", "lon", F.floor(F.col("lat") / degrees).alias("cy"), F.floor(F.col("lon") / degrees).alias("cx"))
    edge = F.expr("""aggregate(sequence(1, size(ring) - 1), 0, (n, i) -> n + if(
        (ring[i - 1].lat > lat) != (ring[i].lat > lat) and lon < (ring[i].lon - ring[i - 1].lon) * (lat - ring[i - 1].lat) / (ring[i].lat - ring[i - 1].lat) + ring[i - 1].lon, 1, 0)) % 2 = 1""")
    return pts.join(dealt, ["cy", "cx"]).where(edge).select("track", "idx", "area")


def sampled(points: DataFrame, raster: DataFrame, degrees: float, reach: int = 1) -> DataFrame:
    """(track, idx, at, mean): the raster's value (cy, cx, v) in the point's cell and the mean of the cells around it."""
    cy, cx = geo.cell(F.col("lat"), F.col("lon"), degrees)
    around_ = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1))))
    pts = points.select("track", "idx", cy.alias("y"), cx.alias("x"), around_.alias("o")).select("track", "idx", (F.col("y") + F.col("o.i")).alias("cy"), (F.col("x") + F.col("o.j")).alias("cx"), ((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("own"))
    return pts.join(raster, ["cy", "cx"]).groupBy("track", "idx").agg(F.max(F.when(F.col("own"), F.col("v"))).alias("at"), F.avg("v").alias("mean"))


def turns(points: DataFrame) -> DataFrame:
    """(track, idx, turn, label): change of bearing at each row, from the one before to the next."""
    w = by_time()
    before = geo.bearing(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    after = geo.bearing(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w))
    turn = F.pmod(after - before + 540, F.lit(360.0)) - 180
    return points.select("track", "idx", turn.alias("turn"), geo.turn_label(turn).alias("label"))


def exposure(rows: DataFrame, key: str, value: str, least: int = 5) -> DataFrame:
    """(key, n, tracks, mean, sigma, low, high): 95 % interval from the larger of the errors within rows and between tracks."""
    of_track = rows.groupBy(key, "track").agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    g = of_track.groupBy(key).agg(F.sum("n").alias("n"), F.count("*").alias("tracks"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.stddev_samp("m").alias("between"))
    mean = F.col("s") / F.col("n")
    sigma = F.sqrt(F.greatest(F.lit(0.0), (F.col("ss") - F.col("s") * mean) / (F.col("n") - 1)))
    error = F.greatest(sigma / F.sqrt("n"), F.coalesce(F.col("between") / F.sqrt("tracks"), F.lit(0.0)))
    return g.where(F.col("n") >= least).select(key, "n", "tracks", mean.alias("mean"), sigma.alias("sigma"), (mean - 1.96 * error).alias("low"), (mean + 1.96 * error).alias("high"))


def forward_filled(df: DataFrame, value: str, positioned: Column | None = None) -> DataFrame:
    """The last value carried on; a positioned row without a value ends it."""
    w = by_time()
    stop = F.lit(False) if positioned is None else F.coalesce(positioned, F.lit(False)) & F.col(value).isNull()
    part = F.sum(F.when(stop, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    held = df.withColumn("_part", part)
    over = Window.partitionBy("track", "_part").orderBy("t", "idx").rowsBetween(Window.unboundedPreceding, 0)
    return held.withColumn(value, F.last(value, True).over(over)).drop("_part")


def half_width(tags: Column) -> Column:
    """Metres from a road's middle to its kerb: from its width, else from its lanes, one of which a narrow one-way road has."""
    tag = lambda k: F.element_at(tags, k)
    first = lambda c, pattern, kind: F.when(c.rlike("^" + pattern), F.regexp_extract(c, "^" + pattern, 1).cast(kind))
    width, lanes = first(tag("width"), r"\s*(\d+\.?\d*)", "double"), first(tag("lanes"), r"\s*(\d+)", "int")
    one_way = F.coalesce(tag("oneway").isin("yes", "1"), F.lit(False)) | F.coalesce(tag("junction") == "roundabout", F.lit(False))
    guessed = F.when(one_way & ~F.coalesce(tag("highway").rlike("^(motorway|trunk)"), F.lit(False)), 1).otherwise(2)
    return F.when(width > 0, width / 2).otherwise(F.when(lanes > 0, lanes).otherwise(guessed) * LANE_M / 2)


def way_paths(elements: DataFrame) -> DataFrame:
    """(id, tags, nodes, path array<struct<lat,lon>>) of ways: their known nodes in order, by an equi-join."""
    nodes = elements.where("type = 'node'").select(F.col("id").alias("node"), "lat", "lon")
    at = elements.where("type = 'way'").select("id", "tags", "nodes", F.posexplode("nodes").alias("pos", "node"))
    path = F.array_sort(F.collect_list(F.struct("pos", "lat", "lon")))
    got = at.join(nodes, "node").groupBy("id").agg(path.alias("p")).select("id", F.transform("p", lambda q: F.struct(q["lat"].alias("lat"), q["lon"].alias("lon"))).alias("path"))
    return elements.where("type = 'way'").select("id", "tags", "nodes").join(got, "id")


def assembled(ways: list[tuple[list, list]]) -> list[tuple[list, list]]:
    """Rings of (nodes, points): open ways are joined end to end, in either direction, until they close or nothing fits."""
    done = [w for w in ways if len(w[0]) < 2 or w[0][0] == w[0][-1] or len(w[0]) != len(w[1])]
    left = [w for w in ways if w not in done]
    while left:
        nodes, points = left.pop(0)
        for _ in (0, 1):
            while nodes[0] != nodes[-1]:
                fit = next((w for w in left if nodes[-1] in (w[0][0], w[0][-1])), None)
                if fit is None:
                    break
                left.remove(fit)
                n, p = fit if fit[0][0] == nodes[-1] else (fit[0][::-1], fit[1][::-1])
                nodes, points = nodes + n[1:], points + p[1:]
            if nodes[0] == nodes[-1]:
                break
            nodes, points = nodes[::-1], points[::-1]
        done.append((nodes, points))
    return done


_RINGS = "id long, tags map<string,string>, inner boolean, nodes array<long>, path array<struct<lat:double,lon:double>>"


def relation_rings(elements: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, tags, inner, nodes, path) of relations: their member ways put together, one Arrow group a relation and side."""
    members = elements.where("type = 'relation'").select("id", "tags", F.explode("members").alias("m")).where("m.type = 'way'")
    met = members.select("id", "tags", (F.col("m.role") == "inner").alias("inner"), F.col("m.ref").alias("way")).join(paths.select(F.col("id").alias("way"), "nodes", "path"), "way")

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("way").to_pylist()
        rings = assembled([(r["nodes"], r["path"]) for r in rows])
        same = {c: [rows[0][c]] * len(rings) for c in ("id", "tags", "inner")}
        kinds = table.schema
        return pa.table({**{c: pa.array(v, kinds.field(c).type) for c, v in same.items()}, "nodes": pa.array([r[0] for r in rings], pa.list_(pa.int64())), "path": pa.array([r[1] for r in rings], pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())])))})

    return met.groupBy("id", "inner").applyInArrow(run, _RINGS)


def _pieces(elements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, points, rings): line segments and nodes of features with tags, and closed rings of areas."""
    paths = way_paths(elements)
    rings = relation_rings(elements, paths)
    ways = paths.where("tags is not null").select(F.concat(F.lit("w"), "id").alias("feature"), F.lit(False).alias("inner"), "tags", "nodes", "path")
    lines = ways.unionByName(rings.where("tags is not null").select(F.concat(F.lit("r"), "id").alias("feature"), "inner", "tags", "nodes", "path"))
    points = elements.where("type = 'node' and tags is not null").select(F.concat(F.lit("n"), "id").alias("feature"), "tags", "lat", "lon")
    closed = (F.element_at("nodes", 1) == F.element_at("nodes", -1)) & (F.size("path") > 2)
    return lines, points, lines.where(closed)


def _line_distances(points: DataFrame, lines: DataFrame, reach: float) -> DataFrame:
    """(points' columns, feature, tags, inner, d): the nearest of a feature's segments within reach of each point."""
    from .spatial import candidates

    seg = lines.withColumn("way", F.xxhash64("feature", "inner", "nodes")).select("way", "feature", "tags", "inner", F.posexplode("path").alias("seg", "a"), "path")
    b = F.try_element_at("path", F.col("seg") + 2)
    seg = seg.select("way", "seg", "feature", "tags", "inner", F.col("a.lat").alias("a_lat"), F.col("a.lon").alias("a_lon"), b.lat.alias("b_lat"), b.lon.alias("b_lon")).where("b_lat is not null")
    near = candidates(points, seg, reach, 1 << 30).drop("rank")
    keys = ["track", "t", "idx", "lat", "lon", "feature"]
    return near.groupBy(*keys).agg(F.min("d").alias("d"), F.first("tags").alias("tags"))


def sampling_grid(points: DataFrame, radius: float) -> DataFrame:
    """(track, idx, p, lat, lon, w): 25 places in the disc around each position, a centre and two rings, with their share of its area."""
    shares = [(0.0, 0.0, 0.0625)] + [(r / 2, 2 * math.pi * k / n, (min(1.0, (r + 0.5) / 2) ** 2 - ((r - 0.5) / 2) ** 2) / n) for r, n in ((1, 8), (2, 16)) for k in range(n)]
    places = F.explode(F.array(*(F.struct(F.lit(i).alias("p"), F.lit(f * math.sin(a) * radius).alias("north"), F.lit(f * math.cos(a) * radius).alias("east"), F.lit(w).alias("w")) for i, (f, a, w) in enumerate(shares)))).alias("g")
    at = points.select("track", "t", "idx", "lat", "lon", places)
    return at.select("track", "t", "idx", "g.p", (F.col("lat") + F.col("g.north") / geo.DEGREE_M).alias("lat"), (F.col("lon") + F.col("g.east") / geo.lon_degree_m(F.col("lat"))).alias("lon"), "g.w")


def _covered(points: DataFrame, rings: DataFrame) -> DataFrame:
    """(track, idx, p, feature) of places within an area: in an outer ring of it and in none of its holes."""
    areas = rings.select(F.xxhash64("feature", "inner", "nodes").alias("area"), "feature", "inner", F.col("path").alias("ring"))
    hit = inside(points.withColumn("_idx", F.col("idx")).withColumn("idx", F.struct("idx", "p")), areas.select("area", "ring"))
    of = hit.join(areas.select("area", "feature", "inner"), "area").groupBy("track", F.col("idx.idx").alias("idx"), F.col("idx.p").alias("p"), "feature").agg(F.max(~F.col("inner")).alias("out"), F.max("inner").alias("hole"))
    return of.where("out and not hole").select("track", "idx", "p", "feature")


def metrics(points: DataFrame, elements: DataFrame, radius: float = RADIUS_M, cap: float = CAP_M) -> DataFrame:
    """Ten measures of the surroundings of each position (track, t, idx, lat, lon): nearest road, distances, shares of the disc, counts.

    Features meet positions by cells; lines, points and areas are three joins, each reduced to a row a position before
    they meet again. A distance over the cap is 999. The surroundings are those of a place, so each place is measured once,
    however many rows are there. Places are written first: a plan takes the 25 rows of each for one row of a compressed
    file, and would send them all to the driver as the small side of a join.
    """
    places = cut(points.select("lat", "lon").distinct().select(F.lit(0).cast("long").alias("track"), F.lit(0.0).alias("t"), F.monotonically_increasing_id().alias("idx"), "lat", "lon"))
    of = _measured(places, elements, radius, cap).drop("track", "t").join(places.select("idx", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), "idx").drop("idx")
    met = F.col("lat").eqNullSafe(F.col("_lat")) & F.col("lon").eqNullSafe(F.col("_lon"))
    return points.join(of, met, "left").select("track", "t", "idx", *TIMELINE)


def _measured(points: DataFrame, elements: DataFrame, radius: float, cap: float) -> DataFrame:
    """``metrics`` of ``points`` whose size a plan doesn't guess from a file."""
    lines, nodes, rings = _pieces(elements)
    reach = max(radius, cap)
    d = _line_distances(points, lines, reach)
    road = F.element_at("tags", "highway")
    is_road = road.isNotNull() & ~road.isin(*NO_ROAD) & F.col("feature").startswith("w")
    kerb = F.greatest(F.lit(0.0), F.col("d") - half_width(F.col("tags")))
    building = F.element_at("tags", "building").isNotNull() & (F.col("d") <= radius)
    line_part = d.groupBy("track", "idx").agg(
        F.min(F.when(is_road, F.struct("d", road.alias("c")))).alias("road"), F.min(F.when(is_road & road.isin(*VEHICLES), F.struct("d", road.alias("c")))).alias("vehicle"), F.min(F.when(is_road & road.isin(*MAJOR), kerb)).alias("major"),
        F.count_if(building).alias("building_density"), F.min(F.when(tagged(F.col("tags"), WATER), F.col("d"))).alias("water"), F.min(F.when(tagged(F.col("tags"), GREEN), F.col("d"))).alias("green"),
    )
    amenity = lambda t: F.element_at(t, "shop").isNotNull() | F.coalesce(F.element_at(t, "amenity").isin(*AMENITIES), F.lit(False)) | F.coalesce(F.element_at(t, "highway") == "bus_stop", F.lit(False))
    centre = geo.centroid(F.col("path"))
    shops = lines.where(amenity(F.col("tags")) & F.col("feature").startswith("w")).select("feature", "tags", centre.alias("c")).select("feature", "tags", "c.lat", "c.lon")
    spots = nodes.unionByName(shops)
    band = geo.band_of(F.col("lat"), reach)
    cells = points.select("track", "idx", "lat", "lon", band.alias("cy"), geo.column_of(F.col("lon"), band, reach).alias("cx"))
    dealt = spots.select("feature", "tags", F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon")).withColumn("c", F.explode(geo.near_cells(F.col("f_lat"), F.col("f_lon"), reach))).select("feature", "tags", "f_lat", "f_lon", "c.cy", "c.cx")
    near = cells.join(dealt, ["cy", "cx"]).withColumn("d", geo.haversine(F.col("lat"), F.col("lon"), F.col("f_lat"), F.col("f_lon"))).where(F.col("d") <= radius)
    tree = F.coalesce(F.element_at("tags", "natural") == "tree", F.lit(False)) & F.col("feature").startswith("n")
    point_part = near.groupBy("track", "idx").agg(F.count_if(tree).alias("tree_density"), F.count_if(amenity(F.col("tags"))).alias("amenity_count"))
    grid = sampling_grid(points, radius)
    green = _covered(grid, rings.where(tagged(F.col("tags"), GREEN))).select("track", "idx", "p").distinct().withColumn("green_", F.lit(True))
    leafy = _covered(grid, rings.where(tagged(F.col("tags"), CANOPY))).select("track", "idx", "p")
    placed = grid.select("track", "t", F.struct("idx", "p").alias("idx"), "lat", "lon")
    rows = lines.where("tags['natural'] = 'tree_row'")
    under = _line_distances(placed, rows, CROWN_M).select("track", "idx.idx", "idx.p")
    crown_band = geo.band_of(F.col("lat"), CROWN_M)
    crowns = nodes.where("tags['natural'] = 'tree'").select(F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon")).withColumn("c", F.explode(geo.near_cells(F.col("f_lat"), F.col("f_lon"), CROWN_M))).select("f_lat", "f_lon", "c.cy", "c.cx")
    by_tree = grid.select("track", "idx", "p", "lat", "lon", crown_band.alias("cy"), geo.column_of(F.col("lon"), crown_band, CROWN_M).alias("cx")).join(crowns, ["cy", "cx"]).where(geo.haversine(F.col("lat"), F.col("lon"), F.col("f_lat"), F.col("f_lon")) <= CROWN_M).select("track", "idx", "p")
    shade = leafy.unionByName(under).unionByName(by_tree).distinct().withColumn("shade_", F.lit(True))
    share = lambda c: F.sum(F.when(F.col(c), F.col("w")).otherwise(0.0)) * 100
    area_part = grid.join(green, ["track", "idx", "p"], "left").join(shade, ["track", "idx", "p"], "left").groupBy("track", "idx").agg(share("green_").alias("green_pct"), share("shade_").alias("canopy_pct"), F.max(F.when(F.col("p") == 0, F.coalesce("green_", F.lit(False)))).alias("in_park"))
    out = points.select("track", "t", "idx").join(area_part, ["track", "idx"]).join(line_part, ["track", "idx"], "left").join(point_part, ["track", "idx"], "left")
    own = F.col("vehicle.d") <= min(radius, OWN_ROAD_M)
    far = lambda c: F.when(c <= cap, c).otherwise(NOTHING)
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(
        "track", "t", "idx", F.when(own, F.col("vehicle.c")).otherwise(F.coalesce("road.c", F.lit("none"))).alias("road_class"), far(F.col("major")).alias("dist_major"), F.col("in_park").cast("int").alias("in_park"), "green_pct",
        far(F.when(F.col("in_park"), 0.0).otherwise(F.col("green"))).alias("dist_green"), "canopy_pct", none("building_density"), far(F.col("water")).alias("dist_water"), none("tree_density"), none("amenity_count"),
    )


#: How each measure goes from a position to the next: on the line, by the nearer one, or on the line unless one says "nothing near".
TIMELINE = {"road_class": "step", "dist_major": "distance", "in_park": "step", "green_pct": "line", "dist_green": "distance", "canopy_pct": "line", "building_density": "step", "dist_water": "distance", "tree_density": "step", "amenity_count": "step"}


def projected(rows: DataFrame, measured: DataFrame) -> DataFrame:
    """``rows`` (track, t, idx, lat, lon) with the measures of the positions around each, by row; null outside the track's positioned rows."""
    w, back = by_time().rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("track").orderBy(F.desc("t"), F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    m = measured.select("track", "idx", F.struct(*TIMELINE).alias("_m"))
    r = rows.withColumn("_r", F.row_number().over(by_time())).join(m, ["track", "idx"], "left")
    at = F.when(F.col("_m").isNotNull(), F.struct(F.col("_r").alias("r"), F.col("_m").alias("m")))
    here = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    r = r.withColumn("_at", at).withColumns({"_a": F.last("_at", True).over(w), "_b": F.last("_at", True).over(back), "_first": F.min(F.when(here, F.col("_r"))).over(Window.partitionBy("track")), "_last": F.max(F.when(here, F.col("_r"))).over(Window.partitionBy("track"))})
    p, n = F.coalesce("_a", "_b"), F.coalesce("_b", "_a")
    share = F.coalesce(F.try_divide(F.col("_r") - p["r"], n["r"] - p["r"]), F.lit(0.0))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))

    def made(c: str, kind: str) -> Column:
        a, b = p["m"][c], n["m"][c]
        step, line = F.when(share >= 0.5, b).otherwise(a), a + (b - a) * share
        value = step if kind == "step" else line if kind == "line" else F.when((a == NOTHING) | (b == NOTHING), step).otherwise(line)
        return F.when(F.col("_r").between(F.col("_first"), F.col("_last")), value).alias(c)

    return r.select(*rows.columns, *(made(c, k) for c, k in TIMELINE.items()))


def street_elements(spark) -> DataFrame:
    """A small map around the derived coordinates, for the registered queries: streets, houses, a park with a pond in a hole, trees, shops."""
    schema = "type string, id long, lat double, lon double, nodes array<long>, tags map<string,string>, members array<struct<type:string,ref:long,role:string>>"
    rows, ways = [], []
    node = lambda y, x, tags=None: rows.append(("node", len(rows) + 1, 51.5 + y, -0.1 + x, None, tags, None)) or len(rows)
    kinds = ("primary", "residential", "footway", "secondary", "service", "cycleway")
    for k in range(6):
        ways.append(([node(0.002 * k, 0.002 * j) for j in range(6)], {"highway": kinds[k], "lanes": "2"} if k % 2 else {"highway": kinds[k], "oneway": "yes"}))
        ways.append(([node(0.002 * j, 0.002 * k) for j in range(6)], {"highway": kinds[-k]}))
    for k in range(40):
        y, x = 0.0002 + 0.00024 * k, 0.0003 + 0.0009 * (k % 11)
        ring = [node(y, x), node(y, x + 0.00015), node(y + 0.0001, x + 0.00015), node(y + 0.0001, x)]
        ways.append(([*ring, ring[0]], {"building": "yes"} | ({"shop": "yes"} if k % 4 == 0 else {})))
        node(y + 0.0003, x, {"natural": "tree"})
        node(y, x + 0.0004, {"amenity": "cafe"} if k % 3 else {"highway": "bus_stop"})
    box = lambda y, x, s: [node(y, x), node(y, x + s), node(y + s, x + s), node(y + s, x)]
    out, hole, wood = box(0.0042, 0.0042, 0.003), box(0.005, 0.005, 0.001), box(0.0012, 0.0072, 0.0012)
    ways += [(out[:3], None), ([out[2], out[3], out[0]], None), ([*hole, hole[0]], {"natural": "water"}), ([*wood, wood[0]], {"natural": "wood"}), ([node(0.0085, 0.001), node(0.0085, 0.009)], {"natural": "tree_row"}), ([node(0.001, 0.0005), node(0.009, 0.0006)], {"waterway": "stream"})]
    n = len(ways)
    rows += [("way", 10_000 + i, None, None, nodes, tags, None) for i, (nodes, tags) in enumerate(ways)]
    rows.append(("relation", 20_000, None, None, None, {"leisure": "park"}, [("way", 10_000 + n - 6, "outer"), ("way", 10_000 + n - 5, "outer"), ("way", 10_000 + n - 4, "inner")]))
    return spark.createDataFrame(rows, schema)


def _features(spark, d):
    return positions(spark, d).select(F.col("kind").alias("class"), "lat", "lon").distinct()


def _areas(spark, d):
    ring = lambda y, x: [(y, x), (y, x + 0.004), (y + 0.003, x + 0.002), (y, x)]
    return spark.createDataFrame([(1, ring(51.501, -0.099)), (2, ring(51.503, -0.097))], "area long, ring array<struct<lat:double,lon:double>>")


def _raster(spark, d):
    cy, cx = geo.cell(F.col("lat"), F.col("lon"), 0.0005)
    return positions(spark, d).groupBy(cy.alias("cy"), cx.alias("cx")).agg(F.max("value").alias("v"))


QUERIES = {
    "env_around": lambda s, d: around(positions(s, d), _features(s, d), 80.0).select("track", "idx", "class", "n", F.round("nearest", 3).alias("nearest")),
    "env_inside": lambda s, d: inside(positions(s, d), _areas(s, d)),
    "env_raster": lambda s, d: sampled(positions(s, d), _raster(s, d), 0.0005).select("track", "idx", "at", F.round("mean", 8).alias("mean")),
    "env_metrics": lambda s, d: metrics(positions(s, d).select("track", "t", "idx", "lat", "lon"), street_elements(s)),
    "env_timeline": lambda s, d: projected(positions(s, d).select("track", "t", "idx", "lat", "lon"), metrics(positions(s, d).where("kind = 'purchase'").select("track", "t", "idx", "lat", "lon"), street_elements(s))),
    "env_turns": lambda s, d: turns(positions(s, d)).select("track", "idx", (F.round("turn", 3) + F.lit(0.0)).alias("turn"), "label"),
    "env_exposure": lambda s, d: exposure(positions(s, d), "kind", "value").select("kind", "n", "tracks", *(F.round(c, 3).alias(c) for c in ("mean", "sigma", "low", "high"))),
}
_IN = " + ".join(f"(CASE WHEN ({a}.y > lat) != ({b}.y > lat) AND lon < ({b}.x - {a}.x) * (lat - {a}.y) / ({b}.y - {a}.y) + {a}.x THEN 1 ELSE 0 END)" for a, b in (("r[1]", "r[2]"), ("r[2]", "r[3]"), ("r[3]", "r[4]")))
_RING = "[{{'y': {0}, 'x': {1}}}, {{'y': {0}, 'x': {1} + 0.004::double}}, {{'y': {0} + 0.003::double, 'x': {1} + 0.002::double}}, {{'y': {0}, 'x': {1}}}]"
_BEARING = "degrees(atan2(sin(radians({3} - {1})) * cos(radians({2})), cos(radians({0})) * sin(radians({2})) - sin(radians({0})) * cos(radians({2})) * cos(radians({3} - {1}))))"
ORACLE_SQL = {
    "env_around": f"""WITH {POSITIONS_SQL}, f AS (SELECT DISTINCT kind AS class, lat, lon FROM p),
d AS (SELECT p.track, p.idx, class, sqrt(((f.lat - p.lat) * 111320) ** 2 + ((f.lon - p.lon) * 111320 * cos(radians(p.lat))) ** 2) AS d FROM p JOIN f ON abs(f.lat - p.lat) * 111320 <= 80)
SELECT track, idx, class, count(*) AS n, round(min(d), 3) AS nearest FROM d WHERE d <= 80 GROUP BY track, idx, class""",
    "env_inside": f"""WITH {POSITIONS_SQL}, a(area, r) AS (VALUES (1, {_RING.format("51.501::double", "-0.099::double")}), (2, {_RING.format("51.503::double", "-0.097::double")}))
SELECT track, idx, area::bigint AS area FROM p, a WHERE ({_IN}) % 2 = 1""",
    "env_raster": f"""WITH {POSITIONS_SQL}, c AS (SELECT *, floor(lat / 0.0005)::bigint AS cy, floor(lon / 0.0005)::bigint AS cx FROM p),
r AS (SELECT cy, cx, max(value) AS v FROM c GROUP BY cy, cx)
SELECT track, idx, max(v) FILTER (r.cy = c.cy AND r.cx = c.cx) AS at, round(avg(v), 8) AS mean
FROM c JOIN r ON r.cy BETWEEN c.cy - 1 AND c.cy + 1 AND r.cx BETWEEN c.cx - 1 AND c.cx + 1 GROUP BY track, idx""",
    "env_turns": f"""WITH {POSITIONS_SQL}, n AS (SELECT *, lag(lat) OVER w AS y0, lag(lon) OVER w AS x0, lead(lat) OVER w AS y2, lead(lon) OVER w AS x2 FROM p WINDOW w AS (PARTITION BY track ORDER BY t, idx)),
b AS (SELECT track, idx, ({_BEARING.format("y0", "x0", "lat", "lon")} + 360) % 360 AS b1, ({_BEARING.format("lat", "lon", "y2", "x2")} + 360) % 360 AS b2 FROM n),
u AS (SELECT track, idx, (b2 - b1 + 540) % 360 - 180 AS turn FROM b)
SELECT track, idx, round(turn, 3) + 0.0 AS turn, CASE WHEN abs(turn) <= 25 THEN 'straight' WHEN abs(turn) >= 135 THEN 'reverse' WHEN abs(turn) >= 40 THEN 'turn' ELSE 'ambiguous' END AS label FROM u""",
    "env_exposure": f"""WITH {POSITIONS_SQL}, k AS (SELECT kind, track, avg(value) AS m FROM p GROUP BY kind, track),
b AS (SELECT kind, count(*) AS tracks, stddev_samp(m) AS between_ FROM k GROUP BY kind),
g AS (SELECT kind, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sigma FROM p GROUP BY kind HAVING count(value) >= 5),
x AS (SELECT *, greatest(sigma / sqrt(n), coalesce(between_ / sqrt(tracks), 0)) AS err FROM g JOIN b USING (kind))
SELECT kind, n, tracks, round(mean, 3) AS mean, round(sigma, 3) AS sigma, round(mean - 1.96 * err, 3) AS low, round(mean + 1.96 * err, 3) AS high FROM x""",
}
