"""Passages of walks through junctions: visits, arms, dominant ways, decisions, merged passages and mid-block controls.

Points are matched fixes (track, t, idx, lat, lon, way, dist, raw_lat, raw_lon); dist and the raw position may be null.
Visits are islands of points within leaving distance of a node, met by cells; arms end at the first and last point within
``ARM_M`` of walked distance, found by one union and one running window each; an arm's ways are runs of points, met on
buckets of walked distance, so that someone who stands still makes one run and no square of rows. Passages are merged, and
controls spaced, by following successors (``orbits``): no track is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.lineage import cut
from ..sources.tables import positions
from . import junctions, orbits
from .junctions import LEAVE_M, MERGE_M, PASS_M, SPAN_M
from .windows import by_time

#: Fixed values (metres): walked distance of an arm, least length of one, furthest from its way that a fix counts, controls from nodes and passages, and from each other.
ARM_M, LEAST_ARM_M, ON_WAY_M, CLEAR_M, SPACING_M = 25.0, 15.0, 20.0, 30.0, 25.0

_ROW = ("i", "idx", "t", "s", "lat", "lon", "raw_lat", "raw_lon")


def walked(points: DataFrame) -> DataFrame:
    """``points`` with their number i from 0 and the distance s walked so far; ``on`` is whether they are near their way."""
    w = by_time()
    step = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    on = F.col("way").isNotNull() & ~F.coalesce(F.col("dist") > ON_WAY_M, F.lit(False))
    out = points.withColumns({"i": F.row_number().over(w).cast("long") - 1, "_step": F.when(F.lag("lat").over(w).isNull(), 0.0).otherwise(step), "on": on})
    return out.withColumn("s", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def crossings(ways: DataFrame) -> DataFrame:
    """(key, lat, lon, junction, degree, ways) of nodes; degree and ways are those of the junction that they belong to."""
    found = cut(junctions.merged(cut(junctions.nodes(ways))))
    whole = found.groupBy("junction").agg(F.max("degree").alias("degree"), F.array_distinct(F.flatten(F.collect_list("ways"))).alias("ways"))
    return found.select("key", "lat", "lon", "junction", F.col("ways").alias("own_ways")).join(whole, "junction")


def near_nodes(walk: DataFrame, found: DataFrame) -> DataFrame:
    """(track, i, key, d) of points within leaving distance of a node, by cells of that size."""
    band = geo.band_of(F.col("lat"), LEAVE_M)
    at = walk.select("track", "i", "lat", "lon", band.alias("cy"), geo.column_of(F.col("lon"), band, LEAVE_M).alias("cx"))
    of = found.select("key", F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon")).withColumn("c", F.explode(geo.near_cells(F.col("n_lat"), F.col("n_lon"), LEAVE_M))).select("key", "n_lat", "n_lon", "c.cy", "c.cx")
    d = geo.haversine(F.col("lat"), F.col("lon"), F.col("n_lat"), F.col("n_lon"))
    return at.join(of, ["cy", "cx"]).withColumn("d", d).where(F.col("d") <= LEAVE_M).select("track", "i", "key", "d")


def visits(walk: DataFrame, found: DataFrame, near: DataFrame, ways: DataFrame) -> DataFrame:
    """(track, key, visit, i, d): hits of nodes, by visit; a visit lasts until the walk is further away than the leaving distance.

    A point on a road meets the nodes of its own way, a point on a pavement, which makes no node, those of any.
    """
    pavements = ways.where(junctions.is_adjunct(F.col("tags"))).select(F.col("id").alias("way"), F.lit(True).alias("_pavement"))
    # a node's ways are met as rows: a list of them with each point would grow with points times ways
    owned = found.select("key", F.explode("own_ways").alias("way")).distinct().withColumn("_owned", F.lit(True))
    met = near.join(walk.select("track", "i", "way", "on"), ["track", "i"]).join(owned, ["key", "way"], "left").join(pavements, "way", "left")
    own = F.coalesce("_owned", F.lit(False)) | F.coalesce("_pavement", F.lit(False))
    w = Window.partitionBy("track", "key").orderBy("i")
    runs = met.select("track", "key", "i", "d", (F.col("on") & own & (F.col("d") <= PASS_M)).alias("_hit")).withColumn("_run", F.col("i") - F.row_number().over(w))
    return runs.where("_hit").select("track", "key", F.col("_run").alias("visit"), "i", "d")


def reached(walk: DataFrame, at: DataFrame, metres: float = ARM_M) -> DataFrame:
    """(track, i, before, after): for rows (track, i, s) of ``at`` the first and the last point less than ``metres`` away, as structs."""
    row, none = F.struct(*_ROW), lambda c: F.lit(None).cast(c)
    kind = walk.select(row.alias("x")).schema["x"].dataType
    points = walk.select("track", F.col("s").alias("_s"), F.lit(1).alias("_side"), F.col("i").alias("_i"), row.alias("_row"), none("long").alias("i"))
    probe = lambda sign: at.select("track", (F.col("s") + sign * metres).alias("_s"), F.lit(0).alias("_side"), none("long").alias("_i"), none(kind).alias("_row"), "i")
    down = Window.partitionBy("track").orderBy(F.desc("_s"), "_side", F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("track").orderBy("_s", "_side", "_i").rowsBetween(Window.unboundedPreceding, 0)
    seen = lambda sign, w, name: points.unionByName(probe(sign)).withColumn(name, F.last("_row", True).over(w)).where("i is not null").select("track", "i", name)
    return seen(-1, down, "before").join(seen(1, up, "after"), ["track", "i"])


def way_runs(walk: DataFrame) -> DataFrame:
    """(track, way, first, last, s0, s1) of points in a row on one way."""
    w = by_time()
    way = F.when(F.col("on"), F.col("way"))
    marked = walk.select("track", "t", "idx", "i", "s", way.alias("way")).withColumn("_new", F.when(F.col("way").eqNullSafe(F.lag("way").over(w)) & (F.col("i") > 0), 0).otherwise(1))
    runs = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("way is not null")
    return runs.groupBy("track", "_run").agg(F.first("way").alias("way"), F.min("i").alias("first"), F.max("i").alias("last"), F.min("s").alias("s0"), F.max("s").alias("s1")).drop("_run")


def turn_of(a: Column, b: Column, c: Column, d: Column, raw: bool = False) -> Column:
    """Signed change of bearing from the leg a-b to the leg c-d; of the raw positions it is null where one is missing."""
    lat, lon = ("raw_lat", "raw_lon") if raw else ("lat", "lon")
    leg = lambda u, v: geo.bearing(u[lat], u[lon], v[lat], v[lon])
    return F.pmod(leg(c, d) - leg(a, b) + 180, F.lit(360.0)) - 180


def decided(turn: Column, raw: Column) -> Column:
    """Straight, turn, reverse or ambiguous; ambiguous too where the raw positions say something else."""
    return F.when(raw.isNotNull() & (geo.turn_label(raw) != geo.turn_label(turn)), "ambiguous").otherwise(geo.turn_label(turn))


def _long_enough(before: Column, here: Column, after: Column) -> Column:
    return (here - before["s"] >= LEAST_ARM_M) & (after["s"] - here >= LEAST_ARM_M)


def single(walk: DataFrame, ways: DataFrame, found: DataFrame, near: DataFrame) -> DataFrame:
    """One passage a visit: its nearest hit with two arms at a node that is a choice of ways or a change of their character."""
    hits = cut(visits(walk, found, near, ways).join(walk.select("track", "i", "s", F.struct(*_ROW).alias("here")), ["track", "i"]))
    armed = hits.join(reached(walk, hits.select("track", "i", "s").distinct()), ["track", "i"]).where(_long_enough(F.col("before"), F.col("s"), F.col("after")))
    armed = armed.join(found.select("key", "lat", "lon", "junction", "degree"), "key")
    nearest = F.row_number().over(Window.partitionBy("track", "key", "visit").orderBy("d", "i"))
    armed = cut(armed.withColumn("_rank", nearest).where("_rank = 1 or degree < 3").drop("_rank"))  # a choice takes the nearest hit as it is

    bucket = lambda a, b: F.explode(F.sequence(F.floor(a / ARM_M), F.floor(b / ARM_M))).alias("_bucket")
    runs = way_runs(walk).select("track", F.col("way").alias("_way"), "first", "last", bucket(F.col("s0"), F.col("s1")))
    arms = armed.select("track", "key", "i", F.col("before.i").alias("a"), F.col("after.i").alias("b"), bucket(F.col("before.s"), F.col("after.s")))
    of = found.select("key", F.explode("ways").alias("_way")).distinct().withColumn("_own", F.lit(True))
    met = arms.join(runs, ["track", "_bucket"]).drop("_bucket").distinct().join(of, ["key", "_way"], "left").withColumn("_own", F.coalesce("_own", F.lit(False)))
    overlap = lambda a, b: F.greatest(F.lit(0).cast("long"), F.least("last", b) - F.greatest("first", a) + 1)
    sides = {"in": (F.col("a"), F.col("i")), "out": (F.col("i"), F.col("b"))}
    by_way = met.groupBy("track", "key", "i", "_way", "_own").agg(
        *(F.sum(overlap(a, b)).alias(f"n_{k}") for k, (a, b) in sides.items()), *(F.min(F.when(overlap(a, b) > 0, F.greatest("first", a))).alias(f"at_{k}") for k, (a, b) in sides.items())
    )
    best = lambda k: F.max(F.when(F.col(f"n_{k}") > 0, F.struct("_own", f"n_{k}", -F.col(f"at_{k}"), "_way")))["_way"]
    chosen = by_way.groupBy("track", "key", "i").agg(*(best(k).alias(f"{k}_way") for k in sides))
    out = armed.join(chosen, ["track", "key", "i"])
    for k in sides:
        out = out.join(ways.select(F.col("id").alias(f"{k}_way"), junctions.character(F.col("tags")).alias(f"{k}_class")), f"{k}_way", "left").withColumn(f"{k}_class", F.coalesce(f"{k}_class", F.lit("||")))
    choice, change = F.col("degree") >= 3, F.col("in_class") != F.col("out_class")
    out = out.where(choice | change).withColumn("kind", F.when(choice & change, "choice+change").when(choice, "choice").otherwise("change"))
    turns = {"turn": turn_of(*(F.col(c) for c in ("before", "here", "here", "after"))), "raw_turn": turn_of(*(F.col(c) for c in ("before", "here", "here", "after")), raw=True)}
    out = out.withColumns(turns).withColumn("decision", decided(F.col("turn"), F.col("raw_turn")))
    kept = ("here", "before", "after", "lat", "lon", "junction", "degree", "kind", "decision", "in_way", "out_way", "in_class", "out_class")
    first = out.groupBy("track", "key", "visit").agg(F.min(F.struct("d", "i", F.struct(*kept).alias("x"))).alias("m"))
    return first.select("track", F.col("key").alias("node"), *(F.col(f"m.x.{c}").alias(c) for c in kept))


def merged_passages(passages: DataFrame) -> DataFrame:
    """Passages no more than ``MERGE_M`` of walked distance from the one before and ``SPAN_M`` from a group's first are one; the whole way through decides."""
    w = Window.partitionBy("track").orderBy("_i", "node")
    rows = passages.withColumns({"_i": F.col("here.i"), "_s": F.col("here.s")})
    rows = cut(rows.withColumns({"r": F.row_number().over(w).cast("long") - 1, "_break": F.coalesce(F.col("_s") - F.lag("_s").over(w) > MERGE_M, F.lit(False))}))
    later = Window.partitionBy("track").orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    apart = rows.select("track", "r", "_s", F.min(F.when(F.col("_break"), F.col("r"))).over(later).alias("_next"))
    succ = orbits.first_at(apart, ["track"], "_s", SPAN_M, strict=True).withColumn("succ", F.least("succ", "_next"))
    heads = orbits.followed(succ, ["track"]).withColumn("_head", F.lit(1))
    grouped = rows.join(heads, ["track", "r"], "left").withColumn("_group", F.count("_head").over(Window.partitionBy("track").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.when(F.col("kind") == "choice+change", 1000).otherwise(0) + F.when(F.col("decision") == "turn", 500).otherwise(0) + F.col("degree")
    end = lambda c, f: f(F.struct("r", c))[c]
    g = grouped.groupBy("track", "_group").agg(
        F.min("junction").alias("key"), F.max(F.struct(rank.alias("k"), -F.col("r"), "lat", "lon")).alias("best"), F.min(F.struct("before.i", "before"))["before"].alias("before"), F.max(F.struct("after.i", "after"))["after"].alias("after"),
        *(end(c, F.min).alias(f"first_{c}") for c in ("here", "in_way", "in_class")), *(end(c, F.max).alias(f"last_{c}") for c in ("here", "out_way", "out_class")),
        F.max("degree").alias("degree"), F.max(F.col("kind").contains("choice")).alias("_choice"), F.max(F.col("kind").contains("change")).alias("_change"), F.count("*").alias("merged"),
    )
    legs = [F.col(c) for c in ("before", "first_here", "last_here", "after")]
    g = g.withColumns({"turn": turn_of(*legs), "raw_turn": turn_of(*legs, raw=True)})
    kind = F.when(F.col("_choice") & F.col("_change"), "choice+change").when(F.col("_choice"), "choice").otherwise("change")
    return g.select(
        "track", "key", F.col("first_here.i").alias("i"), F.col("first_here.idx").alias("idx"), F.col("first_here.t").alias("t"), F.col("first_here.t").alias("enter"), F.col("last_here.t").alias("exit"), "best.lat", "best.lon", kind.alias("kind"), "degree",
        decided(F.col("turn"), F.col("raw_turn")).alias("decision"), "turn", "raw_turn", F.col("first_in_way").alias("in_way"), F.col("last_out_way").alias("out_way"), F.col("first_in_class").alias("in_class"), F.col("last_out_class").alias("out_class"),
        "merged", (F.col("last_here.s") - F.col("first_here.s")).alias("span"), F.col("before.s").alias("from_s"), F.col("after.s").alias("to_s"),
    )


def controls(walk: DataFrame, ways: DataFrame, near: DataFrame, passages: DataFrame) -> DataFrame:
    """Points in the middle of a block, far from nodes and passages, walked straight on; the furthest first, ``SPACING_M`` apart.

    Between two passages the distance to them rises to one point and falls behind it, so that the furthest-first choice is
    that point and then, to either side, always the next point far enough from the last.
    """
    same = F.sum(F.when(F.col("way").eqNullSafe(F.lag("way").over(by_time())) & (F.col("i") > 0), 0).otherwise(1)).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    here = walk.withColumn("here", F.struct(*_ROW))
    # distance from the passages: the furthest end of those begun before, the next begin
    mark = walk.select("track", F.col("s").alias("_s"), F.lit(1).alias("_side"), "i", F.lit(None).cast("double").alias("_end"))
    mark = mark.unionByName(passages.select("track", F.col("from_s").alias("_s"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("i"), F.col("to_s").alias("_end")))
    up = Window.partitionBy("track").orderBy("_s", "_side").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("track").orderBy(F.desc("_s"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    is_start = F.col("_side") == 0
    far = mark.withColumns({"_ended": F.max("_end").over(up), "_stretch": F.count(F.when(is_start, 1)).over(up), "_begins": F.min(F.when(is_start, F.col("_s"))).over(down)}).where("i is not null")
    none = F.lit(float("inf"))
    away = F.least(F.when(F.col("_ended").isNull(), none).otherwise(F.greatest(F.col("_s") - F.col("_ended"), F.lit(0.0))), F.coalesce(F.col("_begins") - F.col("_s"), none))
    far = far.select("track", "i", "_stretch", away.alias("away")).where(F.col("away") >= CLEAR_M)
    clear = walk.where("on").join(ways.select(F.col("id").alias("way")), "way", "left_semi").select("track", "i").join(far, ["track", "i"]).join(near.where(F.col("d") < CLEAR_M).select("track", "i").distinct(), ["track", "i"], "left_anti")
    # arms end where the way does
    runs = here.select("track", "i", "t", "idx", "s", "way", "here", same.alias("_run"))
    ends = runs.groupBy("track", "_run").agg(F.min(F.struct("i", "here"))["here"].alias("run_first"), F.max(F.struct("i", "here"))["here"].alias("run_last"))
    spots = cut(clear.join(runs, ["track", "i"]).join(ends, ["track", "_run"]))
    spots = spots.join(reached(walk, spots.select("track", "i", "s")), ["track", "i"])
    before = F.when(F.col("run_first.i") > F.col("before.i"), F.col("run_first")).otherwise(F.col("before"))
    after = F.when(F.col("run_last.i") < F.col("after.i"), F.col("run_last")).otherwise(F.col("after"))
    spots = spots.withColumns({"before": before, "after": after}).where(_long_enough(F.col("before"), F.col("s"), F.col("after")))
    legs = [F.col(c) for c in ("before", "here", "here", "after")]
    spots = spots.withColumns({"turn": turn_of(*legs), "raw_turn": turn_of(*legs, raw=True)})
    spots = cut(spots.where(decided(F.col("turn"), F.col("raw_turn")) == "straight"))
    # outwards from the furthest point of each stretch
    top = spots.groupBy("track", "_stretch").agg(F.max(F.struct("away", (-F.col("i")).alias("n"), "s")).alias("m")).select("track", "_stretch", F.col("m.s").alias("_top"), (-F.col("m.n")).alias("_top_i"))
    side = F.explode(F.array(F.lit(-1), F.lit(1))).alias("_way_out")
    sides = spots.select("track", "_stretch", "i", "s").join(top, ["track", "_stretch"]).select("*", side).withColumn("_off", (F.col("s") - F.col("_top")) * F.col("_way_out")).where("_off > 0 or i = _top_i")
    kept = orbits.gated(sides.select("track", "_stretch", "_way_out", "i", "_off", (F.col("i") != F.col("_top_i")).alias("_other")), ["track", "_stretch", "_way_out"], F.col("_off"), SPACING_M, ["_off", "_other", "i"])
    out = spots.join(kept.select("track", "i").distinct(), ["track", "i"], "left_semi").join(ways.select(F.col("id").alias("way"), junctions.character(F.col("tags")).alias("class")), "way")
    kind = F.lit("control")
    return out.select(
        "track", F.concat_ws("_", F.lit("ctrl"), "way", F.col("here.idx")).alias("key"), "i", F.col("here.idx").alias("idx"), F.col("here.t").alias("t"), F.col("here.t").alias("enter"), F.col("here.t").alias("exit"), F.col("here.lat").alias("lat"), F.col("here.lon").alias("lon"), kind.alias("kind"),
        F.lit(2).cast("long").alias("degree"), kind.alias("decision"), "turn", "raw_turn", F.col("way").alias("in_way"), F.col("way").alias("out_way"), F.col("class").alias("in_class"), F.col("class").alias("out_class"), F.lit(1).cast("long").alias("merged"), F.lit(0.0).alias("span"), F.col("before.s").alias("from_s"), F.col("after.s").alias("to_s"),
    )


def classified(points: DataFrame, ways: DataFrame, with_controls: bool = False) -> DataFrame:
    """Passages of ``points`` through the junctions of ``ways`` (id, tags, path), and the controls between them."""
    walk, found = cut(walked(points)), crossings(ways)
    near = cut(near_nodes(walk, found))
    out = cut(merged_passages(single(walk, ways, found, near)))
    return out.unionByName(controls(walk, ways, near, out)) if with_controls else out


#: Metres of a block of the streets that the registered queries lay under the events, and of a step along them.
BLOCK_M, STEP_M = 60, 3


def _trail(spark, d) -> DataFrame:
    """Each event a step along blocks that go east or north by turns, with the block k and its corner in blocks."""
    p = positions(spark, d)
    w = by_time()
    j = F.row_number().over(w) - 1
    per = BLOCK_M // STEP_M
    p = p.select("track", "t", "idx", "kind", "value", j.alias("j")).withColumn("k", F.floor(F.col("j") / per))
    east = (F.col("track") + F.col("k") * F.col("k")) % 3 != 0
    p = p.withColumn("east", east)
    x = lambda flag: F.sum(F.when(flag, STEP_M).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return p.withColumns({"x": F.coalesce(x(F.col("east")), F.lit(0)), "y": F.coalesce(x(~F.col("east")), F.lit(0))})


def _place(track: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return F.lit(51.0) + track % 1000 * 0.01 + y / geo.DEGREE_M, F.lit(-0.1) + x / (geo.DEGREE_M * 0.62)


def streets(spark, d) -> DataFrame:
    """(id, tags, path) of the blocks walked and of side streets at some corners and a little behind some."""
    t = _trail(spark, d).groupBy("track", "k").agg(F.min("east").alias("east"), F.min("x").alias("x"), F.min("y").alias("y")).withColumn("n", F.col("track") * 1_000_000 + F.col("k") * 4)
    dx, dy = F.when(F.col("east"), 1).otherwise(0), F.when(F.col("east"), 0).otherwise(1)

    def way(part: int, class_: Column, points: list[tuple[Column, Column]], where: Column) -> Column:
        at = [_place(F.col("track"), F.col("x") + a, F.col("y") + b) for a, b in points]
        path = F.array(*(F.struct(a.alias("lat"), b.alias("lon")) for a, b in at))
        return F.when(where, F.struct((F.col("n") + part).alias("id"), F.create_map(F.lit("highway"), class_).alias("tags"), path.alias("path")))

    zero = F.lit(0)
    main = way(0, F.when(F.col("k") % 5 == 4, "footway").otherwise("residential"), [(zero, zero), (dx * 12, dy * 12), (dx * BLOCK_M, dy * BLOCK_M)], F.lit(True))
    corner = way(1, F.lit("service"), [(zero, zero), (-dy * 40, -dx * 40)], (F.col("track") + F.col("k")) % 2 == 0)
    behind = way(2, F.lit("tertiary"), [(dx * 12, dy * 12), (dx * 12 - dy * 40, dy * 12 - dx * 40)], (F.col("track") + F.col("k")) % 3 == 0)
    return t.select(F.explode(F.array(main, corner, behind)).alias("way")).where("way is not null").select("way.*")


def street_walk(spark, d) -> DataFrame:
    """The events as matched points on ``streets``; raw positions are some metres off, and now and then a point is far from its way."""
    p = _trail(spark, d)
    lat, lon = _place(F.col("track"), F.col("x"), F.col("y"))
    off = lambda m: (F.col("idx") * m % 11 - 5) * 3e-6
    return p.select("track", "t", "idx", "value", lat.alias("lat"), lon.alias("lon"), (F.col("track") * 1_000_000 + F.col("k") * 4).alias("way"), F.when(F.col("idx") % 41 == 0, 35.0).otherwise(3.0).alias("dist"), (lat + off(37)).alias("raw_lat"), (lon + off(91)).alias("raw_lon"))


def _query(spark, d, with_controls: bool) -> DataFrame:
    out = classified(street_walk(spark, d), streets(spark, d), with_controls)
    if with_controls:
        out = out.where("decision = 'control'")
    rounded = {c: F.round(c, 5) for c in ("turn", "raw_turn", "span", "from_s", "to_s")}
    return out.withColumns(rounded).drop("lat", "lon")


QUERIES = {
    "junction_passages": lambda s, d: _query(s, d, False),
    "junction_controls": lambda s, d: _query(s, d, True),
}
ORACLE_SQL: dict[str, str] = {}
