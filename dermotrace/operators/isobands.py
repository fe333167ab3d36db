"""Bands between levels of a grid (cy, cx, v) as closed rings with holes, and contour lines, without a group a level.

Each square of four cells gives directed half-edges that have the band on their left: its own contour segments, and those
parts of its sides beyond which there is no square. A vertex is named by the grid edge or corner that it lies on, not by
its place, so that each has one edge in and one out. Half-edges become rings by pointer doubling: a round is one
equi-join of each vertex with the one that it points at. Orientation tells rings from holes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .surfaces import LEVELS, _corners, _grid, _round, _spread

CORNERS = "abcd"
#: A square's sides, anticlockwise: the cells that it lies between, lower first; whether it is upright; its lower end.
SIDES = (("a", "b", 0, 0, 0), ("b", "c", 1, 0, 1), ("d", "c", 0, 1, 0), ("a", "d", 1, 0, 0))
PLACES = ((0, 0), (0, 1), (1, 1), (1, 0))
BEYOND = ((-1, 0), (0, 1), (1, 0), (0, -1))


def followed(links: DataFrame) -> DataFrame:
    """(key, chain, steps, closed) of ``links`` (key, nxt): the end that a key leads to, or the least key of its cycle, and how far.

    Keys are unique; a key that ends a chain has a null ``nxt``. After k rounds a row knows the least of the 2^k keys
    from it on; ends count as less than all others. Once a round changes nothing, every row knows the least of its chain.
    """
    name = F.concat(F.when(F.col("nxt").isNull(), "0").otherwise("1"), F.col("key"))
    state, span = cut(links.select("key", "nxt", name.alias("low"), F.lit(0).cast("long").alias("steps"), F.lit(True).alias("moved"))), 1
    while state.where("moved and nxt is not null").limit(1).count():
        ahead = state.select(F.col("key").alias("nxt"), F.col("nxt").alias("_nxt"), F.col("low").alias("_low"), F.col("steps").alias("_steps"))
        less = F.col("_low") < F.col("low")
        live = state.where("nxt is not null").join(ahead, "nxt")
        live = live.select("key", F.col("_nxt").alias("nxt"), F.when(less, F.col("_low")).otherwise(F.col("low")).alias("low"), F.when(less, F.col("_steps") + span).otherwise(F.col("steps")).alias("steps"), less.alias("moved"))
        state, span = cut(live.unionByName(state.where("nxt is null").withColumn("moved", F.lit(False)))), span * 2
        if not state.where("moved").limit(1).count():
            break
    return state.select("key", F.substring("low", 2, 1 << 30).alias("chain"), "steps", F.col("low").startswith("1").alias("closed"))


def _squares(grid: DataFrame, at: list[float]) -> DataFrame:
    """Squares with the band of each corner: how many levels are at or below its value."""
    band = lambda k: sum((F.when(F.col(k) >= level, 1).otherwise(0) for level in at), F.lit(0))
    return _corners(grid.where(F.col("v").isNotNull() & ~F.isnan("v"))).withColumns({f"n{k}": band(k) for k in CORNERS})


def _vertex(kind: Column | int, cy: Column, cx: Column, mark: Column, y: Column, x: Column) -> Column:
    """On a level side (0), an upright side (1) or at a corner (2); ``mark``: the level, or the square of a corner where two touch."""
    kind = F.lit(kind) if isinstance(kind, int) else kind
    return F.struct(kind.alias("kind"), cy.cast("long").alias("cy"), cx.cast("long").alias("cx"), mark.cast("int").alias("mark"), y.cast("double").alias("y"), x.cast("double").alias("x"))


def _crossing(i: int, m: Column, at: list[float]) -> Column:
    """Where side ``i`` crosses level ``m``; both squares of a side reckon it the same way round."""
    p, q, upright, dy, dx = SIDES[i]
    s = F.try_divide(F.element_at(F.array(*map(F.lit, at)), m + 1) - F.col(p), F.col(q) - F.col(p))
    cy, cx = F.col("cy") + dy, F.col("cx") + dx
    return _vertex(upright, cy, cx, m, cy + (s if upright else 0), cx + (F.lit(0) if upright else s))


def _segments(squares: DataFrame, at: list[float]) -> DataFrame:
    """(m, p, q) of each square and level between its corners: directed, the higher side on the left."""
    bands = [F.col(f"n{k}") for k in CORNERS]
    low, high = F.least(*bands), F.greatest(*bands)
    each = squares.where(low < high).withColumn("m", F.explode(F.sequence(low, high - 1)))
    m = F.col("m")
    above = [F.col(f"n{k}") > m for k in CORNERS]
    enters = [~above[i] & above[(i + 1) % 4] for i in range(4)]
    leaves = [above[i] & ~above[(i + 1) % 4] for i in range(4)]
    saddle = (above[0] == above[2]) & (above[1] == above[3])
    middle = (F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4 >= F.element_at(F.array(*map(F.lit, at)), m + 1)
    only = F.coalesce(*(F.when(e, j) for j, e in enumerate(enters)))
    each = each.withColumn("x", F.array(*(_crossing(i, m, at) for i in range(4))))
    line = lambda i: F.when(leaves[i], F.struct(F.col("x")[i].alias("p"), F.element_at("x", 1 + F.when(saddle, F.when(middle, (i + 1) % 4).otherwise((i + 3) % 4)).otherwise(only)).alias("q")))
    lines = F.filter(F.array(*map(line, range(4))), lambda s: s.isNotNull())
    return each.select("m", F.explode(lines).alias("l")).select("m", "l.p", "l.q")


def _shores(squares: DataFrame, at: list[float]) -> DataFrame:
    """(band, p, q): for each band its part of the sides beyond which no square lies, anticlockwise round the square."""
    near = _spread(squares.select("cy", "cx", F.lit(1.0).alias("v")), [(i, j, 1.0) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    has = {(i, j): F.max((F.col("i") == i) & (F.col("j") == j)).alias(f"h{i}{j}") for i in (-1, 0, 1) for j in (-1, 0, 1)}
    rim = near.groupBy("cy", "cx").agg(F.count("*").alias("n"), *has.values()).where("n < 9 and h00")
    each = rim.join(squares, ["cy", "cx"])
    h = lambda i, j: F.col(f"h{i}{j}")

    def corner(k: int) -> Column:
        y, x = PLACES[k]
        i, j = 2 * y - 1, 2 * x - 1
        touch = h(i, j) & ~h(i, 0) & ~h(0, j)  # two squares that only share this corner stay apart
        cy, cx = F.col("cy") + y, F.col("cx") + x
        return _vertex(2, cy, cx, F.when(touch, k + 1).otherwise(0), cy, cx)

    def part(i: int) -> DataFrame:
        j = (i + 1) % 4
        p, q = F.col(f"n{CORNERS[i]}"), F.col(f"n{CORNERS[j]}")
        side = each.where(~h(*BEYOND[i])).withColumn("band", F.explode(F.sequence(F.least(p, q), F.greatest(p, q))))
        band = F.col("band")
        # a band that doesn't hold the corner begins at its own lower or upper level
        end = lambda n, k: F.when(n == band, corner(k)).when(n < band, _crossing(i, band - 1, at)).otherwise(_crossing(i, band, at)) if at else corner(k)
        return side.select("band", end(p, i).alias("p"), end(q, j).alias("q"))

    return reduce(DataFrame.unionByName, map(part, range(4)))


def _key(group: str, vertex: str) -> Column:
    return F.concat_ws(":", group, *(f"{vertex}.{k}" for k in ("kind", "cy", "cx", "mark")))


def band_edges(grid: DataFrame, at: list[float]) -> DataFrame:
    """(band, key, nxt, p, q): half-edges of the bands that ``at`` (increasing) splits the surface into, the band on the left.

    Band k holds values from level k - 1 on and below level k. A cell without a value (null or NaN too) isn't there.
    """
    squares = _squares(grid, at)
    lines = _segments(squares, at)
    up = lines.select((F.col("m") + 1).alias("band"), "p", "q")
    down = lines.select(F.col("m").alias("band"), F.col("q").alias("p"), F.col("p").alias("q"))
    edges = up.unionByName(down).unionByName(_shores(squares, at))
    return edges.select("band", _key("band", "p").alias("key"), _key("band", "q").alias("nxt"), "p", "q")


def isobands(grid: DataFrame, at: list[float]) -> tuple[DataFrame, DataFrame]:
    """(rings, points): (band, ring, hole, part_of, n, area) and (band, ring, step, y, x), in cells.

    Rings run anticlockwise and holes clockwise, so areas of holes are negative and all areas of a band add up to its own.
    ``part_of`` is the ring that a hole lies in, and a ring itself: from a hole's leftmost vertex on a row of cells the band
    lies to the left, up to a vertex of the same part of the band.
    """
    edges = cut(band_edges(grid, at))
    at_ = cut(followed(edges.select("key", "nxt")).withColumnRenamed("chain", "ring"))
    met = edges.join(at_, "key")
    cross = (F.col("p.x") * F.col("q.y") - F.col("q.x") * F.col("p.y")) / 2
    rings = cut(met.groupBy("band", "ring").agg(F.count("*").alias("n"), F.sum(cross).alias("area")).withColumn("hole", F.col("area") < 0))
    # where vertices of a row share a place, the order is that of the grid edges and squares that they belong to
    within = F.when(F.col("p.kind") == 0, 0.0).when(F.col("p.mark").isin(2, 3), -0.75).when(F.col("p.mark") == 0, -0.5).otherwise(-0.25)
    row = met.where("p.kind <> 1").select("band", "ring", F.col("p.cy").alias("cy"), F.col("p.x").alias("x"), (F.col("p.cx") + within).alias("side"))
    left = F.lag("ring").over(Window.partitionBy("band", "cy").orderBy("x", "side"))
    first = row.withColumn("left", left).groupBy("ring").agg(F.min_by("left", F.struct("x", "side", "cy")).alias("left"))
    links = rings.join(first, "ring").select(F.col("ring").alias("key"), F.when(F.col("hole"), F.col("left")).alias("nxt"))
    holds = followed(links).select(F.col("key").alias("ring"), F.col("chain").alias("part_of"))
    points = met.join(rings.select("ring", F.col("n").alias("_n")), "ring").select("band", "ring", F.pmod(-F.col("steps"), F.col("_n")).alias("step"), F.col("p.y").alias("y"), F.col("p.x").alias("x"))
    return rings.join(holds, "ring").select("band", "ring", "hole", "part_of", "n", "area"), points


def contour_lines(grid: DataFrame, at: list[float]) -> DataFrame:
    """(level, line, closed, points array<struct<y,x>>), the higher side on the left; closed lines end where they begin."""
    edges = cut(_segments(_squares(grid, at), at).select("m", _key("m", "p").alias("key"), _key("m", "q").alias("nxt"), "p", "q"))
    last = edges.select("m", F.col("nxt").alias("key"), F.col("q").alias("p")).join(edges.select("key"), "key", "left_anti")
    vertices = edges.select("m", "key", "nxt", "p").unionByName(last.withColumn("nxt", F.lit(None).cast("string")))
    met = vertices.join(followed(vertices.select("key", "nxt")), "key")
    order = F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("o"), F.col("p.y").alias("y"), F.col("p.x").alias("x"))))
    # the least key of a cycle has no steps to itself: it is last in this order, and comes first as well
    g = met.groupBy("m", "chain", "closed").agg(order.alias("o")).withColumn("points", F.transform("o", lambda s: F.struct(s.y.alias("y"), s.x.alias("x"))))
    points = F.when(F.col("closed"), F.concat(F.slice("points", -1, 1), F.col("points"))).otherwise(F.col("points"))
    return g.select(F.element_at(F.array(*map(F.lit, at)), F.col("m") + 1).alias("level"), F.col("chain").alias("line"), "closed", points.alias("points"))


QUERIES = {
    "isobands": lambda s, d: _round(isobands(_grid(s, d), LEVELS)[0], 6),
    "contour_lines": lambda s, d: contour_lines(_grid(s, d), LEVELS),
}
ORACLE_SQL: dict[str, str] = {}
