"""Junctions of a road network, passages of walks through them, and responses before and after with permutation tests.

Nodes, passages and responses are equi-joins and windows. A permutation test shuffles within walks, so each walk gives the
sums of its own permutations, tasks add up those of their walks and Spark those of the tasks: no test gathers its items, whatever their number.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.lineage import cut
from ..sources.tables import POSITIONS_SQL, positions
from .enrichment import NO_ROAD
from .statistics import benjamini_hochberg
from .windows import by_time

#: Radius of a passage, distance that ends a visit, of nodes that are one junction (metres).
PASS_M, LEAVE_M, MERGE_M, SPAN_M = 15.0, 30.0, 20.0, 25.0
#: Window either side, least of it, longest traversal (seconds), least rows and coverage of a window, permutations, level.
WINDOW_S, LEAST_S, TRAVERSAL_S, LEAST_ROWS, COVERED, PERMUTATIONS, ALPHA = 10.0, 5.0, 20.0, 5, 0.8, 5000, 0.05
METRICS = ("peak_rate", "mean_phasic", "mean_tonic")


def is_adjunct(tags: Column) -> Column:
    """A pavement or a crossing of a road."""
    return F.coalesce((F.element_at(tags, "highway") == "footway") & F.element_at(tags, "footway").isin("sidewalk", "crossing"), F.lit(False))


def is_parking_aisle(tags: Column) -> Column:
    return F.coalesce(F.element_at(tags, "service") == "parking_aisle", F.lit(False))


def pavements_apart(tags: Column) -> Column:
    """Every pavement of the road is mapped as a way of its own."""
    tag = lambda k: F.element_at(tags, k)
    plain = tag("sidewalk")

    def side(k: str) -> Column:
        general = F.when(plain == "separate", "separate").when(plain.isin("both", "yes", k), "yes").otherwise("no")
        return F.coalesce(tag(f"sidewalk:{k}"), tag("sidewalk:both"), general)

    left, right = side("left"), side("right")
    return ((left == "separate") | (right == "separate")) & (left != "yes") & (right != "yes")


def character(tags: Column) -> Column:
    """What a walker sees of a road."""
    return F.concat_ws("|", *(F.coalesce(F.element_at(tags, k), F.lit("")) for k in ("highway", "surface", "lit")))


def node_keys(path: Column) -> Column:
    return F.transform(path, lambda p: geo.node_key(p["lat"], p["lon"]))


def share_node(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(node_keys(a), node_keys(b)), F.lit(False))


def nodes(ways: DataFrame) -> DataFrame:
    """(key, lat, lon, degree, ways array<long>) of places where two ways or more meet; ``ways`` has id, tags, path."""
    road = F.element_at("tags", "highway")
    used = ways.where(road.isNotNull() & ~road.isin(*NO_ROAD) & ~is_adjunct(F.col("tags")) & ~is_parking_aisle(F.col("tags")) & (F.size("path") >= 2))
    at = used.select("id", F.size("path").alias("n"), F.posexplode("path").alias("pos", "p"))
    degree = F.when((F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1), 1).otherwise(2)
    g = at.select("id", geo.node_key(F.col("p.lat"), F.col("p.lon")).alias("key"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), degree.alias("d")).groupBy("key").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.sum("d").alias("degree"), F.array_sort(F.collect_set("id")).alias("ways"))
    return g.where(F.size("ways") >= 2)


def _merged(table: pa.Table) -> pa.Table:
    """Nodes of a neighbourhood put together, the closest first, as long as no two of a junction are over the span apart."""
    key, lat, lon = (table.column(c).to_pylist() for c in ("key", "lat", "lon"))
    y, x = np.radians(lat), np.radians(lon)
    a = np.sin((y[:, None] - y) / 2) ** 2 + np.cos(y)[:, None] * np.cos(y) * np.sin((x[:, None] - x) / 2) ** 2
    d = 2 * geo.RADIUS_M * np.arcsin(np.sqrt(np.minimum(a, 1)))
    shared = [set(w) for w in table.column("ways").to_pylist()]
    pairs = sorted((d[i, j], key[i], key[j], i, j) for i in range(len(key)) for j in range(i) if d[i, j] <= MERGE_M and shared[i] & shared[j])
    of = [{i} for i in range(len(key))]
    for *_, i, j in pairs:
        if of[i] is not of[j] and all(d[u, v] <= SPAN_M for u in of[i] for v in of[j]):
            of[i] |= of[j]
            for v in of[j]:
                of[v] = of[i]
    return pa.table({"key": key, "junction": [min(key[k] for k in s) for s in of]})


def merged(found: DataFrame) -> DataFrame:
    """``nodes`` with ``junction``, the first key of the nodes that are one. Chains of near nodes are grouped; each is one Arrow group of some nodes."""
    band = geo.band_of(F.col("lat"), MERGE_M)
    at = found.select("key", "lat", "lon", band.alias("cy"), geo.column_of(F.col("lon"), band, MERGE_M).alias("cx"))
    near = found.select(F.col("key").alias("other"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon")).withColumn("c", F.explode(geo.near_cells(F.col("o_lat"), F.col("o_lon"), MERGE_M))).select("other", "o_lat", "o_lon", "c.cy", "c.cx")
    edges = cut(at.join(near, ["cy", "cx"]).where((F.col("key") != F.col("other")) & (geo.haversine(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")) <= MERGE_M)).select("key", "other"))
    label = cut(found.select("key", F.col("key").alias("label")))
    while True:  # the smallest key spreads along the links; chains of nodes 20 m apart are short
        least = edges.join(label.select(F.col("key").alias("other"), F.col("label").alias("n")), "other").groupBy("key").agg(F.min("n").alias("n"))
        new = cut(label.join(least, "key", "left").select("key", F.least("label", F.coalesce("n", "label")).alias("label")))
        if not new.join(label.withColumnRenamed("label", "old"), "key").where("label != old").limit(1).count():
            break
        label = new
    return found.join(found.join(label, "key").groupBy("label").applyInArrow(_merged, "key string, junction string"), "key")


def passages(points: DataFrame, found: DataFrame) -> DataFrame:
    """(track, key, visit, idx, t, enter, exit, d): visits of nodes by matched points (track, t, idx, lat, lon, way).

    Points within the leaving distance of a node are met by cells, and those in a row are a visit as long as no point
    between them is further away: only they matter, not the rest of the track. A visit's hits are points on one of the
    node's ways within the radius; its place is the nearest of them.
    """
    w = by_time()
    rows = points.select("track", "t", "idx", "lat", "lon", "way", F.row_number().over(w).alias("_i"))
    band = geo.band_of(F.col("lat"), LEAVE_M)
    at = rows.select("*", band.alias("cy"), geo.column_of(F.col("lon"), band, LEAVE_M).alias("cx"))
    of = found.select("key", "ways", F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon")).withColumn("c", F.explode(geo.near_cells(F.col("n_lat"), F.col("n_lon"), LEAVE_M))).select("key", "ways", "n_lat", "n_lon", "c.cy", "c.cx")
    near = at.join(of, ["cy", "cx"]).withColumn("d", geo.haversine(F.col("lat"), F.col("lon"), F.col("n_lat"), F.col("n_lon"))).where(F.col("d") <= LEAVE_M)
    by_node = Window.partitionBy("track", "key").orderBy("_i")
    runs = near.withColumn("_run", F.col("_i") - F.row_number().over(by_node))
    hits = runs.where((F.col("d") <= PASS_M) & F.array_contains("ways", F.col("way"))).groupBy("track", "key", "_run").agg(F.min(F.struct("d", "t", "idx")).alias("b"), F.min("t").alias("enter"), F.max("t").alias("exit"))
    visit = F.row_number().over(Window.partitionBy("track", "key").orderBy("_run")) - 1
    return hits.select("track", "key", visit.cast("long").alias("visit"), "b.idx", "b.t", "enter", "exit", "b.d")


def deflections(points: DataFrame, reach: int = 2) -> DataFrame:
    """(track, idx, turn, label): change of bearing over some points before and after each; null at a track's ends."""
    w = by_time()
    at = lambda k: (F.lag("lat", -k).over(w), F.lag("lon", -k).over(w))
    before, after = geo.bearing(*at(-reach), F.col("lat"), F.col("lon")), geo.bearing(F.col("lat"), F.col("lon"), *at(reach))
    turn = F.pmod(after - before + 540, F.lit(360.0)) - 180
    return points.select("track", "idx", turn.alias("turn"), geo.turn_label(turn).alias("label"))


def sample_intervals(series: DataFrame) -> DataFrame:
    """(track, dt): the upper median of about 200 gaps that are spread over the track; null under two rows."""
    n = F.count("*").over(Window.partitionBy("track"))
    r = series.select("track", "t", n.alias("n"), (F.row_number().over(Window.partitionBy("track").orderBy("t")) - 1).alias("r"))
    r = r.withColumn("step", F.greatest(F.lit(1), F.floor(F.col("n") / 200))).where(F.col("r") % F.col("step") == 0)
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("track").orderBy("r"))
    g = r.withColumn("gap", gap).where("gap is not null")
    ranked = g.withColumns({"_k": F.row_number().over(Window.partitionBy("track").orderBy("gap")) - 1, "_m": F.count("*").over(Window.partitionBy("track"))})
    return ranked.where("_k = floor(_m / 2)").select("track", (F.col("gap") / F.col("step")).alias("dt"))


def responses(found: DataFrame, series: DataFrame, window_s: float = WINDOW_S, delay_s: float = 0.0, share: float = COVERED) -> DataFrame:
    """(track, key, decision, t, before_*, after_*, delta_*) of passages (track, key, decision, t, enter, exit).

    Windows reach ``window_s`` to either side of the entry, but no further than halfway to the next passage's. ``series``
    has track, t, phasic, tonic and is_peak. Rows meet windows on buckets of the window's size. A passage with too short a
    window, too few rows or too little of it covered on either side is left out.
    """
    w = Window.partitionBy("track").orderBy("t", "key")
    start = F.coalesce("enter", "t")
    p = found.withColumns({"enter": start, "exit": F.coalesce("exit", "t")}).withColumn("_id", F.row_number().over(w))
    p = p.withColumns({"_a": F.lag("enter").over(w), "_b": F.lead("enter").over(w)}).where(F.col("exit") - F.col("enter") <= TRAVERSAL_S)
    p = p.withColumns({"t0": F.greatest(F.col("enter") - window_s, (F.col("_a") + F.col("enter")) / 2), "t1": F.least(F.col("enter") + window_s, (F.col("enter") + F.col("_b")) / 2)})
    p = p.join(sample_intervals(series), "track")
    buckets = F.explode(F.sequence(F.floor((F.col("t0") + delay_s) / window_s), F.floor((F.col("t1") + delay_s) / window_s))).alias("_bucket")
    met = p.select("track", "_id", "t0", "enter", "t1", buckets).join(series.select("track", F.col("t").alias("_t"), "phasic", "tonic", "is_peak", F.floor(F.col("t") / window_s).alias("_bucket")), ["track", "_bucket"])
    met = met.where((F.col("_t") >= F.col("t0") + delay_s) & (F.col("_t") < F.col("t1") + delay_s)).withColumn("after", F.col("_t") >= F.col("enter") + delay_s)
    sides = (("before", ~F.col("after")), ("after", F.col("after")))
    of = lambda c, flag: F.when(flag, c)
    bad = F.isnull("phasic") | F.isnan("phasic")
    g = met.groupBy("track", "_id").agg(*(x for name, flag in sides for x in (F.count_if(flag).alias(f"{name}_n"), F.avg(of(F.col("phasic"), flag)).alias(f"{name}_phasic"), F.avg(of(F.coalesce("tonic", F.lit(0.0)), flag)).alias(f"{name}_tonic"), F.count_if(flag & F.col("is_peak")).alias(f"{name}_peaks"), F.max(of(bad, flag)).alias(f"{name}_bad"))))
    out = p.join(g, ["track", "_id"])
    made, good = {}, F.lit(True)
    for side, length in (("before", F.col("enter") - F.col("t0")), ("after", F.col("t1") - F.col("enter"))):
        n = F.col(f"{side}_n")
        covered = F.when(F.col("dt") > 0, F.least(length, n * F.col("dt"))).otherwise(length)
        good = good & (n >= LEAST_ROWS) & (length >= LEAST_S) & (covered >= share * length) & ~F.coalesce(f"{side}_bad", F.lit(True))
        made |= {f"{side}_peak_rate": F.try_divide(F.col(f"{side}_peaks") * 60.0, covered), f"{side}_mean_phasic": F.col(f"{side}_phasic"), f"{side}_mean_tonic": F.col(f"{side}_tonic")}
    out = out.where(good).select("track", "key", "decision", "t", "enter", "exit", *(v.alias(k) for k, v in made.items()))
    return out.select("*", *((F.col(f"after_{m}") - F.col(f"before_{m}")).alias(f"delta_{m}") for m in METRICS))


def adjusted(items: DataFrame, keys: list[str]) -> DataFrame:
    """``items`` (keys, track, in_a, v) of walks that have both sides, centred on their walk and moved to the mean of all."""
    walk, whole = Window.partitionBy(*keys, "track"), Window.partitionBy(*keys)
    both = items.withColumn("_sides", F.min("in_a").over(walk) != F.max("in_a").over(walk)).where("_sides").drop("_sides")
    return both.withColumn("v", F.col("v") - F.avg("v").over(walk) + F.avg("v").over(whole))


@lru_cache(maxsize=256)
def _subsets(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.int64).reshape(math.comb(n, k), k)


def _side_sums(rng: np.random.Generator, v: np.ndarray, k: int) -> np.ndarray:
    """The sums of k of the values under ``PERMUTATIONS`` permutations: where there are fewer choices of k, each is summed once and they are drawn from."""
    if math.comb(v.size, k) <= PERMUTATIONS:
        sums = v[_subsets(v.size, k)].sum(axis=1)
        return sums[rng.integers(0, sums.size, PERMUTATIONS)]
    out, rows = np.empty(PERMUTATIONS), max(1, 1_000_000 // v.size)
    for i in range(0, PERMUTATIONS, rows):
        part = out[i : i + rows]
        part[:] = rng.permuted(np.broadcast_to(v, (part.size, v.size)), axis=1)[:, :k].sum(axis=1)
    return out


#: Tests whose sums a task holds at once; more are handed on in parts.
HELD = 200


def _permuted(keys: list[str], seed: int):
    """A task's walks (rows by keys and track, a walk's together) added up: for each test one row with the sums of side a over all permutations."""

    def run(batches):
        held: dict[tuple, list] = {}
        schema = None

        def add(walk: pa.Table):
            walk = walk.sort_by([("in_a", "ascending"), ("v", "ascending")])
            v, a = walk.column("v").to_numpy(), walk.column("in_a").to_numpy(zero_copy_only=False)
            test = tuple(walk.column(c)[0].as_py() for c in keys)
            own = zlib.crc32(repr([*test, walk.column("track")[0].as_py()]).encode())
            rng, n = np.random.default_rng([seed, own]), int(a.sum())
            row = held.setdefault(test, [0, 0, 0, 0.0, 0.0, np.zeros(PERMUTATIONS)])
            for i, x in enumerate((n, v.size, 1, float(v[a].sum()), float(v.sum()))):
                row[i] += x
            row[5] += _side_sums(rng, v, n)

        def handed():
            rows = list(held.values())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            cols = {c: pa.array([t[i] for t in held], schema.field(c).type) for i, c in enumerate(keys)}
            cols |= {c: pa.array([r[i] for r in rows], kinds[i]) for i, c in enumerate(("n_a", "n", "walks", "sum_a", "total"))}
            out = pa.RecordBatch.from_pydict(cols | {"sums": pa.array([r[5] for r in rows], pa.list_(pa.float64()))})
            held.clear()
            return out

        rest = None  # the last walk goes on in the next batch, perhaps
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            schema, table = table.schema, table.combine_chunks()
            new = np.zeros(table.num_rows, bool)
            for c in (*keys, "track"):
                x = table.column(c)
                new[1:] |= pc.fill_null(pc.not_equal(x.slice(1), x.slice(0, table.num_rows - 1)), True).to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(new)
            for i, j in zip([0, *ends[:-1]], ends):
                add(table.slice(i, j - i))
                if len(held) >= HELD:
                    yield handed()
            rest = table.slice(ends[-1]) if ends.size else table
        if rest is not None:
            add(rest)
        if held:
            yield handed()

    return run


def permutation_tests(items: DataFrame, keys: list[str], seed: int = 1) -> DataFrame:
    """(keys, n_a, n_b, walks, mean_a, mean_b, p) of the difference of means, flags shuffled within walks; p is null with under two on a side.

    A task adds up the sums of its walks, so that what is written grows with tasks and tests, and not with walks.
    """
    kinds = ", ".join(f"{k} {dict(items.dtypes)[k]}" for k in keys)
    dealt = items.select(*keys, "track", "in_a", F.col("v").cast("double").alias("v")).repartition(*keys, "track").sortWithinPartitions(*keys, "track")
    parts = cut(dealt.mapInArrow(_permuted(keys, seed), f"{kinds}, n_a long, n long, walks long, sum_a double, total double, sums array<double>"))
    whole = parts.groupBy(*keys).agg(F.sum("n_a").alias("n_a"), (F.sum("n") - F.sum("n_a")).alias("n_b"), F.sum("walks").alias("walks"), F.sum("sum_a").alias("sum_a"), F.sum("total").alias("total"))
    each = parts.select(*keys, F.posexplode("sums").alias("i", "s")).groupBy(*keys, "i").agg(F.sum("s").alias("s"))  # combined before the shuffle: some thousand rows a test
    gap = lambda s: F.try_divide(s, F.col("n_a")) - F.try_divide(F.col("total") - s, F.col("n_b"))
    extreme = each.join(whole, keys).groupBy(*keys).agg(F.count_if(F.abs(gap(F.col("s"))) >= F.abs(gap(F.col("sum_a"))) - 1e-12).alias("extreme"))
    out = whole.join(extreme, keys)
    able = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    return out.select(*keys, "n_a", "n_b", "walks", F.try_divide("sum_a", "n_a").alias("mean_a"), F.try_divide(F.col("total") - F.col("sum_a"), F.col("n_b")).alias("mean_b"), F.when(able, (F.col("extreme") + 1) / (PERMUTATIONS + 1)).alias("p"))


def verdict(p: Column, q: Column) -> Column:
    return F.when(q < ALPHA, "supported").when(p < ALPHA, "suggestive").otherwise("none")


def _graded(tests: DataFrame, family: str) -> DataFrame:
    """With q over the tests of a family, and a verdict."""
    return benjamini_hochberg(tests, "p", family).withColumn("verdict", verdict(F.col("p"), F.col("q")))


def compare(records: DataFrame, seed: int = 1) -> DataFrame:
    """(phase, metric, contrast, n_a, n_b, walks, mean_a, mean_b, p, q, verdict) of turns, straights and controls, walk by walk.

    Baselines are only compared as changes. q is over the rows of a contrast.
    """
    rows = [(phase, m) for phase in ("before", "after", "delta") for m in METRICS if m != "mean_tonic" or phase == "delta"]
    values = F.explode(F.array(*(F.struct(F.lit(p).alias("phase"), F.lit(m).alias("metric"), F.col(f"{p}_{m}").alias("v")) for p, m in rows))).alias("x")
    pairs = F.explode(F.array(*(F.struct(F.lit(f"{a}-{b}").alias("contrast"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (("turn", "straight"), ("straight", "control"), ("turn", "control"))))).alias("c")
    long = records.select("track", "decision", values).select("track", "decision", "x.*", pairs).select("track", "phase", "metric", "v", "c.contrast", (F.col("decision") == F.col("c.a")).alias("in_a"), ((F.col("decision") == F.col("c.a")) | (F.col("decision") == F.col("c.b"))).alias("use"))
    keys = ["phase", "metric", "contrast"]
    return _graded(permutation_tests(adjusted(long.where("use").drop("use"), keys), keys, seed), "contrast")


def compare_with_road(records: DataFrame, seed: int = 1) -> DataFrame:
    """(metric, n_a, n_b, walks, mean_a, mean_b, p, q, verdict): junctions (a) against the road between them (b)."""
    both = lambda m: (F.col(f"before_{m}") + F.col(f"after_{m}")) / 2
    values = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), v.alias("v")) for n, v in (("mean_phasic", both("mean_phasic")), ("peak_rate", both("peak_rate")), ("change", F.col("delta_mean_phasic")))))).alias("x")
    long = records.select("track", (F.col("decision") != "control").alias("in_a"), values).select("track", "in_a", "x.*")
    tests = permutation_tests(adjusted(long, ["metric"]), ["metric"], seed)
    return _graded(tests.withColumn("_all", F.lit(1)), "_all").drop("_all")


def paired_tests(records: DataFrame, value: str, seed: int = 1) -> DataFrame:
    """One row (n, mean_difference, p): turns against straights of the same walk at the same junction, flags shuffled within each such group."""
    g = records.where(F.col("decision").isin("turn", "straight")).select("track", "key", (F.col("decision") == "turn").alias("in_a"), F.col(value).alias("v"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("in_a", "ascending"), ("v", "ascending")])
        v, a = table.column("v").to_numpy(), table.column("in_a").to_numpy(zero_copy_only=False)
        if a.all() or not a.any():
            return pa.table({"gap": pa.array([], pa.float64()), "gaps": pa.array([], pa.list_(pa.float64()))})
        own = zlib.crc32(repr([table.column(c)[0].as_py() for c in ("track", "key")]).encode())
        rng, n = np.random.default_rng([seed, own]), int(a.sum())
        sums = _side_sums(rng, v, n)
        gap = lambda s: s / n - (v.sum() - s) / (v.size - n)
        return pa.table({"gap": pa.array([float(gap(v[a].sum()))]), "gaps": pa.array([gap(sums)], pa.list_(pa.float64()))})

    each = cut(g.groupBy("track", "key").applyInArrow(run, "gap double, gaps array<double>"))
    whole = each.agg(F.count("*").alias("n"), F.sum("gap").alias("s"))
    sums = each.select(F.posexplode("gaps").alias("i", "g")).groupBy("i").agg(F.sum("g").alias("g"))
    extreme = sums.crossJoin(F.broadcast(whole)).agg(F.count_if(F.abs("g") >= F.abs("s") - 1e-12).alias("extreme"))  # one row
    able = F.col("n") >= 2
    return whole.crossJoin(F.broadcast(extreme)).select("n", F.when(able, F.col("s") / F.col("n")).alias("mean_difference"), F.when(able, (F.col("extreme") + 1) / (PERMUTATIONS + 1)).otherwise(1.0).alias("p"))


def _records(spark, d):
    """Passages at about every sixteenth row with an hour as a second, for the registered queries."""
    p = positions(spark, d).withColumn("t", F.col("t") / 3600)
    found = p.where("idx % 16 = 0").select("track", F.col("kind").alias("key"), F.when(F.col("idx") % 3 == 0, "turn").when(F.col("idx") % 3 == 1, "straight").otherwise("control").alias("decision"), "t", F.col("t").alias("enter"), F.col("t").alias("exit"))
    series = p.select("track", "t", F.col("value").alias("phasic"), (F.col("value") / 2).alias("tonic"), (F.col("value") > 60).alias("is_peak"))
    return responses(found, series, 240.0, share=0.3)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def _ways(spark, d):
    from .junction_turns import streets

    return streets(spark, d)


def _walked_records(spark, d):
    """Real passages and controls of the events' walk, five and a half hours as a second: an event every two seconds or so."""
    from .junction_turns import classified, street_walk, streets

    p = street_walk(spark, d).withColumn("t", F.col("t") / 20_000)
    found = cut(classified(p, streets(spark, d), with_controls=True)).select("track", "key", "decision", "t", "enter", "exit")
    series = p.select("track", "t", F.col("value").alias("phasic"), (F.col("value") / 2).alias("tonic"), (F.col("value") > 60).alias("is_peak"))
    return responses(found, series, 40.0, share=0.3)


#: The streets of ``junction_turns`` for the oracle: blocks of 60 m, 20 events each.
STREETS_SQL = POSITIONS_SQL + """, j AS (SELECT track, t, idx, row_number() OVER (PARTITION BY track ORDER BY t, idx) - 1 AS j FROM p),
b AS (SELECT DISTINCT track, j // 20 AS k, (track + (j // 20) * (j // 20)) % 3 <> 0 AS east FROM j),
k AS (SELECT *, coalesce(sum(CASE WHEN east THEN 60 ELSE 0 END) OVER w, 0) AS x, coalesce(sum(CASE WHEN east THEN 0 ELSE 60 END) OVER w, 0) AS y, track * 1000000 + k * 4 AS n,
  CASE WHEN east THEN 1 ELSE 0 END AS dx, CASE WHEN east THEN 0 ELSE 1 END AS dy FROM b WINDOW w AS (PARTITION BY track ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lines AS (SELECT track, n AS id, [[x, y], [x + dx * 12, y + dy * 12], [x + dx * 60, y + dy * 60]] AS q FROM k
  UNION ALL SELECT track, n + 1, [[x, y], [x - dy * 40, y - dx * 40]] FROM k WHERE (track + k) % 2 = 0
  UNION ALL SELECT track, n + 2, [[x + dx * 12, y + dy * 12], [x + dx * 12 - dy * 40, y + dy * 12 - dx * 40]] FROM k WHERE (track + k) % 3 = 0),
streets AS (SELECT id, list_transform(q, lambda c: {'lat': 51.0::DOUBLE + track % 1000 * 0.01::DOUBLE + c[2]::DOUBLE / 111320.0::DOUBLE, 'lon': -0.1::DOUBLE + c[1]::DOUBLE / (111320.0::DOUBLE * 0.62::DOUBLE)}) AS path FROM lines)"""

QUERIES = {
    "junction_nodes": lambda s, d: nodes(_ways(s, d)).select("key", "degree", F.size("ways").alias("n_ways")),
    "junction_merged": lambda s, d: merged(nodes(_ways(s, d))).select("key", "junction"),
    "junction_intervals": lambda s, d: _rounded(sample_intervals(positions(s, d))),
    "junction_responses": lambda s, d: _rounded(_records(s, d)),
    "junction_compare": lambda s, d: compare(_walked_records(s, d)),
    "junction_road": lambda s, d: compare_with_road(_walked_records(s, d)),
}
ORACLE_SQL = {
    "junction_nodes": f"""WITH {STREETS_SQL}, a AS (SELECT id, path, unnest(range(len(path))) AS i FROM streets),
n AS (SELECT id, CASE WHEN i = 0 OR i = len(path) - 1 THEN 1 ELSE 2 END AS d, printf('%.6f,%.6f', path[i + 1].lat, path[i + 1].lon) AS key FROM a)
SELECT key, sum(d)::BIGINT AS degree, count(DISTINCT id)::INT AS n_ways FROM n GROUP BY key HAVING count(DISTINCT id) >= 2""",
    "junction_intervals": f"""WITH {POSITIONS_SQL}, r AS (SELECT track, t, row_number() OVER (PARTITION BY track ORDER BY t) - 1 AS r, greatest(1, count(*) OVER (PARTITION BY track) // 200) AS step FROM p),
g AS (SELECT track, step, t - lag(t) OVER (PARTITION BY track ORDER BY r) AS gap FROM r WHERE r % step = 0), k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY gap) - 1 AS k, count(*) OVER (PARTITION BY track) AS m FROM g WHERE gap IS NOT NULL)
SELECT track, round(gap / step, 6) AS dt FROM k WHERE k = m // 2""",
    "junction_responses": f"""WITH {POSITIONS_SQL}, q AS (SELECT track, t / 3600 AS t, idx, kind, value FROM p),
r AS (SELECT track, t, row_number() OVER (PARTITION BY track ORDER BY t) - 1 AS r, greatest(1, count(*) OVER (PARTITION BY track) // 200) AS step FROM q),
gp AS (SELECT track, step, t - lag(t) OVER (PARTITION BY track ORDER BY r) AS gap FROM r WHERE r % step = 0), kk AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY gap) - 1 AS k, count(*) OVER (PARTITION BY track) AS m FROM gp WHERE gap IS NOT NULL),
dt AS (SELECT track, gap / step AS dt FROM kk WHERE k = m // 2),
f AS (SELECT track, kind AS key, t, CASE idx % 3 WHEN 0 THEN 'turn' WHEN 1 THEN 'straight' ELSE 'control' END AS decision, lag(t) OVER w AS a, lead(t) OVER w AS b FROM q WHERE idx % 16 = 0 WINDOW w AS (PARTITION BY track ORDER BY t, kind)),
x AS (SELECT f.*, greatest(t - 240, coalesce((a + t) / 2, t - 240)) AS t0, least(t + 240, coalesce((t + b) / 2, t + 240)) AS t1, dt FROM f JOIN dt USING (track)),
y AS (SELECT x.track, x.key, x.t, x.decision, x.t - t0 AS lb, t1 - x.t AS la, dt, count(*) FILTER (q.t < x.t) AS nb, count(*) FILTER (q.t >= x.t) AS na, avg(q.value) FILTER (q.t < x.t) AS pb, avg(q.value) FILTER (q.t >= x.t) AS pa, count(*) FILTER (q.t < x.t AND q.value > 60) AS kb, count(*) FILTER (q.t >= x.t AND q.value > 60) AS ka
  FROM x JOIN q ON q.track = x.track AND q.t >= t0 AND q.t < t1 GROUP BY ALL),
z AS (SELECT *, CASE WHEN dt > 0 THEN least(lb, nb * dt) ELSE lb END AS cb, CASE WHEN dt > 0 THEN least(la, na * dt) ELSE la END AS ca FROM y),
o AS (SELECT *, kb * 60 / cb AS rb, ka * 60 / ca AS ra FROM z WHERE nb >= 5 AND na >= 5 AND lb >= 5 AND la >= 5 AND cb >= 0.3 * lb AND ca >= 0.3 * la)
SELECT track, key, decision, round(t, 6) AS t, round(t, 6) AS enter, round(t, 6) AS exit, round(rb, 6) AS before_peak_rate, round(pb, 6) AS before_mean_phasic, round(pb / 2, 6) AS before_mean_tonic, round(ra, 6) AS after_peak_rate, round(pa, 6) AS after_mean_phasic, round(pa / 2, 6) AS after_mean_tonic,
  round(ra - rb, 6) AS delta_peak_rate, round(pa - pb, 6) AS delta_mean_phasic, round(pa / 2 - pb / 2, 6) AS delta_mean_tonic FROM o""",
}
