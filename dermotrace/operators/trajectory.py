"""Trajectories: gates, smoothing by a constant-velocity Kalman filter, stops, reconstruction, simplification, path length.

The filter is a recurrence, so it runs in Arrow batches: recordings are split where fixes pause for long, the pieces are
dealt to partitions, and all pieces of a batch are stepped together as arrays of 4 x 4 matrices. What lies between fixes
is filled in by windows and expressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.tables import POSITIONS_SQL, positions
from .windows import by_time

#: Gates, noise and restarts of the filter (metres, seconds, metres a second, radians).
MAX_HDOP, MAX_SPEED, GATE, RESTART_S, GAP_S, JUMP_M, JUMP_MPS = 3.0, 3.0, 11.83, 10.0, 1.0, 50.0, 20.0
DOP_VARIANCE, PSD, SPEED_SIGMA, COURSE_SIGMA, COURSE_LEAST, START_SIGMA, CORRELATED_S = 10.0, 0.5, 0.3, math.radians(15), 0.6, 3.0, 3.0
KNOT_MPS = 1852 / 3600
#: A stop begins and ends at these knots, lasts so long, strays and moves no further than these metres (within seconds).
STOP_KTS, STOP_EXIT_KTS, STOP_S, STOP_AWAY_M, STOP_MOVE_M, STOP_WINDOW_S = 0.5, 1.0, 5.0, 10.0, 2.0, 5.0
#: Longest step of a curve between fixes, and how much faster it may be between fixes on a road.
GAP_M, SNAPPED_SPEED = 100.0, 4.0
#: A longer pause splits a recording: over it a walker may have gone kilometres, so that neither side tells of the other.
PAUSE_S = 600.0
#: Fixes stepped together, about.
BATCH = 100_000


def is_fix(lat: Column, lon: Column) -> Column:
    """Finite and in range."""
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180)


def gated(fixes: DataFrame, max_hdop: float = MAX_HDOP) -> DataFrame:
    """Fixes with an acceptable dilution (or none given) and a type of none, 0 or at least 2."""
    return fixes.where(is_fix(F.col("lat"), F.col("lon")) & (F.col("hdop").isNull() | (F.col("hdop") <= max_hdop)) & (F.col("fix_type").isNull() | (F.col("fix_type") == 0) | (F.col("fix_type") >= 2)))


def steps(df: DataFrame) -> DataFrame:
    """Metres, seconds and bearing from the row before; an impossible jump is over 50 m and 20 m/s."""
    lat, lon, w = F.col("lat"), F.col("lon"), by_time()
    d = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), lat, lon)
    out = df.withColumns({"step_m": d, "step_s": F.col("t") - F.lag("t").over(w), "bearing": geo.bearing(F.lag("lat").over(w), F.lag("lon").over(w), lat, lon)})
    return out.withColumn("jump", F.coalesce((F.col("step_m") > JUMP_M) & (F.col("step_m") > JUMP_MPS * F.col("step_s")), F.lit(False)))


def along(df: DataFrame) -> DataFrame:
    """Metres along the track up to each row."""
    return steps(df).withColumn("along_m", F.sum(F.coalesce("step_m", F.lit(0.0))).over(by_time().rowsBetween(Window.unboundedPreceding, 0)))


def path_summary(df: DataFrame) -> DataFrame:
    return steps(df).groupBy("track").agg(F.count("*").alias("n"), F.sum("step_m").alias("length_m"), F.count_if("jump").alias("jumps"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))


def is_plausible(metres: Column, seconds: Column, max_speed: float = MAX_SPEED, factor: Column | float = 1.0) -> Column:
    """No faster than the speed limit times the factor, and no further than a gap may be."""
    return F.coalesce((metres <= seconds * max_speed * factor) & (seconds > 0) & (metres <= GAP_M), F.lit(False))


def is_impossible_jump(metres: Column, seconds: Column) -> Column:
    return (metres > JUMP_M) & ((seconds <= 0) | (metres > JUMP_MPS * seconds))


def gap_factor(alpha_a: Column, alpha_b: Column) -> Column:
    """Between two fixes that both lie on a road, speeds may be higher."""
    return F.when((alpha_a > 0) & (alpha_b > 0), SNAPPED_SPEED).otherwise(1.0)


def variance(hacc: Column, pdop: Column, hdop: Column) -> Column:
    """Square metres: from the reported accuracy, else from the dilution (of positions, else horizontal, else 1)."""
    known = lambda c: F.when((c > 0) & (c < 50) & ~F.isnan(c), c)
    dop = F.greatest(F.lit(0.5), F.least(F.lit(10.0), F.coalesce(known(pdop), known(hdop), F.lit(1.0))))
    return F.coalesce(F.pow(known(hacc), F.lit(2)), DOP_VARIANCE * dop * dop)


def doppler(speed_kts: Column, course: Column) -> Column:
    """Struct (e, n, ee, en, nn): velocity with its covariance; about nothing at a slow speed, null without speed or course."""
    s, c = speed_kts * KNOT_MPS, F.radians(course)
    e, n = F.sin(c), F.cos(c)
    along, across = F.lit(SPEED_SIGMA**2), F.pow(s * COURSE_SIGMA, F.lit(2))
    slow = along + s * s
    row = lambda *v: F.struct(*(x.alias(k) for x, k in zip(v, ("e", "n", "ee", "en", "nn"), strict=True)))
    moving = row(s * e, s * n, along * e * e + across * n * n, (along - across) * e * n, along * n * n + across * e * e)
    return F.when(s.isNull() | F.isnan(s), None).when(s < COURSE_LEAST, row(F.lit(0.0), F.lit(0.0), slow, F.lit(0.0), slow)).when(course.isNotNull() & ~F.isnan(course), moving)


def pinned(t: np.ndarray, xy: np.ndarray, kts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions with every stop at its mean, number of the stop or -1).

    A stop lasts from a slow fix until the speed clearly rises or is missing, a fix strays from the stop's mean, or the
    fixes move on steadily, in which case it ends where that began.
    """
    out, number, n, i = xy.copy(), np.full(t.size, -1), 0, 0
    slow = np.flatnonzero(kts <= STOP_KTS)
    while (k := np.searchsorted(slow, i)) < slow.size:
        i = int(slow[k])
        total, first, end, j = xy[i].copy(), i, None, i + 1
        while j < t.size and kts[j] <= STOP_EXIT_KTS:
            if np.hypot(*(xy[j] - total / (j - i))) > STOP_AWAY_M:
                break
            while t[j] - t[first] > STOP_WINDOW_S:
                first += 1
            if np.hypot(*(xy[j] - xy[first])) > STOP_MOVE_M:
                end = first
                break
            total += xy[j]
            j += 1
        end = j if end is None else end
        if end > i and t[end - 1] - t[i] >= STOP_S:
            out[i:end], number[i:end], n = xy[i:end].mean(axis=0), n, n + 1
        i = j
    return out, number


def kalman(t: np.ndarray, xy: np.ndarray, r: np.ndarray, first: np.ndarray, v: np.ndarray | None = None, max_speed: float = MAX_SPEED) -> tuple[np.ndarray, np.ndarray]:
    """(smoothed states east, north and their velocities; rejected) of pieces that begin at the places ``first``.

    Positions enter with variance ``r`` (more where fixes come faster than errors change), velocities with (e, n, ee, en,
    nn) or NaN; what is further off than the gate is rejected. After rejections that span ten seconds, fixes no more than
    a second apart, the filter begins anew at the first of them. A backward pass smooths each stretch.
    """
    n, ends = t.size, np.append(first[1:], t.size)
    q = PSD * (max_speed / 3) ** 2
    xf, pf, xp, pp = np.zeros((n, 4)), np.zeros((n, 4, 4)), np.zeros((n, 4)), np.zeros((n, 4, 4))
    starts, rejected = np.zeros(n, bool), np.zeros(n, bool)
    starts[first] = True
    gap = np.diff(t, prepend=t[:1])
    x, p = np.zeros((first.size, 4)), np.zeros((first.size, 4, 4))
    at, run, since = first.copy(), np.zeros(first.size, np.int64), first.copy()

    def update(rows: np.ndarray, part: slice, z: np.ndarray, noise: np.ndarray) -> np.ndarray:
        """Gated update of two of the four states; which rows took it."""
        s = p[rows, part, part] + noise
        miss = z - x[rows, part]
        det = s[:, 0, 0] * s[:, 1, 1] - s[:, 0, 1] * s[:, 1, 0]
        inverse = np.stack((s[:, 1, 1], -s[:, 0, 1], -s[:, 1, 0], s[:, 0, 0]), axis=1).reshape(-1, 2, 2) / det[:, None, None]
        ok = np.einsum("bi,bij,bj->b", miss, inverse, miss) <= GATE
        rows, gain = rows[ok], p[rows[ok], :, part] @ inverse[ok]
        x[rows] += np.einsum("bij,bj->bi", gain, miss[ok])
        new = p[rows] - gain @ p[rows, part, :]
        p[rows] = (new + new.transpose(0, 2, 1)) / 2
        return ok

    live = np.arange(first.size)
    while live.size:
        i = at[live]
        again = (run[live] > 0) & (t[np.maximum(i - 1, 0)] - t[since[live]] >= RESTART_S)
        if again.any():
            back = live[again]
            at[back] = since[back]
            starts[at[back]] = True
            i = at[live]
        fresh = again | (i == first[live])
        new, old = live[fresh], live[~fresh]
        if new.size:
            x[new] = 0
            x[new, :2] = xy[at[new]]
            p[new] = np.eye(4) * START_SIGMA**2
            p[new, 0, 0] = p[new, 1, 1] = r[at[new]]
            run[new] = 0
            rejected[at[new]] = False
        if old.size:
            j, dt = at[old], np.maximum(0.0, gap[at[old]])
            step = np.tile(np.eye(4), (old.size, 1, 1))
            step[:, 0, 2] = step[:, 1, 3] = dt
            x[old, :2] += x[old, 2:] * dt[:, None]
            p[old] = step @ p[old] @ step.transpose(0, 2, 1)
            for k in (0, 1):
                p[old, k, k] += q * dt**3 / 3
                p[old, k, k + 2] += q * dt**2 / 2
                p[old, k + 2, k] += q * dt**2 / 2
                p[old, k + 2, k + 2] += q * dt
        xp[i], pp[i] = x[live], p[live]
        if old.size:
            noise = np.zeros((old.size, 2, 2))
            noise[:, 0, 0] = noise[:, 1, 1] = r[j] * np.maximum(1, CORRELATED_S / np.maximum(gap[j], 0.01))
            ok = update(old, slice(0, 2), xy[j], noise)
            rejected[j] = ~ok
            run[old[ok]] = 0
            off = old[~ok]
            apart = (run[off] == 0) | (gap[at[off]] > GAP_S)
            since[off[apart]] = at[off[apart]]
            run[off[apart]] = 0
            run[off] += 1
        if v is not None:
            some = live[~np.isnan(v[i, 0])]
            if some.size:
                w = v[at[some]]
                update(some, slice(2, 4), w[:, :2], np.stack((w[:, 2], w[:, 3], w[:, 3], w[:, 4]), axis=1).reshape(-1, 2, 2))
        xf[i], pf[i] = x[live], p[live]
        at[live] += 1
        live = live[at[live] < ends[live]]
    smooth = xf.copy()
    at = ends - 2
    live = np.flatnonzero(at >= first)
    while live.size:
        k = at[live]
        k = k[~starts[k + 1]]
        if k.size:
            dt = np.maximum(0.0, gap[k + 1])
            step = np.tile(np.eye(4), (k.size, 1, 1))
            step[:, 0, 2] = step[:, 1, 3] = dt
            gain = np.linalg.solve(pp[k + 1] + 1e-12 * np.eye(4), step @ pf[k]).transpose(0, 2, 1)
            smooth[k] = xf[k] + np.einsum("bij,bj->bi", gain, smooth[k + 1] - xp[k + 1])
        at[live] -= 1
        live = live[at[live] >= first[live]]
    return smooth, rejected


def simplify(xy: np.ndarray, tolerance: float, forced: np.ndarray | None = None) -> np.ndarray:
    """Which points Ramer, Douglas and Peucker keep; forced ones stay and split the line."""
    keep = np.zeros(len(xy), bool)
    keep[[0, -1]] = True
    if forced is not None:
        keep |= forced
    if tolerance <= 0.001 or len(xy) < 3:
        return np.ones(len(xy), bool)
    fixed = np.flatnonzero(keep)
    stack = list(zip(fixed[:-1].tolist(), fixed[1:].tolist(), strict=True))
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d, p = xy[b] - xy[a], xy[a + 1 : b] - xy[a]
        size = d @ d
        s = np.clip(p @ d / size, 0, 1) if size > 0 else np.zeros(len(p))
        off = np.hypot(*(p - s[:, None] * d).T)
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


_OUT = ("lat", "lon", "v_east", "v_north", "rejected", "vertex", "stop")


def _smoothed(batches: Iterator[pa.RecordBatch], max_speed: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (track, piece, t, idx): all whole pieces of some batches are filtered together."""

    def done(table: pa.Table) -> pa.RecordBatch:
        col = lambda c: table.column(c).to_numpy()
        t, lat, lon, kts = (col(c).astype(float) for c in ("t", "lat", "lon", "speed_kts"))
        key = np.stack((col("track"), col("piece")))
        first = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        own = np.repeat(np.arange(first.size), np.diff(np.append(first, t.size)))
        k = geo.DEGREE_M * np.cos(np.radians(lat[first]))[own]
        xy = np.column_stack(((lon - lon[first][own]) * k, (lat - lat[first][own]) * geo.DEGREE_M))
        stop = np.full(t.size, -1)
        for a, b in zip(first, np.append(first[1:], t.size), strict=True):
            if b - a > 1 and (kts[a:b] <= STOP_KTS).any():
                xy[a:b], stop[a:b] = pinned(t[a:b], xy[a:b], kts[a:b])
        v = np.stack([col(c).astype(float) for c in ("v_e", "v_n", "v_ee", "v_en", "v_nn")], axis=1)
        s, rejected = kalman(t, xy, col("r").astype(float), first, v, max_speed)
        forced, vertex = col("forced").astype(bool), np.zeros(t.size, bool)
        for a, b in zip(first, np.append(first[1:], t.size), strict=True):
            vertex[a:b] = simplify(s[a:b, :2], tolerance, forced[a:b])
        made = [pa.array(s[:, 1] / geo.DEGREE_M + lat[first][own]), pa.array(s[:, 0] / k + lon[first][own]), pa.array(s[:, 2]), pa.array(s[:, 3]), pa.array(rejected), pa.array(vertex), pa.array(stop, pa.int32(), mask=stop < 0)]
        return pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("track", "t", "idx", "piece")), *made], ["track", "t", "idx", "piece", *_OUT])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BATCH:
            table = pa.Table.from_batches(held).combine_chunks()
            key = np.stack((table.column("track").to_numpy(), table.column("piece").to_numpy()))
            last = int(np.argmax((key == key[:, -1:]).all(axis=0)))
            if last:
                yield done(table.slice(0, last))
            held = table.slice(last).to_batches()
            rows = table.num_rows - last
    if rows:
        yield done(pa.Table.from_batches(held).combine_chunks())


def filtered(fixes: DataFrame, max_speed: float = MAX_SPEED, tolerance_m: float = 2.0, pause_s: float = PAUSE_S) -> DataFrame:
    """(track, t, idx, piece, lat, lon, v_east, v_north, rejected, vertex, stop) of the fixes that pass the gates.

    ``fixes`` has track (long), t, idx, lat, lon and, where known, hdop, pdop, hacc, fix_type, speed_kts, course_deg and
    ``forced`` (a vertex that must stay). Pieces begin after a pause of more than ``pause_s``.
    """
    missing = {c: F.lit(None).cast("double") for c in ("hdop", "pdop", "hacc", "fix_type", "speed_kts", "course_deg") if c not in fixes.columns}
    missing |= {} if "forced" in fixes.columns else {"forced": F.lit(False)}
    g = gated(fixes.withColumns(missing) if missing else fixes)
    w = by_time()
    piece = F.sum(F.when(F.col("t") - F.lag("t").over(w) > pause_s, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    v = doppler(F.col("speed_kts"), F.col("course_deg"))
    rows = g.select("track", "t", "idx", "lat", "lon", "speed_kts", "forced", piece.alias("piece"), variance(F.col("hacc"), F.col("pdop"), F.col("hdop")).alias("r"), v.alias("v"))
    rows = rows.select("*", *(F.col(f"v.{c}").alias(f"v_{c}") for c in ("e", "n", "ee", "en", "nn"))).drop("v")
    dealt = rows.repartition("track", "piece").sortWithinPartitions("track", "piece", "t", "idx")
    schema = "track long, t double, idx long, piece long, lat double, lon double, v_east double, v_north double, rejected boolean, vertex boolean, stop int"
    return dealt.mapInArrow(lambda batches: _smoothed(batches, max_speed, tolerance_m), schema)


def snapped(path: DataFrame, roads: DataFrame) -> DataFrame:
    """``path`` moved towards the road points (track, idx, road_lat, road_lon, alpha), by alpha."""
    a = F.coalesce(F.when((F.col("alpha") > 0) & F.col("road_lat").isNotNull() & F.col("road_lon").isNotNull(), F.col("alpha")), F.lit(0.0))
    joined = path.join(roads.select("track", "idx", "road_lat", "road_lon", "alpha"), ["track", "idx"], "left")
    mix = lambda c: F.when(a > 0, a * F.col(f"road_{c}") + (1 - a) * F.col(c)).otherwise(F.col(c))
    return joined.withColumns({"lat": mix("lat"), "lon": mix("lon"), "alpha": a}).drop("road_lat", "road_lon")


def reconstructed(rows: DataFrame, path: DataFrame, max_speed: float = MAX_SPEED) -> DataFrame:
    """(track, t, idx, lat, lon) of every row, between the filtered fixes of ``path``: null before the first, after the last and across jumps.

    A cubic curve through both fixes' velocities where each step of it is plausible, else a line by time.
    """
    alpha = F.col("alpha") if "alpha" in path.columns else F.lit(0.0)
    fix = path.select("track", "idx", F.struct("t", "lat", "lon", "v_east", "v_north", alpha.alias("alpha")).alias("_fix"))
    w = by_time()
    r = rows.select("track", "t", "idx").join(fix, ["track", "idx"], "left")
    back = Window.partitionBy("track").orderBy(F.desc("t"), F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumns({"_a": F.last("_fix", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.last("_fix", True).over(back), "_gap": F.count("_fix").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    a, b = (lambda c: F.col(f"_a.{c}")), (lambda c: F.col(f"_b.{c}"))
    gap = b("t") - a("t")
    s = F.when(gap > 0, (F.col("t") - a("t")) / gap).otherwise(0.0)
    chord = F.sqrt(F.pow(b("lat") - a("lat"), F.lit(2)) + F.pow(b("lon") - a("lon"), F.lit(2)))
    mid = geo.lon_degree_m((a("lat") + b("lat")) / 2)

    def tangent(end, c: str) -> Column:
        """Degrees a second, no larger than the chord's own mean velocity."""
        v_lat, v_lon = end("v_north") / geo.DEGREE_M, end("v_east") / mid
        size, limit = F.sqrt(v_lat * v_lat + v_lon * v_lon), F.try_divide(chord, gap)
        return (v_lat if c == "lat" else v_lon) * F.when(size > limit, F.try_divide(limit, size)).otherwise(1.0)

    def curve(c: str) -> Column:
        """Hermite: the ends' positions and tangents, weighted by cubics of the share of the time."""
        u = 1 - s
        return a(c) * u * u * (1 + 2 * s) + b(c) * s * s * (3 - 2 * s) + gap * (tangent(a, c) * s * u * u - tangent(b, c) * s * s * u)

    r = r.withColumns({"_lat": curve("lat"), "_lon": curve("lon")})
    inside = Window.partitionBy("track", "_gap")
    here = inside.orderBy("t", "idx")
    is_fix_row = F.col("_fix").isNotNull()
    own = lambda c: F.when(is_fix_row, F.col(f"_fix.{c}")).otherwise(F.col(f"_{c}"))
    r = r.withColumns({"_y": own("lat"), "_x": own("lon")})
    factor = gap_factor(a("alpha"), b("alpha"))
    before = geo.haversine(F.lag("_y").over(here), F.lag("_x").over(here), F.col("_y"), F.col("_x"))
    to_end = geo.haversine(F.col("_y"), F.col("_x"), b("lat"), b("lon"))
    step_ok = is_fix_row | is_plausible(before, F.col("t") - F.lag("t").over(here), max_speed, factor)
    last_ok = F.lead("t").over(here).isNotNull() | is_fix_row | is_plausible(to_end, b("t") - F.col("t"), max_speed, factor)
    r = r.withColumn("_ok", step_ok & last_ok & F.coalesce(chord > 0, F.lit(False)) & a("v_east").isNotNull() & b("v_east").isNotNull())
    r = r.withColumn("_smooth", F.min(F.coalesce(F.col("_ok") | is_fix_row, F.lit(False))).over(inside))
    jump = F.coalesce(is_impossible_jump(geo.haversine(a("lat"), a("lon"), b("lat"), b("lon")), gap), F.lit(True))
    line = lambda c: a(c) + s * (b(c) - a(c))
    made = lambda c: F.when(is_fix_row, F.col(f"_fix.{c}")).when(jump, None).when(F.col("_smooth"), F.col(f"_{c}")).otherwise(line(c)).alias(c)
    return r.select("track", "t", "idx", made("lat"), made("lon"))


def thinned(df: DataFrame, step: int, forced: Column | None = None) -> DataFrame:
    """Every ``step``-th row of a track from its first, its last, and the forced ones."""
    w = by_time()
    keep = ((F.row_number().over(w) - 1) % step == 0) | F.lead("t").over(w).isNull()
    return df.withColumn("_keep", keep if forced is None else keep | forced).where("_keep").drop("_keep")


def spaced(df: DataFrame, least_m: float) -> DataFrame:
    """Rows at least ``least_m`` from the last one kept; the first and the last stay. One Arrow group a track: each choice rests on the one before."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("t", "ascending"), ("idx", "ascending")])
        lat, lon = table.column("lat").to_numpy(), table.column("lon").to_numpy()
        kept = [0]
        for i in range(1, lat.size):
            k = math.cos(math.radians(lat[kept[-1]]))
            if i == lat.size - 1 or math.hypot(lat[i] - lat[kept[-1]], (lon[i] - lon[kept[-1]]) * k) * geo.DEGREE_M >= least_m:
                kept.append(i)
        return table.take(kept)

    rows = df.select("track", "t", "idx", "lat", "lon").where(is_fix(F.col("lat"), F.col("lon")))
    return rows.groupBy("track").applyInArrow(run, rows.schema)


def _fixes(spark, d):
    """Positions with an hour as a second, and derived accuracy, speed and course."""
    p = positions(spark, d)
    lat = F.lit(51.5) + (F.col("lat") - 51.5) * 0.01 + F.col("t") / 3.6e6 % 1 * 0.002
    extra = {"t": F.col("t") / 3600, "lat": lat, "lon": F.lit(-0.1) + (F.col("lon") + 0.1) * 0.01, "hacc": F.when(F.col("idx") % 3 == 0, 2.0 + F.col("idx") % 5), "hdop": 0.8 + (F.col("idx") % 30) / 10.0, "pdop": F.lit(None).cast("double"), "fix_type": (F.col("idx") % 4).cast("int"), "speed_kts": F.when(F.col("idx") % 6 != 0, (F.col("idx") % 8) / 4.0), "course_deg": (F.col("idx") * 37 % 360).cast("double")}
    return p.withColumns(extra)


QUERIES = {
    "path_along": lambda s, d: along(positions(s, d)).select("track", "idx", F.round("along_m", 3).alias("along_m"), F.round("bearing", 3).alias("bearing"), "jump"),
    "path_summary": lambda s, d: path_summary(positions(s, d)).select("track", "n", F.round("length_m", 3).alias("length_m"), "jumps", *(F.round(c, 6).alias(c) for c in ("south", "north", "west", "east"))),
    "path_filtered": lambda s, d: filtered(_fixes(s, d)),
    "path_reconstructed": lambda s, d: reconstructed(_fixes(s, d), filtered(_fixes(s, d))),
    "path_gates": lambda s, d: gated(_fixes(s, d)).select("track", "idx", F.round(variance(F.col("hacc"), F.col("pdop"), F.col("hdop")), 6).alias("variance"), *(F.round(doppler(F.col("speed_kts"), F.col("course_deg"))[c], 8).alias(f"v_{c}") for c in ("e", "n", "ee", "en", "nn"))),
    "path_thinned": lambda s, d: thinned(positions(s, d), 10, F.col("kind") == "purchase").select("track", "idx"),
    "path_spaced": lambda s, d: spaced(positions(s, d), 300.0).select("track", "idx"),
}
_STEPS = f"""{POSITIONS_SQL}, l AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, t - lag(t) OVER w AS dt FROM p WINDOW w AS (PARTITION BY track ORDER BY t, idx)),
s AS (SELECT *, 2 * 6371000 * asin(sqrt(least(1, sin(radians(lat - la) / 2) ** 2 + cos(radians(la)) * cos(radians(lat)) * sin(radians(lon - lo) / 2) ** 2))) AS m,
  degrees(atan2(sin(radians(lon - lo)) * cos(radians(lat)), cos(radians(la)) * sin(radians(lat)) - sin(radians(la)) * cos(radians(lat)) * cos(radians(lon - lo)))) AS b FROM l)"""
ORACLE_SQL = {
    "path_gates": f"""WITH {POSITIONS_SQL}, g AS (SELECT track, idx, CASE WHEN idx % 3 = 0 THEN 2.0 + idx % 5 END::double AS hacc, 0.8::double + (idx % 30) / 10.0::double AS hdop, idx % 4 AS ft, CASE WHEN idx % 6 != 0 THEN (idx % 8) / 4.0 END::double * 1852 / 3600 AS s, radians(idx * 37 % 360) AS c FROM p),
k AS (SELECT *, CASE WHEN s < 0.6 THEN 0.09::double + s * s END AS slow, (s * radians(15)) ** 2 AS b FROM g WHERE hdop <= 3 AND (ft = 0 OR ft >= 2))
SELECT track, idx, round(coalesce(hacc * hacc, 10 * greatest(0.5, least(10, hdop)) ** 2), 6) AS variance, round(CASE WHEN s < 0.6 THEN 0 ELSE s * sin(c) END, 8) AS v_e, round(CASE WHEN s < 0.6 THEN 0 ELSE s * cos(c) END, 8) AS v_n,
  round(coalesce(slow, 0.09::double * sin(c) ** 2 + b * cos(c) ** 2), 8) AS v_ee, round(CASE WHEN s < 0.6 THEN 0 ELSE (0.09::double - b) * sin(c) * cos(c) END, 8) AS v_en, round(coalesce(slow, 0.09::double * cos(c) ** 2 + b * sin(c) ** 2), 8) AS v_nn FROM k""",
    "path_thinned": f"WITH {POSITIONS_SQL}, n AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY track) AS n FROM p WINDOW w AS (PARTITION BY track ORDER BY t, idx)) SELECT track, idx FROM n WHERE (r - 1) % 10 = 0 OR r = n OR kind = 'purchase'",
    "path_spaced": f"""WITH RECURSIVE {POSITIONS_SQL}, n AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY track) AS n FROM p WINDOW w AS (PARTITION BY track ORDER BY t, idx)),
g AS (SELECT track, r, idx, lat AS y, lon AS x, true AS ok FROM n WHERE r = 1
  UNION ALL SELECT track, r, idx, CASE WHEN ok THEN lat ELSE y END, CASE WHEN ok THEN lon ELSE x END, ok FROM (SELECT n.track, n.r, n.idx, n.lat, n.lon, g.y, g.x, n.r = n.n OR sqrt((n.lat - g.y) ** 2 + ((n.lon - g.x) * cos(radians(g.y))) ** 2) * 111320 >= 300 AS ok FROM g JOIN n ON n.track = g.track AND n.r = g.r + 1))
SELECT track, idx FROM g WHERE ok""",
    "path_along": f"""WITH {_STEPS} SELECT track, idx, round(sum(coalesce(m, 0)) OVER (PARTITION BY track ORDER BY t, idx ROWS UNBOUNDED PRECEDING), 3) AS along_m,
round((b + 360) % 360, 3) AS bearing, coalesce(m > 50 AND m > 20 * dt, false) AS jump FROM s""",
    "path_summary": f"""WITH {_STEPS} SELECT track, count(*) AS n, round(sum(m), 3) AS length_m, count(*) FILTER (m > 50 AND m > 20 * dt) AS jumps,
round(min(lat), 6) AS south, round(max(lat), 6) AS north, round(min(lon), 6) AS west, round(max(lon), 6) AS east FROM s GROUP BY track""",
}
