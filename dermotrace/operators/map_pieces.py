"""Map matching in pieces: a hidden Markov model whose track may be spread over tasks.

A track of up to ``WHOLE`` points is matched in one task, a longer one in pieces. A piece is a window of ``WIDTH`` points.
From its first point's candidates to its last point's it is a matrix in the (max, +) algebra, at most ``CANDIDATES``
squared, made by itself from its candidates and the roads around them. A track's matrices are folded, which fixes the
candidates at the pieces' ends, and each piece is then traced between its ends. The result is that of one pass: a route is
searched no further than ``ROUTE_M``, and a piece has all roads that close, so that no step knows in which piece it is.

Points are shuffled, never their candidates: units (tracks or pieces) that begin in one cell go to a task with the roads
around them, each place of a road once with the names it has, and many units' steps are weighed and walked together.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.lineage import cut, written
from .spatial import BETA_M, BREAK_M, BREAK_S, CANDIDATES, LOST_M, SEARCH_M, SIGMA_M, candidates, dealt, segments  # noqa: F401
from .windows import by_time

WIDTH = 512
#: Points of a track that one task holds, and of units from one cell that go to a task together; rows that it steps through together; pairs that it weighs at a time; side of a cell in it (metres).
WHOLE, PLACE, BATCH, PAIRS, CELL_M = 4096, 16_384, 16_384, 1 << 17, 2 * SEARCH_M
#: Chord of a heading (metres, points looked at), angles without penalty and of its width (degrees), its most, slack of a route (metres), speed without a reading, margins of speed and way.
CHORD_M, CHORD_POINTS, DEAD_DEG, WIDTH_DEG, MOST_PENALTY, SLACK_M, SPEED_MS, MARGIN_MS, MARGIN_M = 6.0, 8, 10.0, 20.0, 6.0, 20.0, 3.0, 1.0, 5.0
#: A longer route counts as none.
ROUTE_M = 400.0


def headed(points: DataFrame) -> DataFrame:
    """``points`` with their heading: the bearing from the nearest point at least ``CHORD_M`` behind to the nearest as far ahead; a side without one is the point itself; null if both are.

    Each distance is taken once, from the point behind; sides are columns before they are used, or each mention finds them anew.
    """
    w, chord = by_time(), range(1, CHORD_POINTS + 1)
    at = points.withColumns({f"_{c}{k}": F.lead(c, k).over(w) for c in ("lat", "lon") for k in chord})
    at = at.withColumns({f"_far{k}": geo.haversine(F.col("lat"), F.col("lon"), F.col(f"_lat{k}"), F.col(f"_lon{k}")) >= CHORD_M for k in chord})
    back = {(c, k): F.col(f"_{c}_{k}") for c in ("lat", "lon", "far") for k in chord}
    at = at.withColumns({f"_{c}_{k}": F.lag(f"_far{k}" if c == "far" else c, k).over(w) for c, k in back})
    a, b = ([F.coalesce(*(F.when(far(k), place(c, k)) for k in chord), F.col(c)) for c in ("lat", "lon")] for far, place in ((lambda k: back["far", k], lambda c, k: back[c, k]), (lambda k: F.col(f"_far{k}"), lambda c, k: F.col(f"_{c}{k}"))))
    ends = at.select(*points.columns, *(c.alias(n) for c, n in zip((*a, *b), ("_a_lat", "_a_lon", "_b_lat", "_b_lon"), strict=True)))
    chord_ = [F.col(c) for c in ("_a_lat", "_a_lon", "_b_lat", "_b_lon")]
    return ends.select(*points.columns, F.when(geo.haversine(*chord_) >= CHORD_M, geo.bearing(*chord_)).alias("heading"))


def _roads_near(points: DataFrame, segs: DataFrame, by: tuple[str, ...] = ("track", "piece"), also: tuple[str, ...] = ()) -> DataFrame:
    """(by, a_lat, a_lon, b_lat, b_lon, also) of all segments that a route from a piece's candidates can reach, by cells."""
    size = ROUTE_M + SEARCH_M
    segs = segs.select("a_lat", "a_lon", "b_lat", "b_lon", *also).distinct()  # ways on one another are one road of the graph
    band = geo.band_of(F.col("lat"), size)
    cells = points.select(*by, band.alias("cy"), geo.column_of(F.col("lon"), band, size).alias("cx")).distinct()
    return cells.join(dealt(segs, size, size), ["cy", "cx"]).drop("cy", "cx").distinct()


def _node(lat: float, lon: float) -> tuple[float, float]:
    return round(lat, 6), round(lon, 6)


def _metres(a_lat: float, a_lon: float, b_lat: float, b_lon: float) -> float:
    return math.hypot((b_lat - a_lat) * geo.DEGREE_M, float(_short(b_lon - a_lon)) * geo.DEGREE_M * math.cos(math.radians(a_lat)))


def _short(degrees: np.ndarray) -> np.ndarray:
    """A difference of longitudes, the short way round."""
    return degrees - 360 * np.rint(degrees / 360)


def _hypot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.hypot, x.tolist(), y.tolist()), float, x.size)  # numpy's own differs in the last digit, which decides between places at one node


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number within it) of rows of which each owner has so many."""
    owner = np.repeat(np.arange(counts.size), counts)
    return owner, np.arange(owner.size) - np.repeat(np.cumsum(counts) - counts, counts)


def _slices(counts: np.ndarray) -> Iterator[slice]:
    """Owners side by side that have ``PAIRS`` rows at most, or one that has more."""
    total, at = np.append(0, np.cumsum(counts)), 0
    while at < counts.size:
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
        yield slice(at, to)
        at = to


def _band_columns(band: np.ndarray) -> np.ndarray:
    """``geo.band_columns`` of cells of ``CELL_M``."""
    step = CELL_M / geo.DEGREE_M
    edge = np.minimum(90.0, np.maximum(np.abs(band * step), np.abs((band + 1) * step)))
    return np.maximum(1, np.floor(360 * np.cos(np.radians(edge)) / step).astype(np.int64))


#: Columns that a road's row has its ends in; its bearing is its heading.
_ENDS = ("lat", "lon", "t", "speed")
_POINT = ["track", "t", "idx", "lat", "lon", "speed", "heading"]
#: The number of a way without one.
_NO_WAY = -(1 << 63)
_PLACED = pa.schema([("track", pa.int64()), ("idx", pa.int64()), ("way", pa.int64()), ("seg", pa.int32()), ("lat", pa.float64()), ("lon", pa.float64()), ("off_m", pa.float64())])
_OUT = "track long, idx long, way long, seg int, lat double, lon double, off_m double"


class _Roads:
    """Segments, each place once with its names in order, and the graph of their ends."""

    def __init__(self, rows: pa.Table):
        once: dict[tuple, int] = {}
        for i, place in enumerate(zip(*(rows.column(c).to_pylist() for c in _ENDS), strict=True)):
            once.setdefault(place, i)
        rows = rows.take(pa.array(once.values(), pa.int64()))
        self.a_lat, self.a_lon, self.b_lat, self.b_lon, self.bearing = (rows.column(c).to_numpy() for c in (*_ENDS, "heading"))
        names = rows.column("names").combine_chunks()
        self.copies, flat = pc.list_value_length(names).to_numpy(), names.flatten()
        way, seg = (pc.fill_null(flat.field(c), _NO_WAY if c == "way" else 0).to_numpy() for c in ("way", "seg"))
        order = np.lexsort((seg, way))
        fresh = np.append(True, (np.diff(way[order]) != 0) | (np.diff(seg[order]) != 0))[: way.size]
        self.way, self.seg = way[order][fresh], seg[order][fresh]
        self.name = np.empty(way.size, np.int32)  # a name's number is its rank
        self.name[order] = np.cumsum(fresh) - 1
        self.named = np.cumsum(self.copies) - self.copies
        ids: dict[tuple, int] = {}
        self.length, self.a, self.b = np.empty(len(once)), [], []
        self.graph: list[dict[int, float]] = []
        self.found: dict[int, tuple[float, dict[int, float]]] = {}
        for g, place in enumerate(once):
            a, b = (ids.setdefault(_node(*p), len(ids)) for p in (place[:2], place[2:]))
            self.graph += [{} for _ in range(len(ids) - len(self.graph))]
            self.length[g] = length = _metres(*place)
            self.a.append(a)
            self.b.append(b)
            self.graph[a][b] = min(length, self.graph[a].get(b, math.inf))
            self.graph[b][a] = min(length, self.graph[b].get(a, math.inf))

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """(cell, segment), sorted: a segment lies in the cells its box and reach touch, as in ``spatial.dealt``."""
        step, reach = CELL_M / geo.DEGREE_M, SEARCH_M + 1e-6
        low, high = (np.floor(x / step).astype(np.int64) for x in (np.minimum(self.a_lat, self.b_lat) - reach / geo.DEGREE_M, np.maximum(self.a_lat, self.b_lat) + reach / geo.DEGREE_M))
        of, k = _ragged(high - low + 1)
        band = low[of] + k
        across = _short(self.b_lon - self.a_lon)
        west, n = np.where(across >= 0, self.a_lon, self.b_lon)[of], _band_columns(band)
        wide = 360 / n * (reach / CELL_M)
        first, last = (np.floor((x + 180) / 360 * n).astype(np.int64) for x in (west - wide, west + np.abs(across)[of] + wide))
        at, k = _ragged(np.minimum(last, first + n - 1) - first + 1)
        cell = (band[at] << 32) + (first[at] + k) % n[at]
        order = np.argsort(cell, kind="stable")
        return cell[order], of[at][order]

    def near(self, lat: np.ndarray, lon: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, ...]:
        """(point, segment, metres, share, lat, lon) within reach, by point and distance: of each point those that are among its nearest."""
        cell, of = self.cells()
        band = np.floor(lat / (CELL_M / geo.DEGREE_M)).astype(np.int64)
        n = _band_columns(band)
        own = (band << 32) + np.floor((lon + 180) / 360 * n).astype(np.int64) % n
        low = np.searchsorted(cell, own)
        count = np.searchsorted(cell, own, "right") - low
        found = [self._within(of, some.start, lat[some], lon[some], scale[some], low[some], count[some]) for some in _slices(count)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _within(self, of: np.ndarray, start: int, lat: np.ndarray, lon: np.ndarray, scale: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """``near`` of some points, from the first of their segments by cells and how many there are."""
        point, k = _ragged(count)
        road = of[low[point] + k]
        # the terms and their order are those of geo.segment_projection
        y, x, s = lat[point], lon[point], scale[point]
        a_lat, a_lon, across = self.a_lat[road], self.a_lon[road], _short(self.b_lon - self.a_lon)[road]
        ax, ay, dx, dy = _short(a_lon - x) * s, (a_lat - y) * geo.DEGREE_M, across * s, (self.b_lat[road] - a_lat) * geo.DEGREE_M
        size = dx * dx + dy * dy
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(size > 0, np.maximum(0.0, np.minimum(1.0, -(ax * dx + ay * dy) / size)), 0.0)
        d = np.sqrt((ax + share * dx) ** 2 + (ay + share * dy) ** 2)
        order = np.flatnonzero(d <= SEARCH_M)
        order = order[np.lexsort((d[order], point[order]))]
        point, d = point[order], d[order]
        # names in front of a segment's: more than enough of them, and it can't be among the nearest
        before = np.cumsum(self.copies[road[order]]) - self.copies[road[order]]
        fresh = np.append(True, np.diff(point) != 0)[: point.size]
        tie = ~fresh & np.append(False, np.diff(d) == 0)[: point.size]
        nearer = np.maximum.accumulate(np.where(tie, 0, np.arange(point.size)))
        own = np.maximum.accumulate(np.where(fresh, np.arange(point.size), 0))
        keep = before[nearer] - before[own] < CANDIDATES
        order, point, d = order[keep], point[keep], d[keep]
        road, share = road[order], share[order]
        return point + start, road, d, share, self.a_lat[road] + share * (self.b_lat[road] - self.a_lat[road]), self.a_lon[road] + share * across[order]

    def _from(self, start: int, limit: float) -> dict[int, float]:
        best, queue = {start: 0.0}, [(0.0, start)]
        while queue:
            d, node = heapq.heappop(queue)
            if d > best[node]:
                continue
            for other, length in self.graph[node].items():
                if (n := d + length) <= limit and n < best.get(other, math.inf):
                    best[other] = n
                    heapq.heappush(queue, (n, other))
        return best

    def routes(self, p: np.ndarray, q: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Metres from either end of segment p to either end of q (a to a, a to b, b to a, b to b), where within the limit: pairs that recur are looked up once."""
        pairs, of = np.unique(p * len(self.a) + q, return_inverse=True)
        most = np.zeros(pairs.size)
        np.maximum.at(most, of, limit)
        reach: dict[int, float] = {}
        both = [divmod(x, len(self.a)) for x in pairs.tolist()]
        for (g, _), m in zip(both, most.tolist(), strict=True):
            for node in (self.a[g], self.b[g]):
                reach[node] = max(m, reach.get(node, 0.0))
        for node, m in reach.items():
            if node not in self.found or self.found[node][0] < m:
                self.found[node] = (m, self._from(node, m))
        out = [[self.found[e[g]][1].get(f[h], math.inf) for g, h in both] for e in (self.a, self.b) for f in (self.a, self.b)]
        return np.array(out).reshape(4, -1)[:, of]


class _Walks:
    """Points of some units, in order, with their candidates, cut into lanes that are stepped through together.

    A unit is a whole track or one piece of it. A lane has ``width`` steps of a unit at most; its first point is the last of
    the lane before. Arrays have candidates first and points or lanes last; missing candidates weigh nothing.
    """

    def __init__(self, rows: pa.Table, roads: _Roads, width: int):
        lat, lon, scale = (rows.column(c).to_numpy() for c in ("lat", "lon", "scale"))
        self.roads = roads
        point, road, self.d, self.share, self.s_lat, self.s_lon = roads.near(lat, lon, scale)
        heading = rows.column("heading")
        off = np.fmod(heading.to_numpy()[point] - roads.bearing[road], 180.0)
        off = np.where(off < 0, np.fmod(off + 180.0, 180.0), off)
        over = np.maximum(0.0, np.minimum(off, 180 - off) - DEAD_DEG) / WIDTH_DEG
        penalty = np.where(pc.is_null(heading).to_numpy()[point], 0.0, np.fmin(MOST_PENALTY, 0.5 * over * over))
        weight = -0.5 * (self.d / SIGMA_M) ** 2 - math.log(SIGMA_M * math.sqrt(2 * math.pi)) - penalty
        kept, self.n = np.unique(point, return_counts=True)  # points without a road near are passed over
        self.rows = rows.take(pa.array(kept))
        self.lat, self.lon = lat[kept], lon[kept]
        self.first = np.cumsum(self.n) - self.n
        self.road, point = road, np.repeat(np.arange(kept.size), self.n)
        self._ranked(point, weight)
        self._laned(width)
        if kept.size:
            self._stepped()

    def _ranked(self, point: np.ndarray, weight: np.ndarray) -> None:
        """Candidates of each point by distance and name: ``place`` counts its segments, ``name`` is the way's."""
        at, k = _ragged(self.roads.copies[self.road])
        name, of = self.roads.name[self.roads.named[self.road[at]] + k], point[at]
        tied = np.zeros(self.n.size, bool)
        tied[point[1:][(np.diff(point) == 0) & (np.diff(self.d) == 0)]] = True
        some = np.flatnonzero(tied[of])
        order = np.arange(at.size)
        order[some] = some[np.lexsort((name[some], self.d[at[some]], of[some]))]
        rank = np.arange(at.size) - np.searchsorted(of, np.arange(self.n.size))[of]
        few = np.flatnonzero(rank < CANDIDATES)
        where, order = (rank[few], of[few]), order[few]
        self.most = int(rank[few].max(initial=-1)) + 1
        self.place = np.zeros((self.most, self.n.size), np.int64)
        self.name = np.full((self.most, self.n.size), -1, np.int32)
        self.emitted = np.full((self.most, self.n.size), -np.inf)
        self.place[where], self.name[where], self.emitted[where] = at[order] - self.first[where[1]], name[order], weight[at[order]]
        self.far = self.d[self.first + self.place.max(axis=0)] if self.n.size else np.zeros(0)

    def _laned(self, width: int) -> None:
        track, part = (self.rows.column(c).to_numpy() for c in ("track", "part"))
        row = np.arange(track.size)
        new = np.append(True, (np.diff(track) != 0) | (np.diff(part) != 0))[: track.size]
        self.units = np.flatnonzero(new)
        self.i = row - np.maximum.accumulate(np.where(new, row, 0))
        number = np.maximum(self.i - 1, 0) // width
        start = np.flatnonzero(new | np.append(False, np.diff(number) != 0)[: track.size])
        self.unit, self.number = (np.cumsum(new) - 1)[start], number[start]
        self.begin = np.where(self.i[start] == 0, start, start - 1)
        self.steps = np.append(start[1:], track.size) - self.begin - 1
        order = np.argsort(-self.steps, kind="stable")  # so that the lanes still walking are the first ones
        self.unit, self.number, self.begin, self.steps = (x[order] for x in (self.unit, self.number, self.begin, self.steps))

    def _stepped(self) -> None:
        """Log weights of each step (to point b, from the one before) between the segments of its points: ``along`` one and the same of a way, and from one to the ``other``."""
        b = np.arange(self.n.size)
        a = np.maximum(b - 1, 0)
        t = self.rows.column("t").to_numpy()
        cos = np.array([math.cos(x) for x in (self.lat * (math.pi / 180)).tolist()])[a]
        gone = _hypot((self.lat[b] - self.lat[a]) * geo.DEGREE_M, _short(self.lon[b] - self.lon[a]) * geo.DEGREE_M * cos)
        dt = t[b] - t[a]
        speed, unknown = self.rows.column("speed").to_numpy(), pc.is_null(self.rows.column("speed")).to_numpy()
        known = np.where(unknown, 0.0, speed)
        some = 2 - unknown[a].astype(int) - unknown[b]
        pace = np.where(some > 0, (known[a] + known[b]) / np.maximum(some, 1), SPEED_MS)
        allowed = np.where(dt > 0, (pace + MARGIN_MS) * dt + MARGIN_M, np.inf)
        limit = np.minimum(ROUTE_M, gone + self.far[a] + self.far[b] + SLACK_M)
        broken = (dt > BREAK_S) & (gone > BREAK_M)
        count = np.where(self.i > 0, self.n[a] * self.n[b], 0)
        self.offset = np.cumsum(count) - count
        made = [self._weighed(some.start, count[some], a, gone, limit, allowed, broken, cos) for some in _slices(count)]
        self.along, self.other = (np.concatenate(x) for x in zip(*made, strict=True))

    def _weighed(self, start: int, count: np.ndarray, a: np.ndarray, gone: np.ndarray, limit: np.ndarray, allowed: np.ndarray, broken: np.ndarray, cos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``along`` and ``other`` of some steps, from the point ``start`` on."""
        roads = self.roads
        step, k = _ragged(count)
        step += start
        p, q = self.first[a][step] + k // self.n[step], self.first[step] + k % self.n[step]
        lead = np.stack((self.share[p], 1 - self.share[p])) * roads.length[self.road[p]]
        tail = np.stack((self.share[q], 1 - self.share[q])) * roads.length[self.road[q]]
        ends = roads.routes(self.road[p], self.road[q], np.where(broken, 0.0, limit)[step]).reshape(2, 2, -1)
        other = (lead[:, None] + ends + tail[None]).min(axis=(0, 1), initial=np.inf)
        other = np.where(other <= limit[step], other, np.inf)
        along = np.abs(self.share[p] - self.share[q]) * roads.length[self.road[p]]
        aside = _hypot(_short((self.lon[step] - self.lon[a][step]) - self.s_lon[q] + self.s_lon[p]) * (geo.DEGREE_M * cos)[step], ((self.lat[step] - self.lat[a][step]) - self.s_lat[q] + self.s_lat[p]) * geo.DEGREE_M)

        def weight(route: np.ndarray) -> np.ndarray:
            with np.errstate(invalid="ignore"):
                apart = np.where(np.isinf(route), LOST_M, np.abs(gone[step] - route) + np.maximum(0.0, route - allowed[step]))
            return np.where(broken[step], 0.0, -(apart + aside) / BETA_M - math.log(BETA_M))  # an interrupted walk begins anew

        return weight(along), weight(other)

    def _moved(self, b: np.ndarray) -> np.ndarray:
        """(from, to, step) of the steps to the points b."""
        at = self.offset[b] + self.place[:, None, b - 1] * self.n[b] + self.place[None, :, b]
        return np.where(self.name[:, None, b - 1] == self.name[None, :, b], self.along[at], self.other[at])

    def _walked(self):
        """The points that the lanes reach at each step, and the steps' weights, made once."""
        if not hasattr(self, "_steps"):
            live = np.searchsorted(-self.steps, -np.arange(1, self.steps.max(initial=0) + 1), "right")
            self._steps = [(b, self._moved(b)) for b in (self.begin[:n] + 1 + r for r, n in enumerate(live))]
        return self._steps

    def matrices(self) -> np.ndarray:
        """(from, to, lane); a lane's first point's own weight is left to the lane before, or to the fold for a unit's first."""
        m = np.full((self.most, self.most, self.begin.size), -np.inf)
        for c in range(self.most):
            m[c, c, self.emitted[c, self.begin] > -np.inf] = 0.0
        for b, w in self._walked():
            was = m[:, :, : b.size]
            now = was[:, 0, None] + w[None, 0]
            for c in range(1, self.most):
                np.maximum(now, was[:, c, None] + w[None, c], out=now)
            m[:, :, : b.size] = now + self.emitted[None, :, b]
        return m

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The candidates at each lane's ends on its unit's likeliest path; of equal paths the one through the nearest candidates, last point first."""
        m, v, back = self.matrices(), self.emitted[:, self.units], []
        order = np.argsort(self.number, kind="stable")
        lanes = np.split(order, np.flatnonzero(np.diff(self.number[order])) + 1)
        for some in lanes:
            way = v[:, None, self.unit[some]] + m[:, :, some]
            back.append(way.argmax(axis=0))
            v[:, self.unit[some]] = way.max(axis=0)
        last, from_, to = v.argmax(axis=0), np.zeros(self.begin.size, np.int64), np.zeros(self.begin.size, np.int64)
        for some, of in zip(reversed(lanes), reversed(back), strict=True):
            to[some] = last[self.unit[some]]
            last[self.unit[some]] = from_[some] = of[to[some], np.arange(some.size)]
        return from_, to

    def traced(self, from_: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Each point's candidate on the likeliest path between the lanes' ends."""
        chosen = np.zeros(self.n.size, np.int64)
        v, back = np.full((self.most, self.begin.size), -np.inf), []
        v[from_, np.arange(self.begin.size)] = 0.0
        for b, w in self._walked():
            best, of = v[0, : b.size] + w[0], np.zeros((self.most, b.size), np.int8)
            for c in range(1, self.most):
                way = v[c, : b.size] + w[c]
                better = way > best
                np.copyto(best, way, where=better)
                of[better] = c
            back.append(of)
            v[:, : b.size] = best + self.emitted[:, b]
        at = to.copy()
        for (b, _), of in zip(reversed(self._walked()), reversed(back), strict=True):
            chosen[b] = at[: b.size]
            at[: b.size] = of[at[: b.size], np.arange(b.size)]
        begun = self.number == 0
        chosen[self.begin[begun]] = from_[begun]
        return chosen

    def placed(self, chosen: np.ndarray, rows: np.ndarray) -> pa.Table:
        """The given points on their candidates."""
        at, name = self.first[rows] + self.place[chosen[rows], rows], self.name[chosen[rows], rows]
        own = self.rows.select(["track", "idx"]).take(pa.array(rows))
        way = self.roads.way[name]
        return pa.table([*own.columns, pa.array(way, mask=way == _NO_WAY), self.roads.seg[name], self.s_lat[at], self.s_lon[at], self.d[at]], schema=_PLACED)


def _whole(rows: pa.Table, roads: _Roads, width: int) -> pa.Table:
    """Whole tracks on their roads."""
    walks = _Walks(rows, roads, width)
    return walks.placed(walks.traced(*walks.ends()), np.arange(walks.n.size)) if walks.n.size else _PLACED.empty_table()


def _held(rows: pa.Table, roads: _Roads) -> pa.Table:
    """Points with a road near: the others belong to no piece."""
    point = roads.near(*(rows.column(c).to_numpy() for c in ("lat", "lon", "scale")))[0]
    return rows.select(_POINT).take(pa.array(np.unique(point)))


def _matrix(rows: pa.Table, roads: _Roads) -> pa.Table:
    """Pieces' matrices, and the weights of their first points."""
    walks = _Walks(rows, roads, 1 << 40)
    own = walks.rows.select(["track", "part"]).take(pa.array(walks.begin))
    start, m = walks.emitted[:, walks.begin].T, walks.matrices().transpose(2, 0, 1)
    real = start > -np.inf
    listed = [pa.array([x.tolist() for x in made], pa.list_(pa.float64())) for made in ((s[r] for s, r in zip(start, real, strict=True)), (x[r].ravel() for x, r in zip(m, real, strict=True)))]
    return pa.table([*own.columns, *listed], names=["track", "part", "start", "m"])


def _folded(table: pa.Table) -> pa.Table:
    """The candidates at the ends of a track's pieces; of equal paths the one through the nearest candidates, last point first."""
    rows = table.sort_by("part").to_pylist()
    v, back = np.array(rows[0]["start"]), []
    for r in rows:
        m = np.array(r["m"]).reshape(len(r["start"]), -1)
        way = v[:, None] + m[:, : _reached(m)]
        back.append(way.argmax(axis=0))
        v = way.max(axis=0)
    ends, last = [], int(v.argmax())
    for of in reversed(back):
        ends.append((int(of[last]), last))
        last = int(of[last])
    ends.reverse()
    return pa.table({"track": [r["track"] for r in rows], "part": [r["part"] for r in rows], "from_": pa.array([a for a, _ in ends], pa.int32()), "to_": pa.array([b for _, b in ends], pa.int32())})


def _reached(m: np.ndarray) -> int:
    """Columns of a matrix that are candidates: the others, which come last, can't be reached."""
    return int((m > -np.inf).any(axis=0).sum())


def _traced(rows: pa.Table, roads: _Roads) -> pa.Table:
    """Pieces' points on their roads, between the given ends; the first point belongs to the piece before."""
    walks = _Walks(rows, roads, 1 << 40)
    from_, to, part = (walks.rows.column(c).to_numpy() for c in ("from_", "to_", "part"))
    chosen = walks.traced(from_[walks.begin].astype(np.int64), to[walks.begin].astype(np.int64))
    return walks.placed(chosen, np.flatnonzero((walks.i > 0) | (part == 0)))


def _runs(batches: Iterator[pa.RecordBatch], made: Callable[[pa.Table, _Roads], pa.Table]) -> Iterator[pa.RecordBatch]:
    """``made`` of whole units, some at a time; rows are sorted by key, and a key's roads come before its units."""

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        is_road = pc.is_null(table.column("track"))
        units = table.filter(pc.invert(is_road))
        if units.num_rows and units.num_rows < table.num_rows:
            yield from made(units, _Roads(table.filter(is_road))).to_batches()

    held: list[pa.RecordBatch] = []
    n, enough = 0, BATCH
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < enough:
            continue
        table = pa.Table.from_batches(held)
        key, is_road = table.column("key").to_numpy(), pc.is_null(table.column("track")).to_numpy()
        track, part = (pc.fill_null(table.column(c), -1).to_numpy() for c in ("track", "part"))
        last = (key == key[-1]) & (is_road == is_road[-1]) & (track == track[-1]) & (part == part[-1])
        begin = int(np.argmax(last))
        before = np.flatnonzero((key == key[-1]) & is_road & ~last)
        if begin > before.size:
            yield from done(table.slice(0, begin))
            table = pa.concat_tables([table.take(pa.array(before)), table.slice(begin)])
            enough = before.size + BATCH
        else:
            enough = 2 * n
        held, n = table.combine_chunks().to_batches(), table.num_rows
    if held:
        yield from done(pa.Table.from_batches(held))


def _solved(units: DataFrame, places: DataFrame, made: Callable[[pa.Table, _Roads], pa.Table], schema: str, also: tuple[str, ...] = ()) -> DataFrame:
    """``made`` of units (track, part, t, idx, lat, lon, speed, heading, cy, cx of the unit's first point) and the roads around them."""
    crowded = cut(units.groupBy("cy", "cx").agg(F.count("*").alias("_n")).where(F.col("_n") > PLACE))
    share = F.pmod(F.xxhash64("track", "part"), F.ceil(F.coalesce(F.col("_n"), F.lit(1)) / PLACE))
    rows = units.join(F.broadcast(crowded), ["cy", "cx"], "left").withColumn("key", F.xxhash64("cy", "cx", share))
    roads = _roads_near(rows, places, ("key",), ("bearing", "names"))
    null = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    ends = [F.col(f).alias(c) for c, f in zip((*_ENDS, "heading"), ("a_lat", "a_lon", "b_lat", "b_lon", "bearing"), strict=True)]
    roads = roads.select("key", *(null(c) for c in ("track", "part", "idx")), *ends, F.lit(None).cast("double").alias("scale"), "names", *(null(c) for c in also))
    rows = rows.select("key", "track", "part", "idx", *_ENDS, "heading", geo.lon_degree_m(F.col("lat")).alias("scale"), F.lit(None).cast(places.schema["names"].dataType).alias("names"), *also)
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = rows.unionByName(roads).repartition(n, "key").sortWithinPartitions("key", "track", "part", "t", "idx")
    return both.mapInArrow(lambda batches: _runs(batches, made), schema)


def _begun(units: DataFrame, *unit: str) -> DataFrame:
    """Points of units with the cell (cy, cx) of the unit's first point."""
    size = ROUTE_M + SEARCH_M
    first = F.first(F.struct("lat", "lon")).over(Window.partitionBy(*unit).orderBy("t", "idx"))
    band = geo.band_of(F.col("_first.lat"), size)
    return units.withColumn("_first", first).withColumns({"cy": band, "cx": geo.column_of(F.col("_first.lon"), band, size)}).drop("_first")


def matched(points: DataFrame, ways: DataFrame, width: int = WIDTH, whole: int = WHOLE) -> DataFrame:
    """(track, idx, way, seg, lat, lon, off_m): the likeliest place on the roads of each point (track, t, idx, lat, lon, speed) that has one near.

    ``ways`` has way and nodes; speed may be null. Weights: distance from the road, heading across it, the route against
    the distance gone and against what walking allows, and the step on the road against the step of the points. Tracks of
    more than ``whole`` points are matched in pieces of ``width``.
    """
    segs = segments(ways)
    same = Window.partitionBy("a_lat", "a_lon", "b_lat", "b_lon").orderBy("way", "seg")  # of ways on one another only the first can be among the nearest
    names = segs.dropna(subset=["a_lat", "a_lon", "b_lat", "b_lon"]).withColumn("_copy", F.row_number().over(same)).where(F.col("_copy") <= CANDIDATES)
    names = names.groupBy("a_lat", "a_lon", "b_lat", "b_lon").agg(F.sort_array(F.collect_list(F.struct(F.col("way").cast("long").alias("way"), F.col("seg").cast("int").alias("seg")))).alias("names"))
    places = cut(names.withColumn("bearing", geo.bearing(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))))
    walk = points.select(F.col("track").cast("long").alias("track"), F.col("t").cast("double").alias("t"), F.col("idx").cast("long").alias("idx"), "lat", "lon", F.col("speed").cast("double").alias("speed"))
    walk = headed(walk).where((F.abs("lat") + F.abs("lon") < math.inf) & F.col("track").isNotNull() & F.col("idx").isNotNull())
    walk = written(_begun(walk, "track").withColumns({"part": F.lit(0).cast("long"), "n": F.count("*").over(Window.partitionBy("track"))}))
    out = _solved(walk.where(F.col("n") <= whole), places, lambda rows, roads: _whole(rows, roads, width), _OUT)
    long = walk.where(F.col("n") > whole).select(*_POINT)
    if long.isEmpty():
        return out
    number = F.row_number().over(by_time()).cast("long") - 1
    spans = _begun(long.withColumn("i", number).withColumn("part", F.expr(f"i div {WHOLE}L")).drop("i"), "track", "part")
    held = _solved(spans, places, _held, "track long, t double, idx long, lat double, lon double, speed double, heading double")
    own = F.expr(f"i div {width}L")
    pieces = F.explode(F.when((F.col("i") % width == 0) & (F.col("i") > 0), F.array(own - 1, own)).otherwise(F.array(own)))  # an end is in both
    pieces = written(_begun(held.withColumn("i", number).withColumn("part", pieces).drop("i"), "track", "part"))
    made = _solved(pieces, places, _matrix, "track long, part long, start array<double>, m array<double>")
    ends = cut(cut(made).groupBy("track").applyInArrow(_folded, "track long, part long, from_ int, to_ int"))
    return out.unionByName(_solved(pieces.join(ends, ["track", "part"]), places, _traced, _OUT, ("from_", "to_")))


def _matched(spark, d) -> DataFrame:
    """The events' walk, its raw positions, on the streets laid under it."""
    from .junction_turns import street_walk, streets

    walk = street_walk(spark, d).select("track", "t", "idx", F.col("raw_lat").alias("lat"), F.col("raw_lon").alias("lon"), F.lit(None).cast("double").alias("speed"))
    out = matched(walk, streets(spark, d).select(F.col("id").alias("way"), F.col("path").alias("nodes")), 64)
    return out.select("track", "idx", "way", "seg", *(F.round(c, 6).alias(c) for c in ("lat", "lon")), F.round("off_m", 4).alias("off_m"))


QUERIES = {"map_pieces": _matched}
ORACLE_SQL: dict[str, str] = {}
