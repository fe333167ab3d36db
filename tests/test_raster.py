"""Pixels of tiles read as they were written, by strips and tiles, and discs against plain loops."""

import math
import struct
import zlib

import numpy as np
import pytest

from dermotrace import registry
from dermotrace.operators.discs import discs
from dermotrace.sources import raster_tiles as rt
from oracle import same

SF = "/root/testdata/sf0.001"


def tiff(values, block=None, order="<", deflate=True, rows=5):
    """A file of tiles of ``block`` (height, width), or of strips of ``rows``; written apart from the library's writer."""
    h, w = values.shape
    pieces = []
    if block:
        for y in range(0, h, block[0]):
            for x in range(0, w, block[1]):
                p = np.zeros(block, "f4")
                q = values[y : y + block[0], x : x + block[1]]
                p[: q.shape[0], : q.shape[1]] = q
                pieces.append(p)
    else:
        pieces = [values[y : y + rows] for y in range(0, h, rows)]
    data = [zlib.compress(p.astype(order + "f4").tobytes()) if deflate else p.astype(order + "f4").tobytes() for p in pieces]
    tags = {256: ("H", [w]), 257: ("H", [h]), 258: ("H", [32]), 259: ("H", [8 if deflate else 1]), 277: ("H", [1]), 339: ("H", [3])}
    tags |= {322: ("H", [block[1]]), 323: ("H", [block[0]]), 324: ("I", [0] * len(data)), 325: ("I", [len(d) for d in data])} if block else {273: ("I", [0] * len(data)), 278: ("H", [rows]), 279: ("I", [len(d) for d in data])}
    at = 8
    starts = []
    for d in data:
        starts.append(at)
        at += len(d)
    tags[324 if block else 273] = ("I", starts)
    body, extra, ifd = b"".join(data), b"", at
    after = ifd + 2 + 12 * len(tags) + 4
    entries = struct.pack(order + "H", len(tags))
    for tag, (kind, v) in sorted(tags.items()):
        packed = struct.pack(f"{order}{len(v)}{kind}", *v)
        entries += struct.pack(order + "HHI", tag, {"H": 3, "I": 4}[kind], len(v))
        if len(packed) <= 4:
            entries += packed.ljust(4, b"\0")
        else:
            entries += struct.pack(order + "I", after + len(extra))
            extra += packed
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, ifd) + body + entries + b"\0" * 4 + extra


def put(root, z, x, y, data):
    path = root / str(z) / str(x)
    path.mkdir(parents=True, exist_ok=True)
    (path / f"{y}.tif").write_bytes(data)


def grids(seed=1, n=20):
    rng = np.random.default_rng(seed)
    v = rng.random((n, n)).astype("f4")
    v[3, 4] = np.nan
    return v


def test_layouts(spark, tmp_path):
    """Strips and tiles, either byte order, deflated or not, edge tiles cut, one partition a few blocks."""
    makers = [dict(), dict(deflate=False), dict(order=">"), dict(block=(8, 16)), dict(block=(16, 16), order=">", deflate=False), dict(rows=64)]
    want = {}
    for i, how in enumerate(makers):
        v = grids(i)
        put(tmp_path, 10, 500 + i, 300, tiff(v, **how))
        want |= {(10, 300 * 20 + r, (500 + i) * 20 + c): v[r, c] for r in range(20) for c in range(20)}
    (tmp_path / "readme.txt").write_text("no tile")
    for most in (1 << 25, 300):
        df = rt.read_tiles(spark, str(tmp_path), tileSize=20, partitionBytes=most)
        rows = df.collect()
        assert len(rows) == len(want) == 2400
        assert all(np.array_equal(np.float32(r.v), want[r.z, r.py, r.px], equal_nan=True) for r in rows)
    assert df.rdd.getNumPartitions() > 12


def test_box(spark, tmp_path):
    z = 12
    at = lambda lat, lon: (math.floor((lon + 180) / 360 * 2**z), math.floor((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * 2**z))
    x, y = at(51.5, -0.1)
    for i in range(3):
        for j in range(3):
            # tiles outside of the box aren't TIFFs: they are never opened
            put(tmp_path, z, x + i, y + j, tiff(grids()) if (i, j) == (0, 0) else b"nothing")
    assert rt.read_tiles(spark, str(tmp_path), box="51.5,-0.1,51.5,-0.1", tileSize=20).count() == 400
    assert rt.read_tiles(spark, str(tmp_path), box="10,10,11,11").count() == 0


def test_damage(spark, tmp_path):
    good = tiff(grids(), deflate=False)
    put(tmp_path, 1, 0, 0, good)
    put(tmp_path, 1, 1, 0, good[:700])
    with pytest.raises(Exception, match="1/1/0.tif"):
        rt.read_tiles(spark, str(tmp_path), tileSize=20).count()
    assert rt.read_tiles(spark, str(tmp_path), tileSize=20, damaged="skip").count() == 400

    def header(data):
        return rt.layout(lambda at, n: data[at : at + n])

    for data, error in ((b"", rt.Damaged), (b"PK" + good[2:], ValueError), (good[:600], rt.Damaged)):
        with pytest.raises(error):
            header(data)
    shape = header(good)
    assert (shape.width, shape.height, shape.block) == (20, 20, (5, 20))


def test_round_trip(spark, tmp_path):
    rng = np.random.default_rng(3)
    cells = {(int(y), int(x)) for y, x in rng.integers(0, 100, (400, 2))}
    values = {(7, y, x): float(np.float32(rng.random())) for y, x in cells}
    df = spark.createDataFrame([(*k, v) for k, v in values.items()], "z int, py long, px long, v double")
    for _ in range(2):  # written again: the same files
        n = rt.write_tiles(df, f"file://{tmp_path}/t", 32)
        assert n == len({(y // 32, x // 32) for y, x in cells}) == len(list((tmp_path / "t").rglob("*.*")))
    back = rt.read_tiles(spark, f"file://{tmp_path}/t", tileSize=32).where("not isnan(v)").collect()
    assert {(r.z, r.py, r.px): r.v for r in back} == values
    assert rt.write_tiles(df.limit(0), str(tmp_path / "none")) == 0


def test_discs(spark):
    z, n = 13, 2**13 * 256
    rng = np.random.default_rng(4)
    pts = [(1, i, 51.5 + float(rng.random()) * 0.01, -0.1 + float(rng.random()) * 0.01) for i in range(60)] + [(2, 0, None, 1.0), (2, 1, 10.0, 10.0)]
    places = {i: (math.floor((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n), math.floor((lon + 180) / 360 * n)) for t, i, lat, lon in pts if t == 1}
    ys, xs = [p[0] for p in places.values()], [p[1] for p in places.values()]
    grid = {(y, x): float(rng.random()) for y in range(min(ys) - 2, max(ys) + 2) for x in range(min(xs) - 2, max(xs) + 2) if rng.random() < 0.8}
    some = list(grid)
    grid |= {some[0]: float("nan"), some[1]: -9999.0, some[2]: -1.5, places[0]: -2.0}
    df = spark.createDataFrame([(*k, v) for k, v in grid.items()], "py long, px long, v double")
    got = {(r.track, r.idx): r for r in discs(spark.createDataFrame(pts, "track long, idx long, lat double, lon double"), df, z, 50.0).collect()}
    assert len(got) == 61 and (got[2, 1].at, got[2, 1].mean) == (None, None)
    for i, (y, x) in places.items():
        lat = pts[i][2]
        r = max(1, math.floor(50 / (2 * 20037508.342789244 * math.cos(math.radians(lat)) / n) + 0.5))
        met = [v for (a, b), v in grid.items() if (a - y) ** 2 + (b - x) ** 2 <= r * r and v > -1.5]
        own = grid.get((y, x), -9)
        assert got[1, i].mean == pytest.approx(np.mean(met)) and got[1, i].at == (own if own > -1.5 else None)


def test_query(spark):
    same(registry.queries()["raster_discs"](spark, SF), registry.oracle_sql()["raster_discs"], SF)
