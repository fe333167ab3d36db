"""Tiles of one band of 32-bit floats in TIFF files ({zoom}/{x}/{y}.tif of the Mercator grid) as a Spark data source of pixels.

A pixel is a row (z, py, px, v) of the zoom's whole grid, so a mosaic is the table itself. Small files share a partition,
large ones are split between their strips or tiles; files outside the box asked for are never opened.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import geo

SCHEMA = "z int, py long, px long, v float"
#: Fixed values of the format: sizes of the types and tags by name; compressions that are read (none, two numbers of deflate).
TYPES = {1: "B", 3: "H", 4: "I"}
TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "strips": 273, "samples": 277, "rows": 278, "strip_bytes": 279, "predictor": 317, "tile_width": 322, "tile_height": 323, "tiles": 324, "tile_bytes": 325, "format": 339}
PLAIN, DEFLATE = (1,), (8, 32946)


class Damaged(ValueError):
    """A file that ends before what its header names, or whose bytes don't unpack."""


@dataclass(frozen=True)
class Layout:
    order: str
    width: int
    height: int
    compression: int
    block: tuple[int, int]
    places: tuple[tuple[int, int], ...]


def layout(read) -> Layout:
    """What the header says; ``read``(offset, length) gives bytes. Only one band of 32-bit floats without predictor is read."""

    def get(at: int, n: int) -> bytes:
        data = read(at, n)
        if len(data) < n:
            raise Damaged("cut short")
        return data

    head = get(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack_from(order + "H", head, 2)[0] != 42:
        raise ValueError("not a TIFF")
    start = struct.unpack_from(order + "I", head, 4)[0]
    count = struct.unpack(order + "H", get(start, 2))[0]
    entries, found = get(start + 2, 12 * count), {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", entries, 12 * i)
        if kind in TYPES and tag in TAGS.values():
            code = f"{order}{n}{TYPES[kind]}"
            size = struct.calcsize(code)
            data = entries[12 * i + 8 : 12 * i + 8 + size] if size <= 4 else get(struct.unpack_from(order + "I", entries, 12 * i + 8)[0], size)
            found[tag] = struct.unpack(code, data)
    of = lambda name, default=None: found.get(TAGS[name], default)
    one = lambda name, default: of(name, (default,))[0]
    width, height = one("width", 0), one("height", 0)
    if not width or not height:
        raise ValueError("no size")
    if (one("samples", 1), one("bits", 0), one("format", 1), one("predictor", 1)) != (1, 32, 3, 1):
        raise ValueError("not one band of 32-bit floats without predictor")
    if one("compression", 1) not in PLAIN + DEFLATE:
        raise ValueError(f"compression {one('compression', 1)}")
    tiled = of("strips") is None
    offsets, sizes = (of("tiles"), of("tile_bytes")) if tiled else (of("strips"), of("strip_bytes"))
    block = (one("tile_height", 0), one("tile_width", 0)) if tiled else (min(one("rows", height), height), width)
    if not offsets or not sizes or not all(block):
        raise ValueError("neither strips nor tiles")
    if min(len(offsets), len(sizes)) < math.ceil(height / block[0]) * math.ceil(width / block[1]):
        raise Damaged("fewer blocks than the size asks for")
    return Layout(order, width, height, one("compression", 1), block, tuple(zip(offsets, sizes, strict=False)))


def pixels(shape: Layout, number: int, data: bytes) -> tuple[int, int, np.ndarray]:
    """(first row, first column, values) of a block, without what lies beyond the picture."""
    if len(data) < shape.places[number][1]:
        raise Damaged("cut short")
    if shape.compression in DEFLATE:
        try:
            data = zlib.decompress(data)
        except zlib.error as e:
            raise Damaged(str(e)) from e
    across = math.ceil(shape.width / shape.block[1])
    row, col = number // across * shape.block[0], number % across * shape.block[1]
    rows = min(shape.block[0], shape.height - row)
    if len(data) < rows * shape.block[1] * 4:
        raise Damaged("fewer pixels than the size asks for")
    values = np.frombuffer(data, shape.order + "f4", count=rows * shape.block[1]).reshape(rows, shape.block[1])
    return row, col, values[:, : shape.width - col].astype("f4")


@dataclass
class Part(InputPartition):
    """(path, z, x, y, first block, block after the last) of each piece; without blocks the whole file."""

    pieces: list[tuple]


class RasterReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.fs, self.root = FileSystem.from_uri(options["path"])
        self.size, self.most = int(options.get("tileSize", 256)), int(options.get("partitionBytes", 1 << 25))
        self.skip = {"fail": False, "skip": True}[options.get("damaged", "fail")]
        box = options.get("box")
        self.box = tuple(float(v) for v in box.split(",")) if box else None

    def _wanted(self, z: int, x: int, y: int) -> bool:
        if self.box is None:
            return True
        south, west, north, east = self.box
        n = 1 << z
        down = lambda lat: (1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n
        across = lambda lon: (lon + 180) / 360 * n
        return math.floor(across(west)) <= x <= math.floor(across(east)) and math.floor(down(north)) <= y <= math.floor(down(south))

    def partitions(self) -> list[Part]:
        """Names and sizes come from the listing; only files of more than a partition have their header read here."""
        parts, open_, held = [], [], 0
        for info in sorted(self.fs.get_file_info(FileSelector(self.root, recursive=True)), key=lambda i: i.path):
            name = re.search(r"(?:^|/)(\d+)/(\d+)/(\d+)\.tiff?$", info.path)
            if info.type != FileType.File or not name or not self._wanted(*map(int, name.groups())):
                continue
            where = (info.path, *map(int, name.groups()))
            if info.size > self.most:
                try:
                    blocks = len(self._layout(info.path).places)
                except Damaged:
                    blocks = 1  # a task tells or skips it
                each = max(1, math.ceil(blocks * self.most / info.size))
                parts += [Part([(*where, b, min(b + each, blocks))]) for b in range(0, blocks, each)]
                continue
            if held + info.size > self.most and open_:
                parts, open_, held = [*parts, Part(open_)], [], 0
            open_.append((*where, None, None))
            held += info.size
        return [*parts, Part(open_)] if open_ or not parts else parts

    def _layout(self, path: str) -> Layout:
        with self.fs.open_input_file(path) as f:
            return self._shape(f)

    @staticmethod
    def _shape(f) -> Layout:
        return layout(lambda at, n: f.read_at(n, at) if at < f.size() else b"")

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        for path, z, x, y, first, after in partition.pieces:
            try:
                with self.fs.open_input_file(path) as f:
                    shape = self._shape(f)
                    for b in range(first or 0, len(shape.places) if after is None else after):
                        at, n = shape.places[b]
                        row, col, v = pixels(shape, b, f.read_at(n, at) if at < f.size() else b"")
                        h, w = v.shape
                        py = np.repeat(np.arange(h, dtype="i8") + y * self.size + row, w)
                        px = np.tile(np.arange(w, dtype="i8") + x * self.size + col, h)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(h * w, z, "i4")), pa.array(py), pa.array(px), pa.array(v.ravel())], ["z", "py", "px", "v"])
            except Damaged as e:
                if not self.skip:
                    raise Damaged(f"{path}: {e}") from e
            except ValueError as e:
                raise ValueError(f"{path}: {e}") from e


class RasterTiles(DataSource):
    """Format ``raster_tiles``; options ``path``, ``box`` ("south,west,north,east"), ``tileSize``, ``partitionBytes``, ``damaged`` (fail or skip)."""

    @classmethod
    def name(cls) -> str:
        return "raster_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RasterReader(self.options)


def read_tiles(spark: SparkSession, path: str, **options) -> DataFrame:
    """Pixels (z, py, px, v) of the tiles below ``path``; no file gives no row. The blocks of a damaged file before its damage may have been read where ``damaged`` is skip."""
    spark.dataSource.register(RasterTiles)
    return spark.read.format("raster_tiles").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def encoded(values: np.ndarray, rows: int = 64) -> bytes:
    """A little-endian TIFF of deflated strips."""
    h, w = values.shape
    strips = [zlib.compress(values[i : i + rows].astype("<f4").tobytes()) for i in range(0, h, rows)]
    n = len(strips)
    fields = [(256, [w]), (257, [h]), (258, [32]), (259, [8]), (262, [1]), (273, None), (277, [1]), (278, [rows]), (279, [len(s) for s in strips]), (339, [3])]
    lists = 8 + 2 + 12 * len(fields) + 4
    data = lists + (8 * n if n > 1 else 0)
    starts = [data + sum(len(s) for s in strips[:i]) for i in range(n)]
    out = struct.pack("<2sHIH", b"II", 42, 8, len(fields))
    for tag, v in fields:
        v = starts if v is None else v
        out += struct.pack("<HHII", tag, 4, len(v), v[0] if len(v) == 1 else lists + (0 if tag == 273 else 4 * n))
    out += struct.pack("<I", 0)
    if n > 1:
        out += struct.pack(f"<{2 * n}I", *starts, *(len(s) for s in strips))
    return out + b"".join(strips)


def write_tiles(values: DataFrame, path: str, size: int = 256) -> int:
    """Pixels (z, py, px, v), one row a pixel, as files; how many. A tile is a group of at most ``size`` squared rows; a pixel without a value is NaN.

    A file appears under its name once it is whole, so a task that runs again writes the same file.
    """

    def save(key: tuple, table: pa.Table) -> pa.Table:
        z, y, x = (k.as_py() for k in key)
        grid = np.full((size, size), np.nan, "f4")
        grid[table["py"].to_numpy() - y * size, table["px"].to_numpy() - x * size] = table["v"].to_numpy(zero_copy_only=False)
        fs, root = FileSystem.from_uri(path)
        fs.create_dir(f"{root}/{z}/{x}", recursive=True)
        name = f"{root}/{z}/{x}/{y}.tif"
        part = f"{name}.{uuid4().hex}"
        with fs.open_output_stream(part) as f:
            f.write(encoded(grid))
        fs.move(part, name)
        return pa.table({"n": pa.array([1], pa.int64())})

    tiles = values.select("z", F.floor(F.col("py") / size).alias("ty"), F.floor(F.col("px") / size).alias("tx"), "py", "px", F.col("v").cast("float").alias("v"))
    return tiles.groupBy("z", "ty", "tx").applyInArrow(save, "n long").agg(F.sum("n")).first()[0] or 0


def at_pixel(zoom: int, size: int = 256) -> tuple:
    """(py, px) of columns lat, lon in the zoom's whole grid: the pixel that the place falls in."""
    p = geo.tile_pixel(F.col("lat"), F.col("lon"), zoom, size)
    return p["y"] * size + p["py"], p["x"] * size + p["px"]
