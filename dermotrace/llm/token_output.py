"""Operator 4: token ids in sorted-string-table shards.

Documents are range-partitioned and sorted by identifier; each partition tokenises its own stretch and writes it as one
shard, so that the shards together are in ascending order. Shards go to the shared folder through pyarrow's file
systems (file, hdfs, s3, gs); a task that runs again writes a new file, and only the files that the manifest (a Parquet
table written by Spark, one row for each shard) names are ever read.

Shard: data blocks, index, Bloom filter, footer.
- A block is zstd of entries in key order: shared prefix length, key suffix length and number of ids (unsigned varints),
  key suffix, ids (little-endian, 2 bytes each if the vocabulary allows it, else 4). The first entry shares nothing.
- The index is sparse: last key, offset and length of each block. A lookup bisects it and unpacks one block.
- The Bloom filter has 10 bits a key and 7 probes by double hashing.
- The footer has fixed length: offsets and lengths, entries, tokens, width of an id, magic.

A key is empty for a null doc_id, else 9 bytes in the order of the integers. Null and empty texts have the end id only.
Rows that share a doc_id all stay, in the order of the scan.
"""

from __future__ import annotations

import bisect
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, partitions, read_table, scratch, slices
from .tokens import encoder, tokenizer_spec

END_ID = 2
BLOCK_BYTES = 1 << 16
_FOOTER = struct.Struct("<QQQQQQB7s")
_MAGIC = b"TOKSST1"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b & (1 << 64) - 1) % bits for i in range(7)]


class ShardWriter:
    """Entries must come in key order."""

    def __init__(self, file, width: int):
        self.file, self.width, self.at = file, width, 0
        self.block, self.last, self.index, self.keys, self.tokens = bytearray(), b"", [], [], 0
        self.pack = zstandard.ZstdCompressor(level=1).compress

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(ids.size) + key[shared:] + ids.tobytes()
        self.last, self.tokens = key, self.tokens + ids.size
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _write(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.file.write(data)
        self.at += len(data)
        return at, len(data)

    def _flush(self) -> None:
        if self.block:
            self.index.append((self.last, *self._write(self.pack(bytes(self.block)))))
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = self._write(b"".join(_varint(len(k)) + k + struct.pack("<QQ", at, n) for k, at, n in self.index))
        bits = max(64, 10 * len(self.keys))
        bloom = np.zeros(bits, np.uint8)
        for key in self.keys:
            bloom[_probes(key, bits)] = 1
        where = self._write(struct.pack("<Q", bits) + np.packbits(bloom).tobytes())
        self._write(_FOOTER.pack(*index, *where, len(self.keys), self.tokens, self.width, _MAGIC))


class ShardReader:
    def __init__(self, file, size: int):
        self.file = file
        at, n, b_at, b_n, self.entries, self.tokens, self.width, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError("not a token shard")
        data, self.index, i = self._read(at, n), [], 0
        while i < len(data):
            k, i = _read_varint(data, i)
            self.index.append((data[i : i + k], *struct.unpack_from("<QQ", data, i + k)))
            i += k + 16
        bloom = self._read(b_at, b_n)
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data, at, key = zstandard.ZstdDecompressor().decompress(self._read(*self.index[i][1:])), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, np.frombuffer(data, f"<u{self.width}", n, at)
            at += n * self.width

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this identifier: Bloom filter, binary search of the index, one block or a few."""
        key, found = key_of(doc_id), []
        if not all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(key, self.bits)):
            return found
        i = bisect.bisect_left(self.index, (key,))
        while i < len(self.index):
            for k, ids in self.block(i):
                if k == key:
                    found.append(ids)
                elif k > key:
                    return found
            i += 1
        return found


def _open(path: str):
    from pyarrow.fs import FileSystem

    fs, own = FileSystem.from_uri(path)
    return fs, own


def _writer(folder: str, shared, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, first = encoder(shared.value), None, None
        for part in slices(batches, "text"):
            if out is None:
                path = f"{folder}/{uuid.uuid4().hex}.sst"
                fs, own = _open(path)
                fs.create_dir(own.rsplit("/", 1)[0], recursive=True)
                file = fs.open_output_stream(own)
                out = ShardWriter(file, enc.width)
                first = part.column("doc_id")[0].as_py()
            end = np.array([end_id], f"<u{enc.width}")
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), enc.encode_many(part.column("text")), strict=True):
                out.add(key_of(doc_id), np.concatenate((ids, end)))
        if out is not None:
            last = id_of(out.last)
            out.close()
            file.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [out.at], "first_id": pa.array([first], pa.int64()), "last_id": pa.array([last], pa.int64()), "n_docs": [len(out.keys)], "n_tokens": [out.tokens]})

    return run


def write_shards(documents: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Writes the shards and the manifest under ``folder``; returns the manifest: (shard, path, bytes, first_id, last_id, n_docs, n_tokens, start)."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_spec(tokenizer))
    docs = numbered(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    ordered = docs.repartitionByRange(shards or partitions(spark), F.col("doc_id").asc_nulls_first(), "rid").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "rid")
    made = ordered.select("doc_id", "text").mapInArrow(_writer(folder, shared, end_id), "path string, bytes long, first_id long, last_id long, n_docs long, n_tokens long")
    made.select(F.spark_partition_id().alias("shard"), "*").write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each shard; ``start`` is the number of ids in the shards before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{folder}/manifest").withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows):
        doc, start, n, ids = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    for shard in batches:
        for path, size, start in zip(*(shard.column(c).to_pylist() for c in ("path", "bytes", "start")), strict=True):
            fs, own = _open(path)
            with fs.open_input_file(own) as file:
                rows, held = [], 0
                for key, ids in ShardReader(file, size):
                    rows.append((id_of(key), start, ids.size, ids.astype("<u4").tobytes()))
                    start, held = start + ids.size, held + ids.size
                    if held >= 1 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every entry of the shards; ``ids`` are little-endian unsigned 32-bit integers."""
    files = manifest.select("path", "bytes", "start").repartition(partitions(manifest.sparkSession))
    return files.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the wanted ``doc_id`` by binary search in the shards whose range holds them; a null finds nothing."""
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    shards = manifest.orderBy("shard").select("first_id", "last_id", "path", "bytes").where("last_id is not null").collect()  # a row for each shard
    bounds = manifest.sparkSession.sparkContext.broadcast(shards)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each identifier with the shards whose range holds it: bisected, as shards are in order; null identifiers lead the first."""
        low = np.array([-(1 << 63) if s.first_id is None else s.first_id for s in bounds.value], np.int64)
        high = np.array([s.last_id for s in bounds.value], np.int64)
        for part in batches:
            ids = part.column("doc_id").drop_null().to_numpy()
            rows = [(i, bounds.value[k]) for i, a, b in zip(ids.tolist(), np.searchsorted(high, ids).tolist(), np.searchsorted(low, ids, "right").tolist(), strict=True) for k in range(a, b)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([s.path for _, s in rows], pa.string()), pa.array([s.bytes for _, s in rows], pa.int64())], ["doc_id", "path", "bytes"])

    pairs = asked.mapInArrow(placed, "doc_id long, path string, bytes long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            at: dict[tuple[str, int], list[int]] = {}
            for doc_id, path, size in zip(*(part.column(c).to_pylist() for c in ("doc_id", "path", "bytes")), strict=True):
                at.setdefault((path, size), []).append(doc_id)
            for (path, size), ids in at.items():
                fs, own = _open(path)
                with fs.open_input_file(own) as file:
                    shard = ShardReader(file, size)
                    rows = [(i, x.astype("<u4").tobytes()) for i in ids for x in shard.get(i)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "ids"])

    return pairs.select("doc_id", "path", "bytes").repartition(partitions(manifest.sparkSession), "path").mapInArrow(run, "doc_id long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_shards(read_table(spark, sf_dir, "documents", "doc_id", "text"), scratch(spark, "shards"))
    return read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
