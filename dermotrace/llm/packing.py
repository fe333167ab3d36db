"""Operator 10: packing into fixed sequences by first-fit decreasing, in randomised groups.

A document's ids (with the end id) are cut into full sequences; what is left of it is packed with the others of its
group, a random one by row, so that groups are even whatever the documents hold. Within a group, the leftovers go
largest first into the first open sequence with room, which a tournament tree of the sequences' free capacities finds
in logarithmic time. Documents may be cut anywhere, so the emptiest sequences then fill the gaps of the fullest; the one
that stays partly filled is cut at powers of two, which need no padding. Only lengths are packed; the ids ride along.

Null and empty texts are the end id alone. Rows that share a doc_id are packed each for itself. No documents, no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, partitions, read_table, slices
from .tokens import encoder, tokenizer_spec

CAPACITY = 2048
END_ID = 1
#: Documents of a group, about.
GROUP = 512


def first_fit_decreasing(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Items (by index) of each bin. tree[i] is the largest free capacity under node i; a leaf is a bin."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    tree, bins = [capacity] * (2 * leaves), []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        node = 1
        while node < leaves:
            node = 2 * node if tree[2 * node] >= sizes[item] else 2 * node + 1
        if node - leaves == len(bins):
            bins.append([])
        bins[node - leaves].append(item)
        tree[node] -= sizes[item]
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins


def fill(sizes: list[int], bins: list[list[int]], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Pieces (item, start, length) of each sequence: all full but a last one, which is cut at powers of two."""
    out = sorted(([(i, 0, sizes[i]) for i in b] for b in bins), key=lambda b: -sum(p[2] for p in b))
    free = [capacity - sum(p[2] for p in b) for b in out]
    to, end = 0, len(out) - 1
    while to < end:
        if not free[to]:
            to += 1
            continue
        item, start, n = out[end].pop()
        moved = min(n, free[to])
        if moved < n:
            out[end].append((item, start, n - moved))
        out[to].append((item, start + n - moved, moved))
        free[to] -= moved
        free[end] += moved
        if not out[end]:
            out.pop()
            end -= 1
    if out and free[end]:
        left, rest = out.pop(), capacity - free[end]
        while rest:
            room = 1 << rest.bit_length() - 1
            rest, now = rest - room, []
            while room:
                item, start, n = left.pop()
                moved = min(n, room)
                if moved < n:
                    left.append((item, start, n - moved))
                now.append((item, start + n - moved, moved))
                room -= moved
            out.append(now)
    return out


def _tokenise(shared, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        end = np.array([end_id], f"<u{enc.width}")
        for part in slices(batches, "text"):
            ids = [np.concatenate((x, end)).tobytes() for x in enc.encode_many(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("bin_group"), part.column("doc_id"), pa.array([enc.width] * len(ids), pa.int32()), pa.array(ids, pa.binary())], ["bin_group", "doc_id", "width", "ids"])

    return run


def _pack(capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def one(group: int, docs: list[tuple[int | None, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        sequence = group << 24
        cut = [x.size // capacity * capacity for _, x in docs]
        partly = [i for i, (_, x) in enumerate(docs) if x.size > cut[i]]
        sizes = [docs[i][1].size - cut[i] for i in partly]
        full = ([(i, at, capacity)] for i in range(len(docs)) for at in range(0, cut[i], capacity))
        rest = ([(partly[i], cut[partly[i]] + at, n) for i, at, n in b] for b in fill(sizes, first_fit_decreasing(sizes, capacity), capacity))
        for pieces in (*full, *rest):
            offset = 0
            for i, at, n in pieces:
                doc_id, ids = docs[i]
                rows.append((doc_id, at, n, ids[at : at + n].astype("<u4").tobytes(), ids.size, sequence, offset))
                offset += n
            sequence, held = sequence + 1, held + offset
            if held >= 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, docs = None, []
        for batch in batches:
            for g, doc_id, width, ids in zip(*(batch.column(c).to_pylist() for c in ("bin_group", "doc_id", "width", "ids")), strict=True):
                if g != group and docs:
                    yield from one(group, docs)
                    docs = []
                group = g
                docs.append((doc_id, np.frombuffer(ids, f"<u{width}")))
        if docs:
            yield from one(group, docs)

    return run


def pack(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) for each piece; ``ids`` are little-endian unsigned 32-bit integers."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_spec(tokenizer))
    groups = max(1, documents.count() // group)
    rows = numbered(documents.select("doc_id", "text"))
    docs = rows.select(F.pmod(F.xxhash64("rid"), F.lit(groups)).alias("bin_group"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = docs.mapInArrow(_tokenise(shared, end_id), "bin_group long, doc_id long, width int, ids binary")
    dealt = tokens.repartition(partitions(spark), "bin_group").sortWithinPartitions("bin_group", "doc_id")
    return dealt.mapInArrow(_pack(capacity), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
