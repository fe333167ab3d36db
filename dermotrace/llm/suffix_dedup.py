"""Operator 1: repeated byte strings by a sparse, distributed suffix array.

Every 100-byte string has one anchor: the leftmost smallest hash of a 32-byte gram within it. Equal strings have their
anchor at the same place, so only suffixes at anchors (about one in 35) need sorting, and of those only the ones whose
gram hash occurs again. An anchor stands for the strings that start from ``lo`` to ``hi``; what they cover is its context.

1. Contexts, turned so that they lead with the gram, are range-partitioned by sampled splitters and sorted in each
   bucket by multikey quicksort. A context equal to the one before it repeats all its strings.
2. Where one gram has different contexts, their strings are sorted the same way, one by one: within the bucket, or, for
   a gram at a bucket's edge, dealt to buckets again. A string equal to the one before it is a repeat; the first of a
   bucket is compared across the boundary.

Position is the last part of a sort key, so the splitters cut through a string that a third of all rows hold, and no
group is ever gathered. Splitters of contexts are their leading grams and positions alone. Hashes only select: all
decisions compare bytes.

Nulls are empty; texts under 100 bytes have no strings. Rows that share a doc_id count as documents in scan order; a
null doc_id comes after all others. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, partitions, read_table, release, scratch, slices

LENGTH = 100
GRAM = 32
#: Bytes hashed at once, so that work arrays stay in the cache.
CHUNK = 1 << 17
_SMALL = 1024
_PART = 10_000
#: Strings sorted at once where contexts of a gram differ, about.
_STRINGS = 50_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 32-byte gram, by doubling."""
    h, width = _BYTES[b], 1
    for m in _MIX:
        h = h[: h.size - width] * m + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return h * _MIX[0]


def anchors(b: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes, for each start of a string the place of its anchor)."""
    h = gram_hashes(b)
    span = length - GRAM + 1
    value, at, width = h, np.arange(h.size, dtype=np.int32), 1
    while 2 * width <= span:
        left = value[:-width] <= value[width:]
        value = np.minimum(value[:-width], value[width:])
        at = np.where(left, at[:-width], at[width:])
        width *= 2
    if rest := span - width:
        at = np.where(value[:-rest] <= value[rest:], at[:-rest], at[rest:])
    return h, at


def spans(docs: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, hash, anchor, lo, hi) of the anchors: small documents are hashed together, each string within one."""
    def ready(group: list[int]):
        size = np.array([len(docs[i]) for i in group])
        ends = np.cumsum(size)
        h, at = anchors(np.frombuffer(b"".join(docs[i] for i in group), np.uint8), length)
        new = np.ones(at.size, bool)
        new[1:] = at[1:] != at[:-1]
        new[(ends - size)] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], at.size) - 1
        own = np.searchsorted(ends, first, "right")
        last = np.minimum(last, ends[own] - length)
        good = last >= first
        first, last, own = first[good], last[good], own[good]
        cuts = np.searchsorted(own, np.arange(len(group) + 1))
        for i, a, b in zip(group, cuts[:-1], cuts[1:], strict=True):
            f, base = first[a:b], ends[own[a]] - size[own[a]] if b > a else 0
            yield i, h[at[f]], at[f] - base, f - base, last[a:b] - base

    group, held = [], 0
    for i, d in enumerate(docs):
        if len(d) < length:
            continue
        group.append(i)
        held += len(d)
        if held >= CHUNK:
            yield from ready(group)
            group, held = [], 0
    if group:
        yield from ready(group)


def multikey_quicksort(words: np.ndarray, ties: list[np.ndarray]) -> np.ndarray:
    """Order of rows of big-endian words, then of the ties: three-way partitions by one word, equal rows by the next."""
    n, m = words.shape
    order, stack = np.arange(n), [(0, n, 0)]
    while stack:
        a, b, depth = stack.pop()
        part = order[a:b]
        if b - a <= _SMALL or depth == m:
            order[a:b] = part[np.lexsort([*(t[part] for t in reversed(ties)), *(words[part, k] for k in range(m - 1, depth - 1, -1))])]
            continue
        w = words[part, depth]
        pivot = np.sort(w[:: max(1, w.size // 9)])[4]
        less, equal = w < pivot, w == pivot
        order[a:b] = np.concatenate((part[less], part[equal], part[~(less | equal)]))
        x = a + int(less.sum())
        y = x + int(equal.sum())
        stack += [s for s in ((a, x, depth), (x, y, depth + 1), (y, b, depth)) if s[1] - s[0] > 1]
    return order


def _words(keys: pa.Array, least: int) -> np.ndarray:
    """Keys padded with zero bytes, as rows of big-endian words."""
    width = -(-max(least, pc.max(pc.binary_length(keys)).as_py() or 0) // 8) * 8
    out = np.empty((len(keys), width // 8), np.uint64)
    for at in range(0, len(keys), _PART):  # a part of the padded copies at a time
        part = keys.slice(at, _PART).to_pylist()
        out[at : at + _PART] = np.frombuffer(b"".join(k.ljust(width, b"\0") for k in part), ">u8").reshape(len(part), width // 8)
    return out


def _hashed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            rid = part.column("rid").to_numpy()
            docs = [x or b"" for x in part.column("text").to_pylist()]
            for i, h, *_ in spans(docs, length):
                h, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(h.size, rid[i])), pa.array(np.minimum(n, 2).astype(np.int32))], ["h", "rid", "n"])

    return _joined(run, 50_000)


def _joined(run, rows: int):
    """``run`` with its small batches put together."""

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return together


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            rid, order = part.column("rid").to_numpy(), part.column("ord").to_numpy()
            docs, wanted = part.column("text").to_pylist(), part.column("hashes")
            for i, h, at, lo, hi in spans(docs, length):
                kept = np.flatnonzero(np.isin(h, wanted[i].values.to_numpy().view(np.uint64)))
                d, at, lo, hi = docs[i], at[kept], lo[kept], hi[kept]
                keys = [d[a : z + length] + d[x:a] for a, x, z in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                same = lambda x: pa.array(np.full(kept.size, x[i]))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array((at - lo).astype(np.int32)), same(order), same(rid), pa.array(lo.astype(np.int64))], ["key", "before", "ord", "rid", "lo"])

    return _joined(run, 20_000)


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _sort_contexts(length: int):
    """A bucket of contexts: (rid, start, end) of repeats; strings of contexts that share their gram with another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        keys = table.column("key").combine_chunks()
        words = _words(keys, GRAM)
        before, order, rid, lo = (_column(table, c) for c in ("before", "ord", "rid", "lo"))
        size = pc.binary_length(keys).to_numpy()
        by = multikey_quicksort(words, [size, before, order, rid, lo])
        w, size, before, order, rid, lo = words[by], size[by], before[by], order[by], rid[by], lo[by]
        gram = (w[1:, : GRAM // 8] == w[:-1, : GRAM // 8]).all(axis=1)
        same = gram & (w[1:] == w[:-1]).all(axis=1) & (size[1:] == size[:-1]) & (before[1:] == before[:-1])
        repeat = np.append(False, same)
        yield pa.RecordBatch.from_arrays([pa.array(rid[repeat]), pa.array(lo[repeat]), pa.array(lo[repeat] + size[repeat]), pa.nulls(int(repeat.sum()), pa.binary()), pa.array(order[repeat])], ["rid", "start", "end", "string", "ord"])
        groups = np.cumsum(np.append(True, ~gram))
        heads = np.bincount(groups, weights=~repeat)[groups]
        edge = (groups == 1) | (groups == groups[-1])
        text = lambda k: (key := keys[int(by[k])].as_py())[len(key) - before[k] :] + key[: len(key) - before[k]]

        def stretches(at: np.ndarray, which: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
            """Of repeats (context, start), in order: one stretch a context, as all of them hold its gram."""
            new = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if which.size else np.empty(0, np.int64)
            first, last = start[new], start[np.append(new[1:], which.size) - 1] if which.size else start
            own = at[which[new]]
            return pa.RecordBatch.from_arrays([pa.array(rid[own]), pa.array(lo[own] + first), pa.array(lo[own] + last + length), pa.nulls(own.size, pa.binary()), pa.array(order[own])], ["rid", "start", "end", "string", "ord"])

        inner = np.flatnonzero(~repeat & (heads > 1) & ~edge)
        room = np.cumsum(size[inner] - length + 1) // _STRINGS
        cuts = np.flatnonzero(np.append(True, (groups[inner][1:] != groups[inner][:-1]) & (room[1:] != room[:-1]))) if inner.size else []
        for at in np.split(inner, cuts[1:]) if inner.size else []:
            which, start = _repeats([text(k) for k in at.tolist()], [order[at], rid[at], lo[at]], length)
            yield stretches(at, which, start)
        alike = ~repeat & edge
        alike[[0, -1]] = True
        for at in np.array_split(np.flatnonzero(alike), max(1, int(alike.sum()) // 1000)):
            texts = [text(k) for k in at.tolist()]
            which, start = _repeats(texts, [order[at], rid[at], lo[at]], length)
            yield stretches(at, which, start)
            known = set(zip(which.tolist(), start.tolist(), strict=True))  # the first of equal strings stands for them elsewhere
            rows = [(i, p, t[p : p + length]) for i, t in enumerate(texts) for p in range(len(t) - length + 1) if (i, p) not in known]
            i, p, strings = zip(*rows, strict=True)
            own, begin = at[list(i)], lo[at[list(i)]] + np.array(p, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rid[own]), pa.array(begin), pa.array(begin + length), pa.array(strings, pa.binary()), pa.array(order[own])], ["rid", "start", "end", "string", "ord"])

    return run


def _repeats(texts: list[bytes], place: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of each string that also starts earlier in these texts, sorted."""
    n = np.array([len(t) - length + 1 for t in texts])
    which = np.repeat(np.arange(n.size), n)
    start = np.arange(which.size) - np.repeat(np.cumsum(n) - n, n)
    all_ = np.frombuffer(b"".join(texts), np.uint8)
    at = np.repeat(np.cumsum(n + length - 1) - (n + length - 1), n) + start
    wide = np.zeros((at.size, -(-length // 8) * 8), np.uint8)
    wide[:, :length] = np.lib.stride_tricks.sliding_window_view(all_, length)[at]
    words = wide.view(">u8").astype(np.uint64)
    order, rid, lo = place
    by = multikey_quicksort(words, [order[which], rid[which], lo[which] + start])
    words = words[by]
    found = np.sort(by[1:][(words[1:] == words[:-1]).all(axis=1)])
    return which[found], start[found]


def _sort_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket of strings: (rid, start, end) of repeats; its first row with its first and last string, for the boundary."""
    table = _whole(batches)
    if table is None:
        return
    keys = table.column("string").combine_chunks()
    words = _words(keys, 8)
    order, rid, start, end = (_column(table, c) for c in ("ord", "rid", "start", "end"))
    by = multikey_quicksort(words, [order, rid, start])
    w, rid, start, end = words[by], rid[by], start[by], end[by]
    repeat = np.append(False, (w[1:] == w[:-1]).all(axis=1))
    n = int(repeat.sum())
    names = ["rid", "start", "end", "first", "last"]
    yield pa.RecordBatch.from_arrays([pa.array(rid[repeat]), pa.array(start[repeat]), pa.array(end[repeat]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names)
    yield pa.RecordBatch.from_arrays([pa.array(rid[:1]), pa.array(start[:1]), pa.array(end[:1]), pa.array([keys[int(by[0])].as_py()], pa.binary()), pa.array([keys[int(by[-1])].as_py()], pa.binary())], names)


def _rows(documents: DataFrame) -> DataFrame:
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    return documents.select("rid", F.col("doc_id").cast("long").alias("doc_id"), order.alias("ord"), F.col("text").cast("binary").alias("text"))


def repeated_runs(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(rid, runs): for the rows of ``documents`` (rid, doc_id, text) that repeat something, all repeated stretches (start, end) in bytes."""
    spark, rows = documents.sparkSession, _rows(documents)
    folder, n = scratch(spark, "suffixes"), 3 * partitions(spark)  # a bucket is held in memory

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        release(spark)
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    hashed = rows.select("rid", "text").mapInArrow(_hashed(length), "h long, rid long, n int")
    again = hashed.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    wanted = kept(hashed.join(again, "h").groupBy("rid").agg(F.collect_list("h").alias("hashes")), "wanted")
    contexts = rows.join(wanted, "rid").select("rid", "ord", "text", "hashes").mapInArrow(_contexts(length), "key binary, before int, ord long, rid long, lo long")
    contexts = kept(contexts, "contexts").repartitionByRange(n, F.substring("key", 1, GRAM), "ord", "rid", "lo")
    level1 = kept(contexts.mapInArrow(_sort_contexts(length), "rid long, start long, end long, string binary, ord long"), "level1")
    strings = level1.where("string is not null").select("string", "ord", "rid", "start", "end").repartitionByRange(n, "string", "ord", "rid", "start")
    level2 = strings.mapInArrow(_sort_strings, "rid long, start long, end long, first binary, last binary")
    level2 = kept(level2.withColumn("bucket", F.when(F.col("first").isNotNull(), F.spark_partition_id())), "level2")
    previous = F.lag("last").over(Window.orderBy("bucket"))  # a row for each bucket
    edges = level2.where("bucket is not null").withColumn("previous", previous).where("first = previous")
    parts = [level1.where("string is null"), level2.where("bucket is null"), edges]
    all_ = parts[0].select("rid", "start", "end")
    for p in parts[1:]:
        all_ = all_.unionByName(p.select("rid", "start", "end"))
    return all_.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("runs"))


def _merged(runs) -> list[tuple[int, int]]:
    if not runs.is_valid or not len(runs):
        return []
    start, end = runs.values.field("start").to_numpy(), runs.values.field("end").to_numpy()
    by = np.argsort(start, kind="stable")
    start, end = start[by], np.maximum.accumulate(end[by])
    new = np.append(True, start[1:] > end[:-1])
    return list(zip(start[new].tolist(), end[np.append(new[1:], True)].tolist(), strict=True))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        out = []
        for text, runs in zip(part.column("text").to_pylist(), part.column("runs"), strict=True):
            text, found, at, left = text or b"", _merged(runs), 0, []
            for a, b in found:
                left.append(text[at:a])
                at = b
            left.append(text[at:])
            kept = b"".join(left)
            out.append((len(text), len(text) - len(kept), len(found), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": b} for a, b in found]))
        cols = list(zip(*out, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"])


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary, removed): one row for each row of ``documents``."""
    documents = numbered(documents.select("doc_id", "text"))
    runs = repeated_runs(documents, length)
    rows = _rows(documents).join(runs, "rid", "left").select("doc_id", "text", "runs")
    return rows.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<struct<start:long,end:long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents", "doc_id", "text")).drop("kept", "removed")
