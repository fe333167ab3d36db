"""Operator 7: near-duplicate groups by SimHash and multi-index hashing.

Fingerprints are made in Arrow batches from whole texts and then collapsed to distinct values, so that exact copies
cost one row. A fingerprint has two 32-bit segments. If two fingerprints differ in at most four bits, one segment
differs in at most two; two Hamming balls of radius one around the two segment values then meet. So each fingerprint is
filed under the 33 values of the ball around each of its segments, and fingerprints that meet under a value are
compared in full. Rows sorted by value are compared in streams; each stretch of a stream gives a spanning forest
of its links instead of all pairs, which keeps the components and stays linear in the rows read.

A hot value, with over ``HOT`` distinct fingerprints, isn't held: its rows are passed on and filed again, now under the
value and the balls around the two 16-bit halves of their other segment (four bits or fewer there meet in the same way).
What meets there again is compared in blocks, and fingerprints that are joined already aren't compared any more.

Nulls and empty texts have no words: their fingerprint is zero and links like any other. A text of fewer words than a
shingle is one shingle. A null doc_id gets a row; it never names a component unless all of that component's ids are
null. Repeated rows give a result row each. Texts are read whole, at any length; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, read_table, slices, spread_join
from .components import components

SHINGLE = 4
SEED = 42
MAX_DISTANCE = 4
#: Distinct fingerprints of one value from which on they are filed again; links found before they are made a forest.
HOT, FOLD = 4000, 1 << 20


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    last = ends[-n:].tolist()
    first = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64, n)
    set_ = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        set_ += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_ * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fp = np.array([fingerprint(x, width) for x in part.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(documents: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) for each row."""
    return documents.select("doc_id", "text").mapInArrow(_fingerprints(width), "doc_id long, fp long")


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, root) with the same components as the given edges."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: u.size], ends[u.size :]
    root = np.arange(nodes.size)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    kept = root != np.arange(nodes.size)
    return nodes[kept], nodes[root[kept]]


def _segment(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """The segment of ``fp`` that is filed under ``key``."""
    return np.where(key >> np.uint64(32) == 1, fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF))


def _links(key: np.ndarray, fp: np.ndarray, distance: int, first_level: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of equal key; in each fold, rows whose key is one component so far are done.

    On the first level, fingerprints of one segment meet under all 33 values of its ball: only their own one counts.
    """
    segment = _segment(key, fp) if first_level else None
    us, vs, held = [fp[:0]], [fp[:0]], 0
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    group = np.repeat(np.arange(first.size), np.diff(np.append(first, key.size)))
    at, step = np.arange(key.size), 1
    while at.size:
        at = at[at < key.size - step]
        at = at[group[at] == group[at + step]]
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= distance]
        if first_level:
            near = near[(segment[near] != segment[near + step]) | (segment[near] == key[near] & np.uint64(0xFFFFFFFF))]
        us.append(fp[near])
        vs.append(fp[near + step])
        held += near.size
        if held > FOLD:
            a, b = forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [a], [b], a.size
            root = fp.copy()  # of a fingerprint that begins no edge of the forest: itself
            if a.size:
                by = np.argsort(a)
                place = np.minimum(np.searchsorted(a[by], fp), a.size - 1)
                found = a[by][place] == fp
                root[found] = b[by][place[found]]
            whole = np.minimum.reduceat(root, first) == np.maximum.reduceat(root, first)
            at = at[~whole[group[at]]]
        step += 1
    return np.concatenate(us), np.concatenate(vs)


def _meet(distance: int, hot: int | None):
    """Reads rows (key, fp) sorted by key: links (u, v). Of a key with over ``hot`` rows all are passed on as (u, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, passing = np.empty(0, np.uint64), np.empty(0, np.uint64), None

        def rows(u, v=None, key=None):
            empty = pa.nulls(u.size, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), empty if v is None else pa.array(v.view(np.int64)), empty if key is None else pa.array(key.view(np.int64))], ["u", "v", "key"])

        def out(key, fp):
            size = np.unique(key, return_inverse=True, return_counts=True)
            many = size[2][size[1]] > hot if hot else np.zeros(key.size, bool)
            if many.any():
                yield rows(fp[many], key=key[many])
            a, b = forest(*_links(key[~many], fp[~many], distance, hot is not None))
            yield rows(a, b)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate((key, batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)))
            fp = np.concatenate((fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
            if passing is not None:  # a hot key goes on
                n = int(np.argmax(key != passing)) if (key != passing).any() else key.size
                if n:
                    yield rows(fp[:n], key=key[:n])
                key, fp = key[n:], fp[n:]
                if not key.size:
                    continue
                passing = None
            whole = int(np.argmax(key == key[-1]))
            if whole >= 10_000:
                yield from out(key[:whole], fp[:whole])
                key, fp, whole = key[whole:], fp[whole:], 0
            if hot and key.size - whole > hot:
                if whole:
                    yield from out(key[:whole], fp[:whole])
                yield rows(fp[whole:], key=key[whole:])
                passing = key[-1]
                key, fp = key[:0], fp[:0]
        if key.size:
            yield from out(key, fp)

    return run


def _ball(value: Column, bits: int) -> Column:
    """The values within one bit of ``value``, itself first."""
    return F.array(value, *(value.bitwiseXOR(F.lit(1 << i).cast("long")) for i in range(bits)))


def links(distinct: DataFrame, distance: int = MAX_DISTANCE, hot: int = HOT) -> DataFrame:
    """(u, v): forests of the links between the distinct ``fp`` within ``distance`` bits (at most 5: radii 1 and 1)."""
    assert 0 <= distance <= 5
    fp, n = F.col("fp"), partitions(distinct.sparkSession)
    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    filed = distinct.select("fp", F.explode(F.concat(_ball(low, 32), F.transform(_ball(high, 32), lambda v: v + F.lit(1 << 32)))).alias("key"))
    met = filed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_meet(distance, hot), "u long, v long, key long")
    met = cut(met)
    again = met.where("key is not null").select(F.col("u").alias("fp"), "key")
    rows = again.count()
    if not rows:
        return met.select("u", "v")
    own = F.when(F.shiftrightunsigned("key", 32) == 0, low).otherwise(high)
    kinds = again.groupBy("key").agg(F.min(own).alias("least"), F.max(own).alias("most"), F.count("*").alias("_n"))
    alike = (F.col("least") == F.col("most")) & (F.col("least") != F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)))  # they meet under their own value
    again = spread_join(again, kinds.where(~alike).select("key", "_n"), ["key"], ["fp"], rows)
    other = F.when(F.shiftrightunsigned("key", 32) == 0, high).otherwise(low)  # the segment that the key isn't of
    halves = F.concat(_ball(other.bitwiseAND(F.lit(0xFFFF)), 16), F.transform(_ball(F.shiftrightunsigned(other, 16), 16), lambda v: v + F.lit(1 << 16)))
    finer = again.select("fp", "key", F.explode(halves).alias("half")).select("fp", F.xxhash64("key", "half").alias("key"))
    more = finer.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_meet(distance, None), "u long, v long, key long")
    return met.where("v is not null").select("u", "v").unionByName(more.select("u", "v"))


def near_duplicates(documents: DataFrame, width: int = SHINGLE, distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fp long, component_id) for each row of ``documents``."""
    made = cut(fingerprints(documents, width))
    distinct = cut(made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("_n")))
    roots = components(links(distinct.select("fp"), distance))
    linked = distinct.join(roots, distinct.fp == roots.node).select("fp", "least", "root", "_n")
    size = made.count()
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_n"))
    of = spread_join(linked.withColumnRenamed("_n", "n"), named, ["root"], ["fp"], size).select("fp", "component_id", F.col("n").alias("_n"))
    alone = distinct.join(roots, distinct.fp == roots.node, "left_anti").select("fp", F.col("least").alias("component_id"), "_n")
    return spread_join(made, of.unionByName(alone), ["fp"], ["doc_id"], size).select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
