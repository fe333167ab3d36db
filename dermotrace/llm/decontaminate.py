"""Operator 2: benchmark decontamination with an Aho-Corasick automaton.

Texts are normalised to words (A-Z lower-cased; a word is a run of 0-9, a-z and characters from U+0080 on). Any ten
consecutive words of an item hold five that begin at a multiple of five, so one automaton over these blocks, with a
word as its letter, passes once over each document and meets every window of the benchmark. At each hit the windows
around it are looked up by a hash in a sorted table and then compared word by word. Words that lie in a window are mapped
back to character offsets of the original text.

The automaton has one node a word of the benchmark, not ten. It is built once in a worker and kept there for its other
tasks. A benchmark of up to ``block_bytes`` of text is one automaton; a larger one is dealt to several, item by item, and
the documents are scanned for each. Documents never leave their partition for one automaton.

Nulls: a null text has no words; an item with a null id or no words has no window. Rows with equal item_id are one item.
Repeated documents give a result row each. Very long texts are scanned whole, a batch at most some MB or one text. With
an empty benchmark no document is hit; without documents there are no rows.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, read_table, slices

WINDOW = 10
#: Text of the benchmark in one automaton: about 0.5 GB in a worker.
BLOCK_BYTES = 20_000_000

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TO_WORDS = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 0x80 else 32 for c in bytes(range(256)).lower())

SCHEMA = "rid long, doc_id long, n_words long, items array<string>, word_runs array<struct<start:int,end:int>>, spans array<struct<start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class Windows:
    """All windows of some items: ``n`` words each, or a whole item that has fewer."""

    def __init__(self, items: list[tuple[str, str]], n: int = WINDOW):
        import ahocorasick

        self.n, self.step = n, n // 2
        self.ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        self.known: dict[bytes, int] = {}
        texts, owner = [], []
        for item, text in items:
            if w := words(text):
                texts.append(np.array([self.known.setdefault(x, len(self.known) + 1) for x in w], np.uint32))
                owner.append(number[item])
        self.words = np.concatenate(texts) if texts else np.empty(0, np.uint32)
        rng = np.random.default_rng(17)
        self.mix = rng.integers(0, 1 << 63, len(self.known) + 1, np.uint64) * np.uint64(2) + np.uint64(1)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        # the block of an item of a whole window or more serves windows that begin up to ``step`` words before it;
        # a shorter item has one block at its start, with the lengths of the items that begin so
        blocks: dict[tuple[int, ...], set[int]] = defaultdict(set)
        place, size, of, at = [], [], [], 0
        for t, k in zip(texts, owner, strict=True):
            if t.size >= n:
                for b in range(0, t.size - self.step + 1, self.step):
                    blocks[tuple(t[b : b + self.step].tolist())].add(n)
                starts = np.arange(at, at + t.size - n + 1)
            else:
                blocks[tuple(t[: self.step].tolist())].add(t.size)
                starts = np.array([at])
            place.append(starts)
            size.append(np.full(starts.size, min(n, t.size)))
            of.append(np.full(starts.size, k))
            at += t.size
        for b, sizes in blocks.items():
            self.automaton.add_word(b, (len(b), tuple(sorted(sizes))))
        if blocks:
            self.automaton.make_automaton()
        one = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
        self.place, self.size, self.of = one(place), one(size), one(of)
        self.hash = np.empty(self.place.size, np.uint64)
        for m in np.unique(self.size):
            rows = self.size == m
            self.hash[rows] = self.hashed(self.words, self.place[rows], int(m))
        by = np.argsort(self.hash, kind="stable")
        self.place, self.size, self.of, self.hash = self.place[by], self.size[by], self.of[by], self.hash[by]

    def hashed(self, ids: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
        """A hash of the ``m`` words from each start on."""
        h = np.full(starts.size, m, np.uint64)
        for k in range(m):
            h = h * np.uint64(0x9E3779B97F4A7C15) + self.mix[ids[starts + k]]
            h ^= h >> np.uint64(29)
        return h

    def hits(self, w: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words, item number) of the windows in a document's words: each place with each of its items."""
        none = np.empty(0, np.int64)
        get = self.known.get
        ids = [get(x, 0) for x in w]
        starts: dict[int, set[int]] = defaultdict(set)
        if len(self.automaton):
            for end, (length, sizes) in self.automaton.iter(tuple(ids)):
                for m in sizes:
                    starts[m].update(range(end - length + 1 - self.step, end - length + 2) if m == self.n else (end - length + 1,))
        found = []
        ids = np.array(ids, np.uint32)
        for m, some in starts.items():
            at = np.array(sorted(s for s in some if 0 <= s <= ids.size - m), np.int64)
            h = self.hashed(ids, at, m)
            low, high = np.searchsorted(self.hash, h), np.searchsorted(self.hash, h, "right")
            many = high - low
            at, rows = np.repeat(at, many), np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            same = self.size[rows] == m
            for k in range(m):  # the hash only selects
                same[same] = ids[at[same] + k] == self.words[self.place[rows[same]] + k]
            found.append((at[same], self.size[rows[same]], self.of[rows[same]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none)


def offsets(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Character offsets in the original text of runs of words (first word, one past the last)."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.lower())]
    places = [0, *(p for a, b in runs for p in (at[a][0], at[b - 1][1]))]
    chars = np.cumsum([len(raw[i:j].decode("utf-8", "surrogatepass")) for i, j in pairwise(places)]).tolist()
    return [{"start": a, "end": b} for a, b in zip(chars[::2], chars[1::2], strict=True)]


def scan(text: str | None, found: Windows) -> tuple[int, list[str], list[tuple[int, int]]]:
    """Words of the text, items with a window in it, and the maximal runs of hit words."""
    w = words(text)
    first, size, of = found.hits(w)
    if not first.size:
        return len(w), [], []
    delta = np.zeros(len(w) + 1, np.int64)
    np.add.at(delta, first, 1)
    np.add.at(delta, first + size, -1)
    edge = np.diff(np.concatenate(([0], np.cumsum(delta)[:-1] > 0, [0])).astype(np.int8))
    return len(w), [found.ids[k] for k in np.unique(of)], list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


#: The automata that this worker has built, by the number of their broadcast. A worker holds the last one only.
_BUILT: dict[str, Windows] = {}


def _scanner(shared, name: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from dermotrace.llm import decontaminate as own  # the worker's module, not a copy that came with the task

        if name not in own._BUILT:
            own._BUILT.clear()
            own._BUILT[name] = own.Windows(shared.value, n)
        found = own._BUILT[name]
        for part in slices(batches, "text"):
            counts, items, word_runs, spans = [], [], [], []
            for text in part.column("text").to_pylist():
                size, ids, runs = scan(text, found)
                counts.append(size)
                items.append(ids)
                word_runs.append([{"start": a, "end": b} for a, b in runs])
                spans.append(offsets(text, runs) if runs else [])
            yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(word_runs, _SPAN), pa.array(spans, _SPAN)], ["rid", "doc_id", "n_words", "items", "word_runs", "spans"])

    return run


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks, one at least. The benchmark is a query set: the driver holds one block at a time."""
    block, used, any_ = [], 0, False
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text")
    for item, text in rows.orderBy("item_id", "text").toLocalIterator():
        size = len(text.encode("utf-8", "surrogatepass"))
        if block and used + size > block_bytes:
            yield block
            block, used, any_ = [], 0, True
        block.append((item, text))
        used += size
    if block or not any_:
        yield block


def _merged(runs: str) -> str:
    """SQL that joins overlapping and touching runs of a sorted array."""
    last = "element_at(a, -1)"
    longer = f"concat(slice(a, 1, size(a) - 1), array(named_struct('start', {last}.start, 'end', greatest({last}.end, x.end))))"
    return f"aggregate({runs}, cast(array() as array<struct<start:int,end:int>>), (a, x) -> if(size(a) > 0 and {last}.end >= x.start, {longer}, concat(a, array(x))))"


def decontaminate(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, n: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, spans) for each row of ``documents``; spans are character offsets."""
    sc = documents.sparkSession.sparkContext
    docs = numbered(documents.select("doc_id", "text"))
    scans = [docs.mapInArrow(_scanner(sc.broadcast(block), uuid.uuid4().hex, n), SCHEMA) for block in _blocks(benchmark, block_bytes)]
    found = scans[0]
    if len(scans) > 1:
        gathered = lambda c: F.array_sort(F.flatten(F.collect_list(c))).alias(c)  # noqa: E731  of one document: an array for each block
        found = reduce(DataFrame.unionByName, scans).groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), gathered("word_runs"), gathered("spans"))
        found = found.withColumns({c: F.expr(_merged(c)) for c in ("word_runs", "spans")})
    hit = F.expr("aggregate(word_runs, 0L, (n, x) -> n + x.end - x.start)")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
_PLACES = " UNION ALL ".join(
    f"SELECT rid, j, {m} AS m, k FROM (SELECT rid, j, array_to_string(list(x) OVER (PARTITION BY rid ORDER BY j ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING), ' ') AS k, n FROM u) WHERE j + {m - 1} <= n AND {m} IN (FROM lengths)"
    for m in range(1, WINDOW + 1)
)
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS k
  FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS m, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM win),
u AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j, len(w) AS n FROM d),
places AS ({_PLACES}),
hits AS (SELECT rid, j AS i, p.m, item_id FROM places p JOIN win ON win.m = p.m AND win.k = p.k),
items AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, item_id::varchar AS id FROM hits) GROUP BY rid),
covered AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT rid, i, m FROM hits)) GROUP BY rid)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN items USING (rid) LEFT JOIN covered USING (rid)
"""
