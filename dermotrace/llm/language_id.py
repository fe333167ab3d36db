"""Operator 9: language identification by nearest centroid.

A text's letters give hashed 1-, 2- and 3-gram counts; log counts times inverse document frequency, scaled to length one.
Document frequencies cover every training document. Each language has a few centroids: spherical k-means over a sample
of its training documents of about ``per_language`` rows that have letters, one Spark group a language; the model is some
centroids a language, so its size follows the number of languages, not that of documents. A text gets the language of the
nearest centroid by cosine; it is rejected under the floor of its size (``und`` if there is no letter at all, or nothing
to learn from). Floors come from texts that no centroid learned, whole and cut short: halfway between the cosines that
almost all of them reach with their own language and those that they reach with the best other language, as if their
own had been left out. Where the two overlap, as in short texts, the lower own cosine is the floor.

Nulls: a null text is ``und`` with score 0; rows with a null lang or a null doc_id teach nothing and are predicted.
Repeated rows are predicted each; columns named lang_pred, score or rejected are replaced. An empty table gives no rows. Texts are read whole, a million characters at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, slices

#: Hash buckets (two to the power), centroids of a language, training documents of a language for them.
BITS = 12
CENTROIDS = 4
PER_LANGUAGE = 1500
#: Up to so many languages their sizes are broadcast.
BROADCAST_LANGUAGES = 10_000
#: Every so manieth text of the sample measures floors and teaches no centroid; lengths to which it is also cut; share of own texts under a floor.
MEASURED, CUTS, TAIL = 4, (30, 100, 300, 1000), 0.01
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_CHUNK = 1 << 20
#: Code points from U+00C0 on that are no letters, by range.
_OTHER = ((0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x2BFF), (0x3000, 0x303F), (0xFE00, 0xFE6F), (0xFF00, 0xFF20), (0x1F000, 0x1FAFF))


def counts(text: str, bits: int = BITS) -> np.ndarray:
    """Hashed n-gram counts of the letters, with one space between words."""
    out = np.zeros(1 << bits, np.int64)
    for at in range(0, len(text), _CHUNK):
        c = np.frombuffer(text[at : at + _CHUNK].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = ((c >= 97) & (c <= 122)) | (c >= 0xC0)
        if c.size and c.max() >= 0xC0:
            for a, b in _OTHER:
                letter &= (c < a) | (c > b)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        w = np.concatenate(([32], np.where(letter, c, 32)[keep], [32])).astype(np.uint32)
        if w.size < 3:
            continue
        two = w[:-1] * np.uint32(0x9E3779B1) + w[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + w[2:] * np.uint32(0x27D4EB2F)
        for h in (w[1:-1] * np.uint32(0x165667B1), two, three):
            out += np.bincount(h >> np.uint32(32 - bits), minlength=1 << bits)
    return out


def vector(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (np.log1p(n) * idf).astype(np.float32)
    return v / (np.linalg.norm(v) or 1)


def _frequencies(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs = np.zeros(1 << bits, np.int64), 0
        for part in slices(batches, "text"):
            for text in part.column("text").to_pylist():
                df += counts(text, bits) > 0
                docs += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([docs, *df[at]], pa.int64())], ["bucket", "n"])

    return run


def _sampled(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = [counts(x, bits) for x in part.column("text").to_pylist()]
            at = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([r[a].astype(np.int32) for r, a in zip(rows, at, strict=True)], pa.list_(pa.int32()))], ["lang", "at", "n"])

    return run


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, cosine of each row with its own); starts from the row nearest to the mean, then from the farthest."""
    mean = x.mean(axis=0)
    chosen = [int(np.argmax(x @ mean))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, x @ c.T


def _cluster(shared, bits: int, k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        key = [np.asarray(a).tobytes() + np.asarray(n).tobytes() for a, n in zip(rows["at"], rows["n"], strict=True)]
        rows = rows.iloc[sorted(range(len(key)), key=key.__getitem__)]
        x = np.zeros((len(rows), 1 << bits), np.float32)
        for i, (at, n) in enumerate(zip(rows["at"], rows["n"], strict=True)):
            dense = np.zeros(1 << bits, np.int64)
            dense[at] = n
            x[i] = vector(dense, shared.value)
        x = x[x.any(axis=1)]  # texts without letters are near nothing and would be centroids of their own
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": []})
        c, _ = spherical_kmeans(x, k)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": [v.astype("<f4").tobytes() for v in c]})

    return run


def size(n: np.ndarray) -> int:
    """Class of a text's size: the power of two of its distinct n-grams."""
    return int(np.count_nonzero(n)).bit_length()


def _measured(shared):
    """(size, own, other): cosines of each text and its beginnings with its own language and the best other one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = np.array(model["langs"])
        for part in slices(batches, "text"):
            out = []
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                mine = langs == lang
                for cut in (*(c for c in CUTS if c < len(text)), len(text)):
                    n = counts(text[:cut], model["bits"])
                    if mine.any() and n.any():
                        cos = model["centroids"] @ vector(n, model["idf"])
                        out.append((size(n), float(cos[mine].max()), float(cos[~mine].max(initial=0.0))))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.float64()))], ["size", "own", "other"])

    return run


def floors(rows: list, sizes: int) -> np.ndarray:
    """The floor of each size, from (size, q, other): own cosine at the tail, other cosine at the opposite tail."""
    out = np.full(sizes, np.nan)
    for r in rows:
        out[r[0]] = (r[1] + r[2]) / 2 if r[1] > r[2] > 0 else r[1] / 2 if not r[2] else r[1]
    known = np.flatnonzero(~np.isnan(out))
    if not known.size:
        return np.zeros(sizes)
    # a size without texts has the floor of the nearest smaller one; none is measured under the smallest
    return np.array([out[known[known <= i][-1]] if (known <= i).any() else 0.0 for i in range(sizes)])


def fit(training: DataFrame, per_language: int = PER_LANGUAGE, k: int = CENTROIDS, bits: int = BITS) -> dict:
    """The model: languages, centroids, floors and idf. ``training`` has doc_id, text and lang."""
    spark = training.sparkSession
    rows = training.where("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    sums = rows.select("text").mapInArrow(_frequencies(bits), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(1 << bits)
    for r in sums:
        if r.bucket >= 0:
            n[r.bucket] = r.n
    docs = max([r.n for r in sums if r.bucket < 0], default=0)
    idf = np.log((1 + docs) / (1 + n)) + 1
    sizes = rows.groupBy("lang").count()
    place = F.pmod(F.xxhash64("doc_id", F.lit("centroids")), F.lit(1 << 20))
    share = place < F.lit(per_language * (1 << 20)) / F.col("count")
    few = sizes.count() <= BROADCAST_LANGUAGES  # a row for each language
    chosen = rows.join(F.broadcast(sizes) if few else sizes, "lang").where(share)
    apart = F.pmod(F.xxhash64("doc_id", F.lit("floors")), F.lit(MEASURED)) == 0
    groups = chosen.where(~apart).select("lang", "text").mapInArrow(_sampled(bits), "lang string, at array<int>, n array<int>").groupBy("lang")
    made = groups.applyInPandas(_cluster(spark.sparkContext.broadcast(idf), bits, k), "lang string, centroid binary").collect()
    made.sort(key=lambda r: (r.lang, r.centroid))
    model = {"idf": idf, "bits": bits, "langs": [r.lang for r in made], "centroids": np.array([np.frombuffer(r.centroid, "<f4") for r in made]).reshape(len(made), 1 << bits)}
    seen = chosen.where(apart).select("lang", "text").mapInArrow(_measured(spark.sparkContext.broadcast(model)), "size int, own double, other double")
    tails = seen.groupBy("size").agg(F.percentile("own", TAIL), F.percentile("other", 1 - TAIL)).collect()
    return model | {"floors": floors(tails, bits + 2)}


def classify(text: str | None, model: dict) -> tuple[str, float, bool]:
    """(language, cosine, rejected)."""
    if not text or not model["langs"] or not _LETTER.search(text):
        return UNKNOWN, 0.0, True
    n = counts(text, model["bits"])
    cos = model["centroids"] @ vector(n, model["idf"])
    best = int(np.argmax(cos))
    return model["langs"][best], float(min(1.0, max(0.0, cos[best]))), bool(cos[best] < model["floors"][size(n)])


def predict(documents: DataFrame, model: dict) -> DataFrame:
    """The columns of ``documents`` with lang_pred, score and rejected."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    documents = documents.drop("lang_pred", "score", "rejected")
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            got = [classify(x, shared.value) for x in part.column("text").to_pylist()]
            lang, score, rejected = zip(*got, strict=True)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    schema = T.StructType([*documents.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return documents.mapInArrow(run, schema)


def fold(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(docs.where(fold("doc_id") != 2))
    rows = docs.select("doc_id", F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"), "text")
    return predict(rows, model).drop("text")
