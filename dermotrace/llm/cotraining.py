"""Operator 5: a quality classifier by co-training.

Two views: the text's bytes (shares of kinds of characters, repetition, hashed byte pairs) and the page's metadata
(length, language, source). Each has a logistic classifier. In every round each classifier labels all documents that
teach nothing yet, and those that it is most sure of and hasn't passed on before join the training set of the other. Each
view is then calibrated on a held-out fold of labelled rows, and all documents are scored by the sum of the calibrated
log odds, weighted by each view's gain there.

Every text is read once, whole, into a table of features, which the rounds and the scores read. The classifiers are fitted
on about ``labelled`` labelled documents, chosen by a hash of the identifier, one row each, and on ``passed`` rows a round
from each view; these are bounded, and only their features reach the driver. In a round each task names its surest rows,
one for each content; names alone are shuffled, ranked in parts first and then among the first of all parts, and the
features of those picked are fetched by name.

Nulls: a null text is empty; null metadata is a category of its own; a null doc_id or label teaches nothing, but such a
row may be passed on. A document with several labels has the lowest, and of rows that share a labelled doc_id the one with
the least digest of its features teaches. With only one class, or no labels, every score is that class's share (0.5 if
none). Repeated rows are scored each and passed on once. Very long texts are read whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, read_table, scratch, slices
from .turns import kept

LABELLED = 6000
ROUNDS = 4
#: Rows that a classifier passes on in a round, split as the classes are, how sure it must be, and what they weigh.
PASSED = 1000
SURE, WEIGHT = 0.9, 0.3
#: Under this combined score a document is called poor.
THRESHOLD = 0.5
PAIRS = 256
SOURCES = 64
#: Grams of a text that are counted together.
STRETCH = 1 << 17

_KIND = np.zeros(256, np.uint8)  # 0 lower case and bytes from 0x80 on, 1 upper case, 2 digit, 3 space, 4 line end, 5 end of a sentence, 6 other marks
_KIND[65:91], _KIND[48:58], _KIND[[9, 32]], _KIND[[10, 13]] = 1, 2, 3, 4
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _KIND[_c] = 5 if chr(_c) in ".,;:?'" else 6


def text_view(text: str | None) -> np.ndarray:
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(PAIRS + 14, np.float32)
    if b.size < 2:
        return out
    out[:7] = np.bincount(_KIND[b], minlength=7) / b.size * 4
    words = max(1, int(np.count_nonzero(b == 32)))
    out[7] = min(4, b.size / words / 8)
    out[8] = np.log1p(np.bincount(b, minlength=256).max() / b.size * 10)
    if b.size >= 8:  # repetition in stretches: how many of the 8-byte grams are told apart by a hash of fitting size
        different = total = 0
        most = 0.0
        for at in range(0, b.size - 7, STRETCH):
            x = b[at : at + STRETCH + 7].astype(np.uint64)
            g = x[:-1] * np.uint64(0x9E3779B1) + x[1:]
            g = g[:-2] * np.uint64(0x85EBCA6B) + g[2:]
            g = (g[:-4] * np.uint64(0xC2B2AE35) + g[4:]) * np.uint64(0x9E3779B97F4A7C15)
            bits = max(8, int(g.size).bit_length() + 1)
            n = np.bincount((g >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
            different, total, most = different + np.count_nonzero(n), total + g.size, max(most, n.max() / g.size)
        out[9], out[10] = different / total * 2, np.log1p(most * 100)
    lines = max(1, int(np.count_nonzero(b == 10)))
    out[11] = min(4, np.log1p(b.size / lines) / 4)
    pairs = (b[:-1].astype(np.uint32) * np.uint32(0x9E3779B1) + b[1:].astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(24)
    n = np.bincount(pairs, minlength=PAIRS)
    out[14:] = np.sqrt(n / n.sum())
    return out


def meta_view(n_chars, lang, source) -> np.ndarray:
    out = np.zeros(16 + 16 + SOURCES, np.float32)
    out[min(15, int(np.log2(1 + max(0, n_chars or 0))))] = 1
    out[16 + zlib.crc32(str(lang).encode()) % 16] = 1
    out[32 + zlib.crc32(str(source).encode()) % SOURCES] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights, the last one for the constant; damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    w = np.zeros(x.shape[1])
    keep = np.full(w.size, ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(keep), x.T @ (weight * (y - p)) - keep * w)
        w += step * min(1, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return w


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def content(rows: list[bytes]) -> bytes:
    """A digest of the features of a row."""
    return hashlib.blake2b(b"".join(rows), digest_size=12).digest()


def surest(views: list[np.ndarray], models: list[np.ndarray], most: tuple[int, int], passed: list[set[bytes]], keys: list[bytes] | None = None) -> list[tuple[int, int, float, bytes, int]]:
    """(view, value, how sure, content, row): for each view and value up to ``most[value]`` contents that it hasn't passed on, the surest first."""
    out = []
    for i, x in enumerate(views):
        p = 1 / (1 + np.exp(-odds(x, models[i]))) if len(x) else np.empty(0)
        for value, sure in ((0, 1 - p), (1, p)):
            rows = np.flatnonzero(sure >= SURE)
            kept: dict[bytes, tuple] = {}
            last = 0.0
            for row in rows[np.argsort(-sure[rows], kind="stable")].tolist():
                if len(kept) >= most[value] and sure[row] < last:  # rows as sure as the last one go on: contents break ties
                    break
                key = keys[row] if keys else content([v[row].tobytes() for v in views])
                if key not in passed[i] and key not in kept:
                    kept[key] = (i, value, float(sure[row]), key, row)
                    last = sure[row]
            out += sorted(kept.values(), key=lambda r: (-r[2], r[3]))[: most[value]]
    return out


class Trainer:
    """The bounded part of co-training: labelled rows, what each view was given by the other, and the models made of them."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, folds: np.ndarray, passed: int = PASSED):
        """``folds``: 0 is held out for calibration."""
        self.views, self.y, self.train, self.held = views, y, folds != 0, folds == 0
        self.given: list[list[tuple[np.ndarray, int]]] = [[] for _ in views]
        self.passed: list[set[bytes]] = [set() for _ in views]
        self.able = len(set(y[self.train].tolist())) == 2
        self.rate = float(y[self.train].mean()) if self.able else 0.5
        self.most = (max(1, int(passed * (1 - self.rate))), max(1, int(passed * self.rate)))

    def models(self) -> list[np.ndarray]:
        out = []
        for x, given in zip(self.views, self.given, strict=True):
            more = np.array([g[0] for g in given]) if given else x[:0]
            y = np.concatenate((self.y[self.train], np.array([g[1] for g in given], np.int64)))
            weight = np.concatenate((np.ones(int(self.train.sum())), np.full(len(given), WEIGHT)))
            out.append(logistic(np.concatenate((x[self.train], more)), y, weight))
        return out

    def take(self, rows: list[tuple[int, int, bytes, list[np.ndarray]]]) -> None:
        """(view, value, content, features of both views): each goes to the other view."""
        for view, value, key, x in rows:
            self.given[1 - view].append((x[1 - view], value))
            self.passed[view].add(key)

    def finished(self) -> dict:
        """Models, calibrations on the held-out fold, and the gains there."""
        if not self.able:
            return {"constant": float(self.y.mean()) if self.y.size else 0.5}
        models, y = self.models(), self.y[self.held]
        out = {"models": [w.tolist() for w in models], "calibration": [], "gain": []}
        base = np.clip(y.mean() if y.size else self.rate, 1e-3, 1 - 1e-3)
        for x, w in zip(self.views, models, strict=True):
            if len(set(y.tolist())) < 2:
                out["calibration"].append([1.0, 0.0])
                out["gain"].append(1.0)
                continue
            z = odds(x[self.held], w)
            a, b = logistic(z[:, None].astype(np.float32), y, np.ones(y.size), ridge=0.01).tolist()
            p = np.clip(1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))), 1e-6, 1 - 1e-6)
            loss = lambda q: -np.mean(np.where(y == 1, np.log(q), np.log(1 - q)))
            out["calibration"].append([a, b])
            out["gain"].append(float(max(0.0, loss(np.full(p.size, base)) - loss(p))))
        out["prior"] = float(np.log(base / (1 - base)))
        return out


def cotrain(views: list[np.ndarray], y: np.ndarray, folds: np.ndarray, rounds: int = ROUNDS, passed: int = PASSED) -> dict:
    """Co-training of arrays: ``y`` is 0, 1, or -1 for rows without a label."""
    known = y >= 0
    trainer, pool = Trainer([v[known] for v in views], y[known], folds[known], passed), [v[~known] for v in views]
    for _ in range(rounds if trainer.able and len(pool[0]) else 0):
        found = surest(pool, trainer.models(), trainer.most, trainer.passed)
        trainer.take([(i, value, key, [v[row] for v in pool]) for i, value, _, key, row in found])
    return trainer.finished()


def score(text_x: np.ndarray, meta_x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(by text, by metadata, combined) for rows of features."""
    if "constant" in model:
        flat = np.full(len(text_x), model["constant"])
        return flat, flat, flat
    logit = [a * odds(x, np.array(w)) + b for x, w, (a, b) in zip((text_x, meta_x), model["models"], model["calibration"], strict=True)]
    prior, most = model.get("prior", 0.0), max(model["gain"]) or 1.0
    both = prior + sum((z - prior) * g / most for z, g in zip(logit, model["gain"], strict=True))
    return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (*logit, both))


def _features(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    meta = zip(*(part.column(c).to_pylist() for c in ("n_chars", "lang", "source")), strict=True)
    return np.array([text_view(x) for x in part.column("text").to_pylist()]), np.array([meta_view(*m) for m in meta])


def features(documents: DataFrame) -> DataFrame:
    """(doc_id, content, text_x, meta_x) for each row of ``documents`` (doc_id, text, lang, source, n_chars); content is a digest of the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            views = [[r.astype("<f4").tobytes() for r in v] for v in _features(part)]
            keys = [content(list(x)) for x in zip(*views, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, pa.binary()) for v in (keys, *views))], ["doc_id", "content", "text_x", "meta_x"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars")
    return rows.mapInArrow(run, "doc_id long, content binary, text_x binary, meta_x binary")


def _views(rows) -> list[np.ndarray]:
    """Arrays of the two columns of features."""
    return [np.frombuffer(b"".join(rows[c]), "<f4").reshape(-1, width) for c, width in (("text_x", PAIRS + 14), ("meta_x", 32 + SOURCES))]


def _surest_of_task(shared):
    """Of all rows of a task the surest: a list that is merged batch by batch, so that it stays short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, most, passed, taught = shared.value
        best: dict[tuple[int, int], dict[bytes, float]] = {(i, v): {} for i in (0, 1) for v in (0, 1)}
        ranked = lambda rows, value: sorted(rows.items(), key=lambda r: (-r[1], r[0]))[: most[value]]
        for part in batches:
            rows = part.to_pydict()
            new = [k for k, d in enumerate(rows["doc_id"]) if d is None or d not in taught]
            views = [x[new] for x in _views(rows)]
            for i, value, sure, key, _ in surest(views, models, most, passed, [rows["content"][k] for k in new]):
                best[i, value][key] = sure
            for (_, value), found in best.items():
                if len(found) > 2 * most[value]:
                    first = ranked(found, value)
                    found.clear()
                    found.update(first)
        out = [(i, value, sure, key) for (i, value), found in best.items() for key, sure in ranked(found, value)]
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.float64(), pa.binary()), strict=True)], ["view", "value", "sure", "content"])

    return run


def _first(found: DataFrame, most: int) -> DataFrame:
    """Of (view, value, sure, content) the first ``most`` contents of each view and value: first of each part by content, then of all parts."""
    once = found.groupBy("view", "value", "content").agg(F.max("sure").alias("sure"))
    parts = once.withColumn("part", F.pmod(F.xxhash64("content"), F.lit(partitions(found.sparkSession))))
    for keys in (["view", "value", "part"], ["view", "value"]):
        parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy(keys).orderBy(F.desc("sure"), "content"))).where(F.col("rank") <= most)
    return parts.select("view", "value", "rank", "content")


def fit(rows: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, passed: int = PASSED) -> dict:
    """``rows`` has what ``features`` gives and is read several times; ``labels`` doc_id and label (0 or 1)."""
    spark = rows.sparkSession
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("label").cast("int").alias("label"))
    part = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    share = labelled / max(1, known.count())
    chosen = rows.where(F.col("doc_id").isNotNull() & (part < share)).join(F.broadcast(known.where(part < share)), "doc_id")  # about ``labelled`` documents
    one = chosen.groupBy("doc_id").agg(F.min(F.struct("content", "text_x", "meta_x", "label")).alias("x")).select("doc_id", "x.text_x", "x.meta_x", "x.label")
    taught = one.toPandas().sort_values("doc_id", kind="stable")
    folds = np.array([zlib.crc32(str(i).encode()) % 5 for i in taught["doc_id"]], np.int64)
    trainer = Trainer(_views(taught), taught["label"].to_numpy(np.int64), folds, passed)
    ids = frozenset(taught["doc_id"].tolist())
    for _ in range(rounds if trainer.able else 0):
        shared = spark.sparkContext.broadcast((trainer.models(), trainer.most, trainer.passed, ids))
        found = rows.mapInArrow(_surest_of_task(shared), "view int, value int, sure double, content binary")
        first = [r for r in _first(found, max(trainer.most)).collect() if r["rank"] <= trainer.most[r["value"]]]  # ``passed`` rows of each view
        if not first:
            break
        names = spark.createDataFrame([(bytes(c),) for c in sorted({bytes(r.content) for r in first})], "content binary")
        got = rows.join(F.broadcast(names), "content", "left_semi").groupBy("content").agg(F.min(F.struct("text_x", "meta_x")).alias("x")).select("content", "x.text_x", "x.meta_x").collect()
        at = {bytes(r.content): [x[0] for x in _views({"text_x": [r.text_x], "meta_x": [r.meta_x]})] for r in got}
        trainer.take([(r.view, r.value, bytes(r.content), at[bytes(r.content)]) for r in sorted(first, key=lambda r: (r["view"], r["value"], r["rank"]))])
    return trainer.finished()


def score_rows(rows: DataFrame, model: dict) -> DataFrame:
    """(doc_id, text_score, meta_score, score) for each row of features."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            got = score(*_views(part.to_pydict()), shared.value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(np.round(s, 6)) for s in got)], ["doc_id", "text_score", "meta_score", "score"])

    return rows.select("doc_id", "text_x", "meta_x").mapInArrow(run, "doc_id long, text_score double, meta_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality").withColumnRenamed("quality", "label")
    rows = kept(features(docs), scratch(spark, "quality"), "features")
    return score_rows(rows, fit(rows, labels)).withColumn("good", F.col("score") >= THRESHOLD)
