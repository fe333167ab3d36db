"""Co-training and language identification against plain versions of themselves."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dermotrace.llm import cotraining, language_id


def test_text_view_of_repetition():
    """Repetition is seen at any length: one sentence over and over, and random bytes, from kilobytes to megabytes."""
    rng = np.random.default_rng(1)
    alphabet = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    for n in (2_000, 100_000, 3_000_000):
        random_ = "".join(rng.choice(alphabet, n))
        same = ("the quick brown fox jumps over the lazy dog " * (n // 40))[:n]
        assert cotraining.text_view(random_)[9] > 1.4 and cotraining.text_view(same)[9] < 0.2
    assert cotraining.text_view(None).tolist() == cotraining.text_view("").tolist()


def test_text_view_against_plain():
    for text in ("Hello, World! 123\nÉté.", "aaaa aaaa", "x", "  \n\n", "😀 ok? yes; no: 'q'"):
        b, got = text.encode(), cotraining.text_view(text)
        if len(b) < 2:
            assert not got.any()
            continue
        kind = lambda c: 5 if chr(c) in ".,;:?'" else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c in (9, 32) else 4 if c in (10, 13) else 6 if 33 <= c < 127 and not chr(c).isalnum() else 0
        n = Counter(map(kind, b))
        assert np.allclose(got[:7], [4 * n[k] / len(b) for k in range(7)])
        assert got[8] == pytest.approx(math.log1p(10 * max(Counter(b).values()) / len(b)))
        grams = [b[i : i + 8] for i in range(len(b) - 7)]
        if grams:
            assert got[9] == pytest.approx(2 * len(set(grams)) / len(grams), abs=0.15)
        assert got[14:].size == cotraining.PAIRS and (got[14:] ** 2).sum() == pytest.approx(1, abs=1e-5)


def test_logistic_is_optimal():
    rng = np.random.default_rng(2)
    x, weight = rng.normal(size=(300, 4)).astype(np.float32), rng.uniform(0.3, 1, 300)
    y = (x @ [1, -2, 0.5, 0] + rng.normal(size=300) > 0).astype(int)
    w = cotraining.logistic(x, y, weight)
    one = np.hstack([x, np.ones((300, 1))])
    gradient = one.T @ (weight * (y - 1 / (1 + np.exp(-one @ w)))) - np.array([1, 1, 1, 1, 1e-6]) * w
    assert np.abs(gradient).max() < 1e-2


def plain_round(views, models, most, passed):
    out = []
    for i in (0, 1):
        p = 1 / (1 + np.exp(-np.clip(views[i] @ models[i][:-1] + models[i][-1], -30, 30)))
        for value in (0, 1):
            seen = {}
            for row in range(len(p)):
                sure = p[row] if value else 1 - p[row]
                key = views[0][row].tobytes() + views[1][row].tobytes()
                if sure >= cotraining.SURE and key not in passed[i]:
                    seen.setdefault(key, sure)
            out += [(i, value, round(float(s), 9)) for s in sorted(seen.values(), reverse=True)[: most[value]]]
    return sorted(out)


def test_surest_against_plain():
    rng = np.random.default_rng(3)
    views = [rng.normal(size=(400, 3)).astype(np.float32) * 3, rng.normal(size=(400, 2)).astype(np.float32) * 3]
    views = [np.concatenate((v, v[:100], v[:50])) for v in views]  # repeated contents count once
    models = [np.array([1.0, 0.5, -1.0, 0.1]), np.array([2.0, -1.0, 0.0])]
    got = cotraining.surest(views, models, (30, 45), [set(), set()])
    assert sorted((i, v, round(s, 9)) for i, v, s, _, _ in got) == plain_round(views, models, (30, 45), [set(), set()])
    passed = [{r[3] for r in got if r[0] == i} for i in (0, 1)]
    again = cotraining.surest(views, models, (30, 45), passed)
    assert not {(r[0], r[3]) for r in got} & {(r[0], r[3]) for r in again} and again


def test_fit_against_arrays(spark):
    """The Spark jobs make the same model as the arrays: every document is in the pool, repeated rows once, over any partitions."""
    rng, rows, marks = np.random.default_rng(4), [], []
    for i in range(240):
        good = int(rng.random() < 0.6)
        text = " ".join(rng.choice(["River", "stone.", "the", "light,", "walks"] if good else ["$$$", "!!", "0101", "CLICK", "x9"], 30))
        rows.append((i, text, "en" if rng.random() < 0.5 + 0.3 * good else "de", f"s{int(rng.integers(3)) + 2 * good}", len(text)))
        if i < 60:
            marks.append((i, good))
    rows += [rows[200]] * 5 + [(None, "River light, walks", None, None, 18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(marks, "doc_id long, label int")
    made = [cotraining.fit(cotraining.features(docs.repartition(n)).cache(), labels, passed=20) for n in (1, 7)]
    views = [np.array([cotraining.text_view(r[1]) for r in rows]), np.array([cotraining.meta_view(r[4], r[2], r[3]) for r in rows])]
    y = np.array([dict(marks).get(r[0], -1) for r in rows])
    folds = np.array([zlib.crc32(str(r[0]).encode()) % 5 for r in rows])
    want = cotraining.cotrain(views, y, folds, passed=20)
    for model in made:
        assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(model["models"], want["models"]))
        assert np.allclose(model["calibration"], want["calibration"], atol=1e-5) and np.allclose(model["gain"], want["gain"], atol=1e-6)
    got = {(r.doc_id, r.score) for r in cotraining.score_rows(cotraining.features(docs), want).collect()}
    z = [[a * (x @ np.array(w)[:-1] + w[-1]) + b for x in v] for v, w, (a, b) in zip(views, want["models"], want["calibration"])]
    top = max(want["gain"])
    for k, r in enumerate(rows):
        both = want["prior"] + sum((np.clip(zi[k], -99, 99) - want["prior"]) * g / top for zi, g in zip(z, want["gain"]))
        assert any(d == r[0] and abs(s - 1 / (1 + math.exp(-max(-30, min(30, both))))) < 2e-6 for d, s in got)


def test_one_labelled_document_on_many_rows(spark, monkeypatch):
    """A hundred thousand rows of a labelled doc_id, of many contents: one of them teaches, in whatever way they are dealt."""
    docs = spark.range(100_000).selectExpr("7L as doc_id", "concat('row ', id % 50000, ' stone') as text", "'en' as lang", "'s' as source", "id % 9 as n_chars")
    few = spark.range(400).selectExpr("id + 100 as doc_id", "if(id % 2 = 0, concat('River light ', id), concat('$$$ 0101 ', id)) as text", "'en' as lang", "concat('s', id % 2) as source", "id as n_chars")
    labels = spark.range(100).selectExpr("id + 100 as doc_id", "cast(1 - id % 2 as int) as label").unionByName(spark.sql("select 7L as doc_id, 1 as label"))
    rows = cotraining.features(docs.unionByName(few)).cache()
    brought = []
    real = cotraining.Trainer
    monkeypatch.setattr(cotraining, "Trainer", lambda views, y, folds, passed: brought.append(len(y)) or real(views, y, folds, passed))
    models = [cotraining.fit(rows.repartition(n), labels, rounds=1, passed=30) for n in (3, 1000)]
    assert brought == [101, 101]
    assert all(np.allclose(a, b) for a, b in zip(models[0]["models"], models[1]["models"]))
    rows.unpersist()


def test_first_of_each_group(spark):
    """The ranking in parts gives the ranking of all; contents that several tasks name come once."""
    rng = np.random.default_rng(6)
    found = [(int(rng.integers(2)), int(rng.integers(2)), float(rng.integers(5)) / 5, bytes([int(rng.integers(90))])) for _ in range(3000)]
    got = cotraining._first(spark.createDataFrame(found, "view int, value int, sure double, content binary").repartition(50), 25).collect()
    best = {}
    for i, v, s, c in found:
        best[i, v, c] = max(s, best.get((i, v, c), 0))
    for i in (0, 1):
        for v in (0, 1):
            order = sorted((-s, c) for (x, y, c), s in best.items() if (x, y) == (i, v))[:25]
            assert [bytes(r.content) for r in sorted(got, key=lambda r: r["rank"]) if (r.view, r.value) == (i, v)] == [c for _, c in order]


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    none = spark.createDataFrame([], "doc_id long, label int")
    rows = cotraining.features(docs)
    assert cotraining.fit(rows, none) == {"constant": 0.5}
    assert cotraining.fit(rows, spark.createDataFrame([(1, 1)], "doc_id long, label int")) == {"constant": 1.0}


def plain_counts(text):
    """Hashed 1-, 2- and 3-grams of letters with one space between words, one character at a time."""
    letter = lambda c: (97 <= c <= 122) or (c >= 0xC0 and not any(a <= c <= b for a, b in language_id._OTHER))
    w = [32]
    for c in map(ord, text.lower()):
        if letter(c):
            w.append(c)
        elif w[-1] != 32:
            w.append(32)
    if w[-1] != 32 or len(w) == 1:
        w.append(32)
    out, m = Counter(), 0xFFFFFFFF
    if len(w) < 3:
        return out
    top = lambda h: (h & m) >> (32 - language_id.BITS)
    for c in w[1:-1]:
        out[top(c * 0x165667B1)] += 1
    for a, b in zip(w, w[1:]):
        out[top(a * 0x9E3779B1 + b * 0x85EBCA77)] += 1
    for a, b, c in zip(w, w[1:], w[2:]):
        out[top((((a * 0x9E3779B1 + b * 0x85EBCA77) & m) * 0xC2B2AE3D) + c * 0x27D4EB2F)] += 1
    return out


TEXTS = ["Hello world", "été à la plage, 42 fois!", "Ärger über Öl", "日本語 テキスト", "x", "a b  c", "Mañana-mañana", "ends with space ", "1. item 2. item"]


@pytest.mark.parametrize("text", TEXTS)
def test_ngrams_against_plain(text):
    n = language_id.counts(text)
    got = {i: int(n[i]) for i in np.flatnonzero(n)}
    want = plain_counts(text)
    assert set(got) >= set(want) and sum(got.values()) - sum(want.values()) <= 6  # spaces at the ends may count
    assert all(got[k] >= v for k, v in want.items())


def test_languages_against_brute_force(spark, world):
    """Frequencies over every training document, unit centroids that are the means of their own texts, the nearest of all by cosine."""
    docs = spark.read.parquet(f"{world[0]}/documents.parquet").select("doc_id", "text", "lang")
    training = docs.where(language_id.fold("doc_id") != 2)
    model = language_id.fit(training)
    rows = [r for r in training.collect() if r.text is not None and r.lang is not None and r.doc_id is not None]
    seen = sum((language_id.counts(r.text) > 0).astype(int) for r in rows)
    assert np.allclose(model["idf"], np.log((1 + len(rows)) / (1 + seen)) + 1)
    c = model["centroids"]
    assert np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-5) and set(model["langs"]) == {"en", "fr"} and len(c) <= 2 * language_id.CENTROIDS
    for r in docs.collect():
        lang, score, rejected = language_id.classify(r.text, model)
        if not r.text or not re.search(r"[^\W\d_]", r.text):
            assert (lang, score, rejected) == ("und", 0.0, True)
            continue
        v = np.log1p(language_id.counts(r.text)) * model["idf"]
        cos = [float(np.dot(x, v)) / (math.sqrt(float(v @ v)) or 1) for x in c]
        assert score == pytest.approx(max(0, min(1, max(cos))), abs=1e-4)
        assert cos[[i for i, x in enumerate(model["langs"]) if x == lang][int(np.argmax([cos[i] for i, x in enumerate(model["langs"]) if x == lang]))]] >= max(cos) - 1e-6


def test_kmeans_against_plain():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3, 12))
    x = np.concatenate([b + rng.normal(size=(40, 12)) * 0.15 for b in base])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, cos = language_id.spherical_kmeans(x.astype(np.float32), 3)
    own = np.argmax(x @ c.T, axis=1)
    for i in range(3):
        mean = x[own == i].mean(axis=0)
        assert np.allclose(c[i], mean / np.linalg.norm(mean), atol=1e-4)
    assert sorted(Counter(own.tolist()).values()) == [40, 40, 40] and np.allclose(cos, x @ c.T, atol=1e-4)
