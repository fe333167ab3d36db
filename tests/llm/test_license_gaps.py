"""Patience alignment decides: against a plain restatement of it; strewn, shuffled and merely legal words are no license."""

import random
from collections import Counter
from pathlib import Path

import pytest

from dermotrace.llm import license_scan

READY = license_scan._prepared(license_scan.TEMPLATES)
LONG = [(n, t) for n, t in license_scan.TEMPLATES if len(license_scan.words(t)) >= license_scan.STATEMENT]
WHOLE = Path("/usr/share/common-licenses")


def lcs(a, b):
    """A longest common subsequence as pairs, by the table."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def plain(a, b):
    """Words matched by patience alignment, restated: equal ends, anchors of the longest increasing subsequence, gaps, LCS without anchors."""
    n = 0
    while a and b and a[0] == b[0]:
        a, b, n = a[1:], b[1:], n + 1
    while a and b and a[-1] == b[-1]:
        a, b, n = a[:-1], b[:-1], n + 1
    if not a or not b:
        return {n}
    once = [w for w in a if a.count(w) == 1 and b.count(w) == 1]
    if not once:
        return {n + lcs(a, b)}
    best = [(0, ())]
    for w in once:
        j = b.index(w)
        longest = max(m for m, way in best if not way or b.index(way[-1]) < j)
        best += [(m + 1, (*way, w)) for m, way in best if m == longest and (not way or b.index(way[-1]) < j)]
    most, out = max(m for m, _ in best), set()
    for m, way in best:
        if m == most:
            sums, i, j = {n + m}, 0, 0
            for w in (*way, None):
                k, x = (len(a), len(b)) if w is None else (a.index(w), b.index(w))
                sums = {s + more for s in sums for more in plain(a[i:k], b[j:x])}
                i, j = k + 1, x + 1
            out |= sums
    return out


@pytest.mark.parametrize("seed", range(300))
def test_alignment_against_plain_version(seed):
    """The matched words are those of the dealt method, whichever of equally long anchor sequences it takes."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnop"[: rng.randrange(2, 17)]
    a, b = ([rng.choice(letters) for _ in range(rng.randrange(0, 14))] for _ in range(2))
    pairs = license_scan.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p < q and x < y for (p, x), (q, y) in zip(pairs, pairs[1:]))
    assert len(pairs) in plain(a, b)


def test_alignment_is_not_the_longest_common_subsequence():
    """An anchor that is moved forces its gaps: five of six words are common, patience keeps fewer."""
    a, b = "x p q p q".split(), "p q p q x".split()
    assert lcs(a, b) == 4 and len(license_scan.align(a, b)) == 1


def test_without_alignment_no_hit(monkeypatch):
    name, text = LONG[0]
    assert license_scan.scan(text, *READY)
    monkeypatch.setattr(license_scan, "align", lambda text, template: [])
    assert license_scan.scan(text, *READY) == []


@pytest.mark.parametrize("share", [0.1, 0.3, 3, 40])
def test_foreign_words_in_the_middle(share):
    """A page of foreign words is no obstacle while the license is three quarters of the place."""
    for name, text in LONG:
        w = text.split()
        body = " ".join(w[: len(w) // 2] + [f"zq{i % 50}" for i in range(int(share * len(w)))] + w[len(w) // 2 :])
        hits = license_scan.scan(body, *READY)
        if share < 1:
            assert [(h["license"], h["coverage"]) for h in hits] == [(name, 1.0)], (name, share, hits)
        else:  # a half may hold the shorter notice, as a license of its own
            assert all(h["words"] < license_scan.COVERAGE * len(license_scan.words(text)) for h in hits), (name, share, hits)


def vocabulary():
    return sorted({w for _, t in license_scan.TEMPLATES for w in license_scan.words(t)})


@pytest.mark.parametrize("n", [3000, 10_000])
def test_strewn_words(n):
    rng = random.Random(n)
    every = [w for _, t in license_scan.TEMPLATES for w in license_scan.words(t)]
    assert license_scan.scan(" ".join(rng.choices(vocabulary(), k=n)), *READY) == []
    assert license_scan.scan(" ".join(rng.choices(every, k=n)), *READY) == []
    for name, text in LONG:  # its words in order, far from each other
        body = " ".join(f"{w} {' '.join(rng.choices(vocabulary(), k=12))}" for w in text.split())
        assert license_scan.scan(body, *READY) == [], name


def test_shuffled_clauses():
    rng = random.Random(4)
    for name, text in LONG:
        clauses = [c for c in text.replace(";", ",").replace(".", ",").split(",") if c.strip()]
        if len(clauses) < 8:
            continue
        body = []
        for _ in range(60):
            rng.shuffle(clauses)
            body += clauses if clauses != sorted(clauses) else []
        assert [h for h in license_scan.scan(", ".join(body), *READY) if h["words"] >= 100] == [], name


def test_legal_prose():
    """A contract of license words, clause after clause in new sentences."""
    rng = random.Random(8)
    parts = ["the software is provided to the licensee", "without warranty of merchantability or fitness", "under the terms of this agreement", "the copyright holder grants no rights", "in no event shall the licensor be liable for any claim", "redistribution requires written permission", "this license is governed by law", "copies of the software must retain the notice"]
    assert license_scan.scan(". ".join(rng.choice(parts) for _ in range(3000)), *READY) == []


def test_statements_are_dense():
    assert license_scan.scan("Released under the MIT License.", *READY)
    assert license_scan.scan("Released under the " + "other words " * 40 + "MIT License.", *READY) == []


def test_many_copies_of_a_statement():
    hits = license_scan.scan("Released under the MIT License. And more words. " * 2000, *READY)
    assert len(hits) == 2000 and all(h["license"] == "MIT" for h in hits)


def test_density_and_coverage_are_reported():
    name, text = LONG[0]
    w = text.split()
    body = " ".join(x if i % 5 else f"{x} zq" for i, x in enumerate(w))
    (hit,) = license_scan.scan(body, *READY)
    n = len(license_scan.words(text))
    assert hit["license"] == name and hit["coverage"] == 1.0 and hit["words"] == n
    assert hit["density"] == round(n / len(license_scan.words(body[hit["start"] : hit["end"]])), 4)


@pytest.mark.skipif(not WHOLE.is_dir(), reason="no whole licenses on this machine")
def test_whole_licenses(spark, tmp_path):
    """Templates from a folder of files and from a table; whole texts of thousands of words are told from their relatives."""
    names = [x for x in ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-1.1", "MPL-2.0", "Artistic", "CC0-1.0") if (WHOLE / x).is_file()]
    for x in names:
        (tmp_path / x).write_bytes((WHOLE / x).read_bytes())
    got = license_scan.load_templates(spark, str(tmp_path))
    assert [n for n, _ in got] == sorted(names)
    spark.createDataFrame([*got, (None, "x"), ("none", None)], "name string, text string").write.parquet(str(tmp_path / "t.parquet"))
    assert license_scan.load_templates(spark, str(tmp_path / "t.parquet")) == got
    texts = dict(got)
    noisy = lambda t: " ".join(w for i, w in enumerate(t.split()) if i % 10 != 3)
    rows = [(n, texts[n]) for n in names] + [(n, "before it some prose. " * 300 + noisy(texts[n]) + " after it") for n in names] + [("", texts[n][: len(texts[n]) // 3]) for n in names]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string").repartition(4)
    out = {r.doc_id: r.hits for r in license_scan.scan_licenses(docs, got).collect()}
    for i, (name, _) in enumerate(rows):
        assert [h["license"] for h in out[i]] == ([name] if name else []), (i, name, out[i])
    both = license_scan.scan(texts["GPL-2"] + "\n" + texts["Apache-2.0"], *license_scan._prepared(got))
    assert [h["license"] for h in both] == ["GPL-2", "Apache-2.0"]


def test_notices_and_whole_texts_of_the_defaults():
    count = Counter(n for n, _ in license_scan.TEMPLATES)
    assert {"Unlicense", "BSL-1.0", "Zlib", "ISC", "MIT"} <= set(count)
    for name in ("Unlicense", "BSL-1.0", "Zlib"):
        text = next(t for n, t in license_scan.TEMPLATES if n == name)
        assert [h["license"] for h in license_scan.scan(f"A preface. {text} The end.", *READY)] == [name]
