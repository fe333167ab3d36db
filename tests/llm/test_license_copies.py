"""Copies of a license in one stretch, and gaps of any size."""

import random
import re

from dermotrace.llm import license_scan

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""


def hits(text):
    return license_scan.scan(text, *license_scan._prepared(license_scan.TEMPLATES))


def test_every_copy_is_found():
    for n in (1, 2, 3, 20):
        for before in ("", "This product includes the following software. "):
            got = hits(before + MIT * n)
            assert [h["license"] for h in got] == ["MIT"] * n, (n, before, got)
            assert all(a["end"] <= b["start"] for a, b in zip(got, got[1:]))


def test_damaged_copies_do_not_join():
    words = MIT.split()
    head = " ".join(words[:25] + words[29:])
    assert [h["license"] for h in hits(head + " " + MIT + head)] == ["MIT"] * 3


def test_a_failed_place_is_not_the_end():
    start = " ".join(MIT.split()[:12])
    got = hits(f"{start} of the software. {start} in the software. {MIT}")
    assert [h["license"] for h in got] == ["MIT"]


def test_loose_copies_are_none():
    """One word of six is less than the density asked for; four of five are enough."""
    loose = " ".join(f"{w} one two three four five" for w in MIT.split())
    assert hits(loose + " " + loose) == []
    near = " ".join(w if i % 8 else f"{w} one two" for i, w in enumerate(MIT.split()))
    assert [h["license"] for h in hits(near + " " + near)] == ["MIT", "MIT"]


def test_gap_of_any_size():
    rng = random.Random(3)
    for n in (20, 150):
        a, b = [[rng.choice("abcd") for _ in range(n)] for _ in range(2)]
        table = [[0] * (n + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(n):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        pairs = license_scan._common(a, b, 0, n, 0, n)
        assert len(pairs) == table[n][n] and all(a[i] == b[j] for i, j in pairs)
        assert license_scan.align(["x", *a, "y"], ["z", *b, "w"])


def test_rivals():
    """Each license is told from its relatives, whole and with words missing; a part of a license isn't the license."""
    texts = dict(license_scan.TEMPLATES[::-1])
    bsd3 = next(t for n, t in license_scan.TEMPLATES if n == "BSD-3-Clause")
    names = license_scan._BSD_NAMES
    bsd2 = bsd3.replace(names + " ", "")
    assert len(bsd2) < len(bsd3) and {"BSD-2-Clause", "ISC", "GPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"} <= set(texts)
    assert [h["license"] for h in hits(bsd2)] == ["BSD-2-Clause"]
    assert [h["license"] for h in hits(bsd3)] == ["BSD-3-Clause"]
    assert hits(bsd2[:250]) == []  # both BSD licenses begin with it
    for name, long, v in (("LGPL-2.1", "Lesser General", "2.1"), ("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("AGPL-3.0", "Affero General", "3")):
        notice = f"This library is free software; you can redistribute it and/or modify it under the terms of the GNU {long} Public License as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version."
        assert [h["license"] for h in hits(notice)] == [name]
        assert [h["license"] for h in hits(f"This work is licensed under the GNU {long} Public License, version {v}.")] == [name]
    for name, text in license_scan.TEMPLATES:
        if len(text.split()) > 60:
            noisy = " ".join(w for i, w in enumerate(text.split()) if i % 12 != 7 or re.search(r"\d", w))  # the version alone tells some apart
            assert {h["license"] for h in hits(noisy)} == {name}
