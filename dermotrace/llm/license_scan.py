"""Operator 8: license scans by patience alignment.

A text and each license template are lower-cased words. Word triples (pairs in one-line statements) that a template holds
once say where in a text it may lie: chains of them in the order of the template, in which words put in or left out cost,
are its places; they don't overlap, so copies that follow one another are places of their own. A place is then aligned
with the template, and this alone decides: equal heads and tails first, then words that are unique in both, whose longest
increasing subsequence fixes the alignment; the gaps between are aligned in turn, and those without a unique word by
longest common subsequence. Coverage is the share of the template's words that are matched, density the share of the
place's words that are; ``COVERAGE`` and ``DENSITY`` or more are a hit, so that foreign words may make up a quarter of a
place, in one piece or in many; words that are strewn over a text, and clauses in another order, are no license.

Templates are a parameter: ``TEMPLATES``, or any (name, text) that ``load_templates`` reads from a table or a folder of
license files, whole texts of any length.

A text that lacks all trigger words of all templates can't reach the coverage and isn't split into words.

Nulls and empty texts have no license; very long texts are scanned whole. Repeated rows give a result row each. Of
overlapping hits the one with most words wins, each counted with its template's coverage; of equal ones the first template
in order of name. Templates without words are left out. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices

#: Whole texts of short public licenses, whole notices of long ones, one-line statements.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"
#: (name, license in words, version) of the GNU licenses.
_GNU = (("AGPL-3.0", "Affero General Public License", "3"), ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"))
_CC = (("CC-BY-4.0", "BY", "Attribution"), ("CC-BY-NC-4.0", "BY-NC", "Attribution-NonCommercial"), ("CC-BY-NC-ND-4.0", "BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"), ("CC-BY-NC-SA-4.0", "BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("CC-BY-ND-4.0", "BY-ND", "Attribution-NoDerivatives"), ("CC-BY-SA-4.0", "BY-SA", "Attribution-ShareAlike"))
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES} {_BSD_END}"),
    *((name, f"Licensed under CC {short} 4.0.") for name, short, _ in _CC),
    *((name, f"This work is licensed under a Creative Commons {long} 4.0 International License.") for name, _, long in _CC),
    *((name, f"This work is licensed under the GNU {long}, version {v}.") for name, long, v in _GNU),
    *((name, f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {long} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. {_WARRANTY} GNU {long} for more details. You should have received a copy of the GNU {long} along with this program. If not, see https://www.gnu.org/licenses/.") for name, long, v in _GNU),
    *((name, f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {long} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.") for name, long, v in _GNU),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("ISC", "Released under the ISC License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org/'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)
COVERAGE, DENSITY = 0.8, 0.75
#: Templates of so many words are licenses or notices, with triples as seeds; shorter ones are statements, with pairs.
STATEMENT = 20
#: A word put in or left out between two seeds costs so many seeds.
SHIFT = 0.25
#: Templates are broadcast with the tasks: no more characters than this in all.
MOST_CHARACTERS = 8 << 20

_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence (pairs sorted by the first) with increasing second, by patience sorting."""
    tops, piles, back = [], [], [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back[i] = piles[k - 1] if k else -1
        tops[k : k + 1], piles[k : k + 1] = [b], [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _common(text: list[str], template: list[str], a: int, b: int, x: int, y: int) -> list[tuple[int, int]]:
    """Longest common subsequence of text[a:b] and template[x:y] (Hunt and Szymanski)."""
    places: dict[str, list[int]] = {}
    for j in range(y - 1, x - 1, -1):
        places.setdefault(template[j], []).append(j)
    return _increasing([(i, j) for i in range(a, b) for j in places.get(text[i], ())])


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched (text word, template word), increasing in both."""
    out, stack = [], [(0, len(text), 0, len(template))]
    while stack:
        a, b, x, y = stack.pop()
        while a < b and x < y and text[a] == template[x]:
            out.append((a, x))
            a, x = a + 1, x + 1
        while a < b and x < y and text[b - 1] == template[y - 1]:
            b, y = b - 1, y - 1
            out.append((b, y))
        if a == b or x == y:
            continue
        here, there = Counter(text[a:b]), Counter(template[x:y])
        place = {w: j for j, w in enumerate(template[x:y], x) if there[w] == 1}
        anchors = _increasing([(i, place[w]) for i, w in enumerate(text[a:b], a) if here[w] == 1 and w in place])
        if anchors:
            for (i, j), (k, m) in zip([(a - 1, x - 1), *anchors], [*anchors, (b, y)], strict=True):
                stack.append((i + 1, k, j + 1, m))
            out += anchors
        else:
            out += _common(text, template, a, b, x, y)
    return sorted(out)


class Template(NamedTuple):
    name: str
    words: list[str]
    need: int
    grams: int
    seeds: int


class Ready(NamedTuple):
    """Templates, and for each seed (words of two or three) its templates and places in them."""

    templates: list[Template]
    seeds: dict[tuple[str, ...], list[tuple[int, int]]]


def chains(hits: list[tuple[int, int]], size: int, least: int) -> list[list[tuple[int, int]]]:
    """Best chains of ``least`` seeds or more (text word, template word), increasing in both, that don't overlap.

    Between seeds, the difference of their distances in text and template costs ``SHIFT`` a word. Seeds of the last
    ``size`` words, more than which no place has of foreign words, are tried as long as a better one is possible.
    """
    score, back, top = [], [], []  # top: the best score so far
    gone = 0
    for x, (i, j) in enumerate(hits):
        while hits[gone][0] < i - size:
            gone += 1
        best, of, y = 0.0, -1, x - 1
        while y >= gone and top[y] > best:
            a, b = hits[y]
            if b < j and (value := score[y] - SHIFT * abs(i - a - j + b)) > best:
                best, of = value, y
            y -= 1
        score.append(best + 1)
        back.append(of)
        top.append(max(best + 1, top[-1] if top else 0))
    used = [False] * len(hits)
    taken: list[tuple[int, int]] = []
    out = []
    for x in sorted(range(len(hits)), key=lambda x: (-score[x], x)):
        chain = []
        while x >= 0 and not used[x]:
            chain.append(x)
            x = back[x]
        if len(chain) < least:
            continue
        span = (hits[chain[-1]][0], hits[chain[0]][0])
        k = bisect_left(taken, span)
        if (k and taken[k - 1][1] >= span[0]) or (k < len(taken) and taken[k][0] <= span[1]):
            continue
        taken.insert(k, span)
        for y in chain:
            used[y] = True
        out.append([hits[y] for y in reversed(chain)])
    return sorted(out)


def found(text: list[str], chain: list[tuple[int, int]], of: Template, floor: int, end: int) -> tuple[int, int, int, float] | None:
    """(start, end, words matched, density) of the place around a chain, within floor and end, by patience alignment."""
    (i, j), (a, b) = chain[0], chain[-1]
    first = max(floor, i - math.ceil(j / DENSITY))
    last = min(end, a + math.ceil((len(of.words) - b) / DENSITY))
    pairs = align(text[first:last], of.words)
    if len(pairs) < of.need:
        return None
    density = len(pairs) / (pairs[-1][0] - pairs[0][0] + 1)
    return (first + pairs[0][0], first + pairs[-1][0] + 1, len(pairs), density) if density >= DENSITY else None


def _grams(w: list[str], n: int) -> Iterator[tuple[str, ...]]:
    return zip(*(w[i:] for i in range(n)))


def _prepared(templates: Iterable[tuple[str, str]]) -> tuple[Ready, list[str]]:
    """The templates with their seeds; trigger words: one of them is in any text with a hit."""
    ready, triggers, seeds = [], set(), defaultdict(list)
    for name, text in sorted(templates):
        w = words(text)
        if not w:
            continue
        n = min(len(w), 3 if len(w) >= STATEMENT else 2)
        once = Counter(_grams(w, n))
        own = [(g, j) for j, g in enumerate(_grams(w, n)) if once[g] == 1]
        for g, j in own:
            seeds[g].append((len(ready), j))
        need = math.ceil(COVERAGE * len(w))
        # so many seeds stay if words are left out up to the coverage, half of them if words are put in too
        ready.append(Template(name, w, need, n, max(1, (len(own) - (len(w) - need) * n) // 2)))
        left, count = len(w), Counter(w)
        for t in sorted(count, key=lambda t: (t not in triggers, "licen" not in t, -len(t), t)):
            if left < need:
                break
            left -= count[t]
            triggers.add(t)
    return Ready(ready, dict(seeds)), sorted(triggers)


def scan(text: str | None, ready: Ready, triggers: list[str]) -> list[dict]:
    """Hits in order of place: license, coverage, density, start and end (characters)."""
    low = (text or "").lower()
    if not any(t in low for t in triggers):
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    w = [text[a:b].lower() for a, b in at]
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for n in sorted({t.grams for t in ready.templates}):
        for i, g in enumerate(_grams(w, n)):
            for t, j in ready.seeds.get(g, ()):
                if ready.templates[t].grams == n:
                    hits[t].append((i, j))
    every: list[dict] = []
    for t, places in sorted(hits.items()):
        of = ready.templates[t]
        if len(places) < of.seeds:
            continue
        picked = chains(places, len(of.words), of.seeds)
        floor = 0
        for chain, after in zip(picked, [*picked[1:], None]):
            got = found(w, chain, of, floor, len(w) if after is None else after[0][0])
            floor = chain[-1][0] + of.grams
            if got:
                i, j, n, density = got
                floor = max(floor, j)
                every.append({"license": of.name, "coverage": round(n / len(of.words), 4), "density": round(density, 4), "start": at[i][0], "end": at[j - 1][1], "words": n})
    ranked = sorted(every, key=lambda h: (-h["words"] * h["coverage"], -h["words"], h["start"]))
    kept: list[dict] = []  # in order of place
    starts: list[int] = []
    for h in ranked:  # of overlapping hits the one with most words, each counted with the coverage of its whole template
        k = bisect_left(starts, h["end"])
        if not k or kept[k - 1]["end"] <= h["start"]:
            kept.insert(k, h)
            starts.insert(k, h["start"])
    return kept


def load_templates(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, text) of a Parquet table with these columns, or of a folder of text files, each named after its license.

    Nulls are left out, and repeated rows come once. The size is checked: templates travel with the tasks.
    """
    if path.rstrip("/").endswith(".parquet"):
        rows = spark.read.parquet(path).select(F.col("name").cast("string").alias("name"), F.col("text").cast("string").alias("text"))
    else:
        rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"))
    rows = rows.where("name is not null and text is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > MOST_CHARACTERS:
        raise ValueError(f"{size} characters of templates; {MOST_CHARACTERS} is the limit")
    return sorted((r["name"], r["text"]) for r in rows.collect())


_HIT = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("density", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())])


def scan_licenses(documents: DataFrame, templates: Iterable[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, hits) for each row of ``documents``; offsets are characters of the original text."""
    ready, triggers = _prepared(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hits = [scan(x, ready, triggers) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(hits, pa.list_(_HIT))], ["doc_id", "hits"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, hits array<struct<license:string,coverage:double,density:double,start:int,end:int,words:int>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its licenses (sorted, comma-joined), hits, best coverage, least density and words they cover."""
    out = scan_licenses(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    names = F.array_join(F.array_sort(F.array_distinct("hits.license")), ",")
    return out.select("doc_id", names.alias("licenses"), F.size("hits").cast("long").alias("n_hits"), F.coalesce(F.array_max("hits.coverage"), F.lit(0.0)).alias("coverage"), F.coalesce(F.array_min("hits.density"), F.lit(0.0)).alias("density"), F.expr("aggregate(hits, 0L, (n, x) -> n + x.words)").alias("n_words"))
