"""License scan by the Dice coefficient over word bigrams.

A passage is a line of a text, or the whole text. Words are runs of ASCII
letters and digits in lower case; all else is dropped by the normalisation. A
passage matches a template if

    2 * |common bigrams| / (bigrams of the passage + bigrams of the template)

reaches the threshold t, with repeated bigrams counted as often as both have
them. As no more bigrams can be common than the smaller side has, only
templates whose size is between n * t / (2 - t) and n * (2 - t) / t are
candidates for a passage of n bigrams.

Notices that are wrapped over lines or stand among other words are found by
windows over all words of the text, without regard to lines. These are compared
with ``BODIES`` too. A window that matches a template of m bigrams has at least
m * t / (2 - t) of them; so of any more than m - m * t / (2 - t) bigrams of the
template it has one. The least common ones are looked up, and each window that
begins and ends near such a place is scored exactly. Of windows that overlap,
the best is a passage too. A window in a line or text that matches counts only
if it matches better, and another licence.

Null and empty texts match nothing. Each row is judged for itself. A passage
may match several templates; all are reported. A whole text of one line counts
once.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import blocks

THRESHOLD = 0.8

#: Notices by which works are put under a licence.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, "
    "either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
)

#: Whole licences, and the notices that the longest ones (Apache, GNU) give at their end. Windows only are compared with them.
BODIES = [
    ("AGPL-3.0", _GNU.format("Affero General Public License", 3)),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the "
     "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
     "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", _BSD + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
     "without specific prior written permission. " + _BSD_WARRANTY),
    ("GPL-2.0", _GNU.format("General Public License", 2)),
    ("GPL-3.0", _GNU.format("General Public License", 3)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
     "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
     "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
     "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", 3)),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
     "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
     "whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
     "portions of the Software. " + _WARRANTY + "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
     "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
     "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this "
     "software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
     "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _WARRANTY
     + "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
     "DEALINGS IN THE SOFTWARE."),
]

#: Words that make a bigram a poor one to look up.
_COMMON = frozenset(b"a an and any are as at be by for from in is it may must no not of on or that the this to under use with without you".split())

_WORD = re.compile(rb"[A-Za-z0-9]+")


def words(passage: bytes) -> list[bytes]:
    return [w.lower() for w in _WORD.findall(passage)]


class Templates:
    """Templates by size, and by the bigrams they have."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        sets = []
        for name, text in templates:
            w = words(text.encode())
            sets.append((len(w) - 1, name, Counter(zip(w, w[1:]))))
        sets.sort(key=lambda s: (s[0], s[1]))
        self.sizes, self.threshold = [s[0] for s in sets], threshold
        self.names, self.counts = [s[1] for s in sets], [s[2] for s in sets]
        self.having: dict[tuple, list[int]] = {}
        for i, c in enumerate(self.counts):
            for b in c:
                self.having.setdefault(b, []).append(i)

    def matches(self, w: list[bytes]) -> list[tuple[str, float]]:
        n, t = len(w) - 1, self.threshold
        if n < 1:
            return []
        lo, hi = bisect_left(self.sizes, n * t / (2 - t) - 1e-9), bisect_right(self.sizes, n * (2 - t) / t + 1e-9)
        if lo == hi:
            return []
        seen = Counter(b for b in zip(w, w[1:]) if b in self.having)
        common = Counter()
        for b, k in seen.items():
            for i in self.having[b]:
                if lo <= i < hi:
                    common[i] += min(k, self.counts[i][b])
        scored = ((self.names[i], 2 * c / (n + self.sizes[i])) for i, c in common.items())
        return [(name, d) for name, d in scored if d >= t]


class Windows:
    """Templates by their least common bigrams, of which each matching window has one."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.threshold, self.templates, self.at = threshold, [], {}
        bags = [(name, list(zip(w, w[1:]))) for name, w in ((name, words(text.encode())) for name, text in templates)]
        shared = Counter(b for _, grams in bags for b in set(grams))
        for i, (name, grams) in enumerate(bags):
            m = len(grams)
            need = math.ceil(m * threshold / (2 - threshold) - 1e-9)
            self.templates.append((name, m, need, math.floor(m * (2 - threshold) / threshold + 1e-9), Counter(grams)))
            rare = sorted(grams, key=lambda b: ((b[0] in _COMMON) + (b[1] in _COMMON), shared[b], b))
            for b in set(rare[: m - need + 1]):
                self.at.setdefault(b, []).append(i)

    def matches(self, w: list[bytes]) -> list[tuple[float, int, int, str]]:
        """(dice, first word, word after the last, licence) of each start's best window."""
        at, places = self.at, {}
        for p, b in enumerate(zip(w, w[1:])):
            if b in at:
                for i in at[b]:
                    places.setdefault(i, []).append(p)
        return [hit for i, near in places.items() for hit in self._near(w, i, near)]

    def _near(self, w: list[bytes], i: int, near: list[int]) -> Iterator[tuple[float, int, int, str]]:
        name, m, need, most, counts = self.templates[i]
        end, spans = len(w) - 1, []
        for p in near:
            a, b = max(0, p - most + 1), min(end, p + most)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        for a, b in spans:
            grams = list(zip(w[a:b], w[a + 1 : b + 1]))
            known = [g in counts for g in grams]
            before = [0, *accumulate(known)]
            for s, fits in enumerate(known):  # the best window begins and ends with a bigram of the template
                if not fits or before[min(s + most, len(grams))] - before[s] < need:
                    continue
                left, c, best = dict(counts), 0, None
                for e in range(s, min(s + most, len(grams))):
                    if known[e] and left[grams[e]]:
                        left[grams[e]] -= 1
                        c += 1
                        dice = 2 * c / (e - s + 1 + m)
                        if dice >= self.threshold and (best is None or dice > best[0]):
                            best = dice, a + s, a + e + 2, name
                if best:
                    yield best


def _apart(hits: list[tuple[float, int, int, str]]) -> list[tuple[float, int, int, str]]:
    """The best hits that overlap no better one, in their order."""
    kept, spans = [], []
    for hit in sorted(hits, key=lambda h: (-h[0], h[1] - h[2], h[1], h[3])):
        a, b = hit[1:3]
        k = bisect_left(spans, (b, b))
        if not k or spans[k - 1][1] <= a:
            insort(spans, (a, b))
            kept.append(hit)
    return sorted(kept, key=lambda h: h[1])


def _elsewhere(windows, starts: list[int], hits: list[tuple[str, float, int]], whole: list[tuple[str, float, None]]) -> Iterator[tuple[float, int, int, set[str]]]:
    """Windows that match better than what they overlap, each with the licences found there already."""
    lines = sorted(hits, key=lambda h: h[2])
    numbers = [h[2] for h in lines]
    for dice, a, b, name in windows:
        first, last = bisect_right(starts, a) - 1, bisect_left(starts, b) - 1
        there = whole + lines[bisect_left(numbers, first) : bisect_right(numbers, last)]
        if all(name != n and dice > d for n, d, _ in there):
            yield dice, a, b, {n for n, _, _ in there}


def _scan(templates: list[tuple[str, str]], threshold: float, bodies: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, every, anywhere = Templates(templates, threshold), Templates([*templates, *bodies], threshold), Windows([*templates, *bodies], threshold)
        found_type = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("line", pa.int32())]))
        for part in blocks(batches, 1):
            found = []
            for text in part.column(1).cast(pa.binary()).to_pylist():
                lines = (text or b"").split(b"\n")
                split = [words(x) for x in lines]
                hits = [(name, dice, i) for i, w in enumerate(split) for name, dice in known.matches(w)]
                flat = [x for w in split for x in w]
                whole = [(name, dice, None) for name, dice in known.matches(flat)] if len(lines) > 1 else []
                if windows := anywhere.matches(flat):
                    starts = [0, *accumulate(map(len, split))]
                    found_there = list(_elsewhere(windows, starts, hits, whole))
                    names = {(a, b): there for _, a, b, there in found_there}
                    for _, a, b, _ in _apart([(dice, a, b, "") for dice, a, b, _ in found_there]):
                        line = bisect_right(starts, a) - 1
                        hits += [(name, dice, line) for name, dice in every.matches(flat[a:b]) if name not in names[a, b]]
                hits += whole
                found.append([{"license": a, "dice": b, "line": c} for a, b, c in hits])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, found_type)], ["id", "found"])

    return run


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, bodies=BODIES) -> DataFrame:
    """One row per row of ``docs``: its id and found, an array of (license, dice, line).

    line is the first line of a window, and null for the whole text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scanned = rows.mapInArrow(_scan(list(templates), threshold, list(bodies)), "id long, found array<struct<license:string,dice:double,line:int>>")
    return scanned.withColumnRenamed("id", id_col)
