"""Licence scans: normalised text compared to licence templates by the Dice coefficient over word bigrams.

A text's lines, its paragraphs (lines without an empty one between), runs of consecutive paragraphs and the whole text
are units.  Words are lower-cased runs of letters, digits and bytes beyond ASCII, so case, punctuation and layout don't
count.  A unit is compared with the templates whose number of bigrams is in the range that the least coefficient allows.
Units without a bigram of any template are passed over, which loses nothing.

A run (unit ``paragraphs``) begins and ends with a paragraph that holds a bigram of a template, and has no more words than
the size bound gives the longest template; one is grown from each such paragraph until more of its bigrams are foreign to
all templates than any could bear.  Of runs and single paragraphs that overlap and agree with the same template the best
counts (the shortest, then the first, among equals); a run that is the whole text is left to that unit.

Null and empty texts, and units of under two words, have no bigrams and match nothing; long texts are scanned
whole; repeated rows give the same matches; a template whose words equal another's is reported beside it; an
empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wardline.llm.common import lean
from wardline.llm.arrowtext import NEWLINE, pieces, run_hash
from wardline.llm.latent import APART

DICE = 0.9

#: Parts that the texts of one family share.
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Notices and short licence texts.
TEMPLATES: dict[str, str] = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": _REDISTRIBUTION + _DISCLAIMER,
    "BSD-3-Clause": _REDISTRIBUTION + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _DISCLAIMER,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "LGPL-2.1 header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "MIT notice": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "All rights reserved": "All rights reserved.",
}


def bigrams(text: str) -> np.ndarray:
    """Distinct bigram hashes, sorted."""
    return np.unique(np.concatenate([run_hash(p.hashes, 2) for p in pieces(pa.array([text]), APART)]))


def words_of(text: str) -> int:
    return sum(len(p.hashes) for p in pieces(pa.array([text]), APART))


def bounds(n: int, dice: float = DICE) -> tuple[float, float]:
    """Sizes that a set may have to reach the coefficient with a set of n."""
    return n * dice / (2 - dice) - 1e-9, n * (2 - dice) / dice + 1e-9


class Runs:
    """Runs of consecutive paragraphs against all templates at once."""

    def __init__(self, named: list[tuple[str, int, np.ndarray]], dice: float):
        self.dice, self.sizes = dice, [(k, len(b)) for k, _, b in named]
        #: Most words of a run, and most bigrams of it that no template holds.
        self.words = max((bounds(n, dice)[1] for _, n, _ in named), default=0)
        self.foreign = max((n * (2 / dice - 2) for _, n in self.sizes), default=0) + 1e-9
        self.of: dict[int, list[int]] = {}
        for t, (_, _, b) in enumerate(named):
            for h in b.tolist():
                self.of.setdefault(h, []).append(t)

    def find(self, a: list[int], z: list[int], two: np.ndarray, hits: np.ndarray) -> list[tuple[int, int, str, float]]:
        """(first paragraph, last paragraph, template, dice); a and z are the paragraphs' first words and last words + 1."""
        lead = [z[k] - a[k] > 1 and hits[z[k] - 1] > hits[a[k]] for k in range(len(a))]
        if sum(lead) < 2:
            return []
        found = []
        for k in range(len(a)):
            if not lead[k]:
                continue
            seen: set[int] = set()
            common, foreign, done = [0] * len(self.sizes), 0, a[k]
            for j in range(k, len(a)):
                if z[j] - a[k] > self.words:
                    break
                for h in two[done : max(done, z[j] - 1)].tolist():
                    if h not in seen:
                        seen.add(h)
                        got = self.of.get(h, ())
                        foreign += not got
                        for t in got:
                            common[t] += 1
                done = max(done, z[j] - 1)
                if foreign > self.foreign:
                    break
                if lead[j]:
                    for (name, n), c in zip(self.sizes, common):
                        if c and (d := 2 * c / (len(seen) + n)) >= self.dice:
                            found.append((-d, j - k, k, name))
        taken: dict[str, list[tuple[int, int]]] = {}
        out = []
        for d, n, k, name in sorted(found):
            if all(k > y or k + n < x for x, y in taken.get(name, ())):
                taken.setdefault(name, []).append((k, k + n))
                if n and (k or k + n + 1 < len(a)):
                    out.append((k, k + n, name, -d))
        return out


def _paragraphs(p, lines, r: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """First lines, last lines, first words and last words + 1 of a row's paragraphs."""
    lo, hi = int(lines.bounds[r]), int(lines.bounds[r + 1])
    starts, ends = lines.starts[lo:hi], lines.ends[lo:hi]
    first = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1] + 1])
    last = np.r_[first[1:], hi - lo] - 1
    return first.tolist(), last.tolist(), np.searchsorted(p.starts, starts[first]).tolist(), np.searchsorted(p.starts, ends[last]).tolist()


def _units(p, lines) -> Iterator[tuple[int, str, int, int, int, int]]:
    """(row, kind, first line, last line, first word, last word + 1) of a piece's lines, paragraphs and whole texts."""
    word = np.searchsorted(p.starts, lines.starts)
    until = np.searchsorted(p.starts, lines.ends)
    # an empty line lies between two lines that more than one byte parts
    gap = np.r_[True, lines.starts[1:] > lines.ends[:-1] + 1]
    for r in range(len(lines.bounds) - 1):
        lo, hi = int(lines.bounds[r]), int(lines.bounds[r + 1])
        if lo == hi:
            continue
        first = lo
        for i in range(lo, hi):
            yield r, "line", i - lo, i - lo, int(word[i]), int(until[i])
            if i + 1 == hi or gap[i + 1]:
                if i > first and (first > lo or i + 1 < hi):
                    yield r, "paragraph", first - lo, i - lo, int(word[first]), int(until[i])
                first = i + 1
        if hi - lo > 1:
            yield r, "text", 0, hi - lo - 1, int(p.bounds[r]), int(p.bounds[r + 1])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, dice: float = DICE) -> DataFrame:
    """(doc_id, unit, first_line, last_line, license, dice) for every unit and template that agree."""
    spark = docs.sparkSession
    named = [(k, words_of(t), b) for k, t in (templates or TEMPLATES).items() if len(b := bigrams(t))]
    shared = spark.sparkContext.broadcast(named)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = shared.value
        known = np.unique(np.concatenate([b for *_, b in named])) if named else np.zeros(0, np.uint64)
        quick = np.zeros(1 << 16, bool)
        quick[(known >> np.uint64(48)).astype(np.int64)] = True
        sizes = [(*bounds(len(b), dice), len(b), k, b) for k, _, b in named]
        runs = Runs(named, dice)
        largest = max((s[1] for s in sizes), default=0)
        for batch in batches:
            rows: list[tuple] = []
            at: list[int] = []
            col = batch.column("text")
            for p, lines in zip(pieces(col, APART), pieces(col, NEWLINE, lower=False)):
                two = run_hash(p.hashes, 2)
                hit = np.flatnonzero(quick[(two >> np.uint64(48)).astype(np.int64)]) if len(two) else np.zeros(0, np.int64)
                hit = hit[np.isin(two[hit], known)]
                if not len(hit):
                    continue
                hits = np.zeros(len(two) + 1, np.int64)
                hits[hit + 1] = 1
                hits = np.cumsum(hits)
                touched = np.unique(np.searchsorted(p.bounds, hit, "right") - 1)
                for r, what, first, last, a, z in _units_of(p, lines, touched):
                    if z - a < 2 or hits[z - 1] == hits[a]:
                        continue
                    own = np.unique(two[a : z - 1])
                    if len(own) > largest:
                        continue
                    for low, high, n, name, b in sizes:
                        if low <= len(own) <= high:
                            d = 2 * len(np.intersect1d(own, b, assume_unique=True)) / (len(own) + n)
                            if d >= dice:
                                rows.append((what, first, last, name, d))
                                at.append(p.first + r)
                for r in touched.tolist():
                    first, last, a, z = _paragraphs(p, lines, r)
                    for k, j, name, d in runs.find(a, z, two, hits):
                        rows.append(("paragraphs", first[k], last[j], name, d))
                        at.append(p.first + r)
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64())))], ["doc_id", "unit", "first_line", "last_line", "license", "dice"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, unit string, first_line bigint, last_line bigint, license string, dice double")


def _units_of(p, lines, touched: np.ndarray) -> Iterator[tuple[int, str, int, int, int, int]]:
    """Units of the rows that hold a template's bigram."""
    for r in touched.tolist():
        part = type(p)(p.first + r, p.first + r + 1, p.data, p.rows, p.starts, p.ends, p.hashes, p.bounds[r : r + 2])
        own = type(lines)(r, r + 1, lines.data, lines.rows, lines.starts, lines.ends, lines.hashes, lines.bounds[r : r + 2])
        lo, hi = own.bounds
        own.starts, own.ends, own.bounds = own.starts[lo:hi], own.ends[lo:hi], np.array([0, hi - lo])
        for _, *unit in _units(part, own):
            yield (r, *unit)
