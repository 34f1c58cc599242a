"""License scan by patience alignment with template texts."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import Words, batches, slices

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Published texts and notices; fixed values.
TEMPLATES = {
    "MIT": _MIT,
    "BSD-2-Clause": f"{_BSD2} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "BSL-1.0-header": """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)""",
    "CC0-1.0-notice": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.""",
    "CC-BY-4.0-notice": """This work is licensed under a Creative Commons Attribution 4.0 International License.""",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-line": "Released under the MIT License.",
}
#: Share of a template's words that must be aligned.
LEAST_COVERAGE = 0.8
#: Anchor runs of a place lie within so many words of the template's length.
SLACK = 1.25


def normal(text: str | None) -> str:
    """Lower case, with quotes, brackets and sentence marks as blanks, as templates are set in many ways."""
    return (text or "").lower().translate(_MARKS)


_MARKS = str.maketrans({c: " " for c in "\"'`()[]{}<>,.;:*#|!"} | {"“": " ", "”": " ", "‘": " ", "’": " "})


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, which are in order of their first, that increases in the second: patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(y)
            at.append(i)
        else:
            tops[pile], at[pile] = y, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Patience alignment: pairs of equal items, increasing in both.

    Equal ends are matched first; of what remains, items that occur once in either are anchors, the
    longest increasing run of them is kept, and the gaps between anchors are aligned in the same way.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        al, ah, bl, bh = todo.pop()
        while al < ah and bl < bh and a[al] == b[bl]:
            out.append((al, bl))
            al, bl = al + 1, bl + 1
        while al < ah and bl < bh and a[ah - 1] == b[bh - 1]:
            ah, bh = ah - 1, bh - 1
            out.append((ah, bh))
        if al == ah or bl == bh:
            continue
        once_a, once_b = Counter(a[al:ah]), Counter(b[bl:bh])
        where = {x: i for i, x in enumerate(b[bl:bh], bl) if once_b[x] == 1}
        anchors = longest_increasing([(i, where[x]) for i, x in enumerate(a[al:ah], al) if once_a[x] == 1 and x in where])
        if not anchors:
            continue
        last = (al - 1, bl - 1)
        for x, y in [*anchors, (ah, bh)]:
            if x - last[0] > 1 and y - last[1] > 1:
                todo.append((last[0] + 1, x, last[1] + 1, y))
            last = (x, y)
        out += anchors
    return sorted(out)


class Scanner:
    """Templates with an index of their word pairs, by which places in a text are found before they are aligned."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        words = Words([normal(templates[n]) for n in self.names])
        self.words = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, own in enumerate(self.words):
            whole = Words([normal(templates[self.names[t]])])
            for h, at in zip(*(x.tolist() for x in whole.grams(whole.hash, 2)), strict=True):
                self.pairs[h].append((t, at))
        self.known = np.sort(np.array(list(self.pairs), np.uint64))

    def places(self, hits: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        """(template, first word, end) of stretches that hold enough of a template's word pairs.

        hits are (word of the text, pair hash). The starts that hits imply are put in order; stretches of
        starts close to each other make a place.
        """
        starts: dict[int, list[int]] = defaultdict(list)
        for at, h in hits:
            for t, offset in self.pairs[h]:
                starts[t].append(at - offset)
        for t, found in starts.items():
            size = len(self.words[t])
            found.sort()
            group = [found[0]]
            for s in [*found[1:], None]:
                if s is not None and s - group[-1] <= max(2, size // 4):
                    group.append(s)
                    continue
                if len(group) >= max(1, (size - 1) // 3):
                    # starts more than a template apart are places of their own
                    low = group[0]
                    while low <= group[-1]:
                        high = min(group[-1], low + size // 2)
                        yield t, max(0, low - 2), high + int(size * SLACK) + 2
                        low = high + 1
                group = [s]

    def scan(self, words: np.ndarray, hits: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """(template, first word, end, aligned words) of the templates in a text; overlapping finds of one template count once."""
        found = []
        for t, low, high in self.places(hits):
            pairs = align(words[low:high].tolist(), self.words[t].tolist())
            if len(pairs) >= LEAST_COVERAGE * len(self.words[t]):
                found.append((t, low + pairs[0][0], low + pairs[-1][0] + 1, len(pairs)))
        found.sort(key=lambda x: (-x[3] / len(self.words[x[0]]), x[2] - x[1], x[1], x[0]))
        kept: list[tuple[int, int, int, int]] = []
        for x in found:
            if not any(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for y in kept):
                kept.append(x)
        return sorted(kept, key=lambda x: (x[1], x[0]))


def _scan(templates: dict[str, str]):
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("n_aligned", pa.int64()), ("coverage", pa.float64()), ("n_words", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        maybe = np.zeros(1 << 18, bool)
        maybe[scanner.known & np.uint64((1 << 18) - 1)] = True

        def rows() -> Iterator[dict]:
            for batch in slices(stream):
                words = Words([normal(t) for t in batch.column("text").to_pylist()])
                grams, at = words.grams(words.hash, 2)
                some = np.flatnonzero(maybe[grams & np.uint64((1 << 18) - 1)])
                some = some[np.isin(grams[some], scanner.known)]
                of = np.searchsorted(words.first, at[some], side="right") - 1
                for i in np.unique(of).tolist():
                    low, high = words.first[i], words.first[i + 1]
                    mine = some[of == i]
                    hits = list(zip((at[mine] - low).tolist(), grams[mine].tolist(), strict=True))
                    for t, a, b, n in scanner.scan(words.hash[low:high], hits):
                        yield {"doc_id": batch.column("doc_id")[i].as_py(), "license": scanner.names[t], "first_word": a, "end_word": b, "n_aligned": n, "coverage": n / len(scanner.words[t]), "n_words": int(high - low)}

        yield from batches(rows(), schema)

    return run


def full_texts(spark: SparkSession, path: str, most: int = 500) -> dict[str, str]:
    """Templates from the files of a folder, by file name: whole license texts, few and of bounded size; more than `most` are refused."""
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} templates under {path}")
    return {r.name: r.value for r in rows}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, license, first_word, end_word, n_aligned, coverage, n_words.

    One row for each place of a row's text in which at least LEAST_COVERAGE of a template's words align;
    first_word and end_word (exclusive) count the words of the normalised text, n_words is their number.
    Templates are public license texts and notices by default, few and of bounded size.

    Null, empty and very short texts match nothing. Null doc_ids and repeated rows are reported each.
    A license that stands in a text several times is found each time; of overlapping finds of one template
    the one with the most words aligned counts, of equal ones the shortest, then the first. Very long texts
    are searched whole. Extra columns are ignored. An empty table gives an empty result.

    The default templates are the texts and notices in TEMPLATES; the long licenses come by their notices.
    full_texts reads more, such as whole licenses, from a folder.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(_scan(TEMPLATES if templates is None else templates), "doc_id long, license string, first_word long, end_word long, n_aligned long, coverage double, n_words long")
