"""Finds license texts and notices in documents by patience alignment with templates.

Words are compared without case and punctuation. A document is aligned with a template only where a stretch of at most
`WIDTH` times the template's length has enough of its words, repeats counted, to be a match at all; most documents have no such
stretch and are passed over by one matrix product for a batch. In the stretch, words that are unique to both sides are anchors, the longest increasing
subsequence of anchors stands, and the gaps between are aligned in the same way, after equal words at their ends. Coverage is
the share of the template's words that are aligned; a match covers `COVERED` of them or more, has all the words that tell the
template's license from others, and none of those that make another license of it.

Nulls and edges: a null or empty text has no match. Every row gives one row: the best license (by coverage, then by length of
the template), or null, and all matches in text order with their word places. Empty tables give empty results.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm import arrow_words as aw

COVERED = 0.8
WIDTH = 1.5

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "*Neither the name of the copyright holder nor the names of its contributors may be used to *endorse or *promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_PROGRAM = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the *GNU {kind}*General Public License as published "
    "by the Free Software Foundation, {version} of the License, or (at your option) any later version."
)
_WORK = "This work is licensed under the *GNU {kind}*General *Public License, version *{version}."
_CC = "This work is licensed under a *Creative *Commons *{kind} *4.0 International License."
#: Words that make another license of a GPL or a Creative Commons one.
_NOT_GPL = "lesser library affero"
_NOT_CC = "noncommercial non-commercial sharealike share-alike noderivatives noderivs no-derivatives no-derivs"


def _whole(name: str) -> str:
    return (Path(__file__).parent / "licenses" / f"{name}.txt").read_text(encoding="utf-8")


#: Identifiers of the tag that source files carry.
_SPDX = (
    "Apache-2.0 MIT BSD-2-Clause BSD-3-Clause ISC MPL-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only "
    "LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 "
    "CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 EPL-1.0 EPL-2.0 BSL-1.0 Unlicense Zlib"
).split()
#: Fixed values: (license, wording, contrary words) of public license texts and notices. A word with a star must be aligned, and
#: no contrary word may stand between the first and the last word aligned.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the *Apache License, Version *2.0."),
    ("Apache-2.0", "Licensed under the *Apache License, Version *2.0 (the \"License\"); you may not use this file except in compliance with the "
     "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
     "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
     "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the *MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
     "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
     "portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
     "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
     "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
     "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
     "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
     "portions of the Software."),
    ("BSD-3-Clause", _BSD + _BSD_THIRD),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END),
    ("BSD-2-Clause", _BSD + _BSD_END, "neither endorse promote"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any *purpose with or without *fee is hereby granted, provided that "
     "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
     "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
     "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
     "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the *Mozilla Public License, v. *2.0. If a copy of the MPL was not distributed with "
     "this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Licensed under the *Mozilla Public License, Version *2.0."),
    ("GPL-3.0", _WORK.format(kind="", version=3), _NOT_GPL),
    ("GPL-3.0", _PROGRAM.format(what="program", kind="", version="either version *3"), _NOT_GPL),
    ("GPL-2.0", _WORK.format(kind="", version=2), _NOT_GPL),
    ("GPL-2.0", _PROGRAM.format(what="program", kind="", version="either version *2"), _NOT_GPL),
    ("LGPL-3.0", _WORK.format(kind="*Lesser ", version=3)),
    ("LGPL-3.0", _PROGRAM.format(what="library", kind="*Lesser ", version="either version *3")),
    ("LGPL-2.1", _WORK.format(kind="*Lesser ", version=2.1)),
    ("LGPL-2.1", _PROGRAM.format(what="library", kind="*Lesser ", version="either version *2.1")),
    ("AGPL-3.0", _WORK.format(kind="*Affero ", version=3)),
    ("AGPL-3.0", _PROGRAM.format(what="program", kind="*Affero ", version="either version *3")),
    *[(f"CC-{k}-4.0", f"Licensed under *CC *{k} *4.0.", _NOT_CC) for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")],
    *[(f"CC-{k}-4.0", f"Licensed under *CC-{k} *4.0.", _NOT_CC) for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")],
    ("CC-BY-4.0", _CC.format(kind="Attribution"), _NOT_CC),
    ("CC-BY-SA-4.0", _CC.format(kind="Attribution-ShareAlike"), _NOT_CC),
    ("CC-BY-NC-4.0", _CC.format(kind="Attribution-NonCommercial"), _NOT_CC),
    ("CC-BY-ND-4.0", _CC.format(kind="Attribution-NoDerivatives"), _NOT_CC),
    ("CC-BY-NC-SA-4.0", _CC.format(kind="Attribution-NonCommercial-ShareAlike"), _NOT_CC),
    ("CC-BY-NC-ND-4.0", _CC.format(kind="Attribution-NonCommercial-NoDerivatives"), _NOT_CC),
    *[(k.removesuffix("-only").removesuffix("-or-later"), f"*SPDX-License-Identifier: *{k}") for k in _SPDX],
    ("all-rights-reserved", "All rights reserved."),
    ("Apache-2.0", _whole("Apache-2.0")), ("GPL-3.0", _whole("GPL-3")), ("GPL-2.0", _whole("GPL-2")), ("LGPL-3.0", _whole("LGPL-3")),
    ("LGPL-2.1", _whole("LGPL-2.1")), ("MPL-2.0", _whole("MPL-2.0")),
)

_PLAIN = re.compile(r"\w+(?:[.'-]\w+)*")


def plain(word: str) -> str:
    """A word without case and without punctuation at its ends; empty if nothing is left."""
    m = _PLAIN.search(word.lower())
    return m[0] if m else ""


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (i, j), increasing, of the sequences a and b."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if w in place]
        if not anchors:
            continue
        tops: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for n, (_, j) in enumerate(anchors):
            k = bisect_left(tops, j)
            back.append(ends[k - 1] if k else -1)
            tops[k : k + 1], ends[k : k + 1] = [j], [n]
        n, kept = ends[-1], []
        while n >= 0:
            kept.append(anchors[n])
            n = back[n]
        kept.reverse()
        out += kept
        last = (a0 - 1, b0 - 1)
        for i, j in [*kept, (a1, b1)]:
            todo.append((last[0] + 1, i, last[1] + 1, j))
            last = (i, j)
    return sorted(out)


def common_length(words: list[int], places: dict[int, int], size: int) -> int:
    """The length of the longest common subsequence with a template of `size` words; places: word -> bits of where the template has it."""
    full = rest = (1 << size) - 1
    for w in words:
        if here := rest & places.get(w, 0):
            rest = ((rest + here) | (rest - here)) & full
    return size - rest.bit_count()


class Templates:
    def __init__(self, templates=TEMPLATES):
        self.names = [t[0] for t in templates]
        split = [[(p, w.startswith("*")) for w in t[1].split() if (p := plain(w))] for t in templates]
        self.words = [[p for p, _ in ws] for ws in split]
        contrary = [[plain(w) for w in t[2].split()] if len(t) > 2 else [] for t in templates]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for ws in [*self.words, *contrary] for w in ws}))}
        self.musts = [{j for j, (_, must) in enumerate(ws) if must} for ws in split]
        self.contrary = [np.array([self.vocabulary[w] for w in ws if w not in own], dtype=np.int64) for ws, own in zip(contrary, self.words)]
        self.coded = [[self.vocabulary[w] for w in ws] for ws in self.words]
        #: How often each template has each word. What a text lacks of them cannot be aligned.
        self.has = np.zeros((len(self.vocabulary), len(templates)), dtype=np.float32)
        for t, codes in enumerate(self.coded):
            np.add.at(self.has[:, t], codes, 1)
        self.sizes = self.has.sum(axis=0)
        self.places: list[dict[int, int]] = []
        for codes in self.coded:
            own: dict[int, int] = {}
            for j, c in enumerate(codes):
                own[c] = own.get(c, 0) | 1 << j
            self.places.append(own)

    def matches(self, words: np.ndarray, t: int) -> list[tuple[int, int, float]]:
        """(first word, word after the last, coverage) of the matches of template t; `words`: vocabulary codes, -1 for others."""
        wanted = self.coded[t]
        width, need = max(int(WIDTH * len(wanted)), len(wanted) + 2), COVERED * len(wanted) - 1e-6
        ours = np.nonzero((words >= 0) & (self.has[np.maximum(words, 0), t] > 0))[0].tolist()
        codes, most = words[ours].tolist(), Counter(wanted)
        # `common`: words that the stretch and the template share, repeats counted
        out, n, count, common = [], 0, Counter(), 0
        # no stretch that ends before this many of our words can have enough in the template's order
        start = enough = 0
        while start < len(ours):
            while n < len(ours) and ours[n] < ours[start] + width:
                common += count[codes[n]] < most[codes[n]]
                count[codes[n]] += 1
                n += 1
            skip = start + 1
            if common >= need and n >= enough:
                first = ours[start]
                pairs = patience(words[first : first + width].tolist(), wanted)
                coverage = len(pairs) / len(wanted)
                end = first + pairs[-1][0] + 1 if pairs else first
                stands = self.musts[t] <= {j for _, j in pairs} and not np.isin(words[first:end], self.contrary[t]).any()
                if coverage >= COVERED and stands:
                    out.append((first + pairs[0][0], end, coverage))
                    skip = bisect_left(ours, end)
                elif coverage < COVERED:
                    # a word more adds one at most to what is common in order, and that is no less than what is aligned
                    enough = n + max(0, ceil(need - common_length(codes[start:n], self.places[t], len(wanted))))
            for k in range(start, skip):
                count[codes[k]] -= 1
                common -= count[codes[k]] < most[codes[k]]
            start = skip
        return out


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, license, coverage, n_matches, matches for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for batch in batches:
            for piece in aw.pieces(batch, "text"):
                distinct, codes, offsets = aw.split(piece.column("text"))
                of_word = np.array([known.vocabulary.get(plain(w), -1) for w in distinct.to_pylist()], dtype=np.int64)
                words = of_word[codes] if len(codes) else np.empty(0, dtype=np.int64)
                owner = np.repeat(np.arange(piece.num_rows), np.diff(offsets))
                seen = np.zeros((piece.num_rows, len(known.vocabulary)), dtype=np.float32)
                seen[owner[words >= 0], words[words >= 0]] = 1
                likely = seen @ known.has >= COVERED * known.sizes - 1e-3
                rows = []
                for i in range(piece.num_rows):
                    found = []
                    for t in np.nonzero(likely[i])[0].tolist():
                        own = words[offsets[i] : offsets[i + 1]]
                        found += [(a, b, c, len(known.coded[t]), known.names[t]) for a, b, c in known.matches(own, t)]
                    found.sort()
                    best = max(found, key=lambda x: (x[2], x[3], x[4]), default=None)
                    listed = [{"license": x[4], "first_word": x[0], "end_word": x[1], "coverage": x[2]} for x in found]
                    rows.append((best and best[4], best and best[2], len(found), listed))
                license, coverage, n, matches = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"), pa.array(license, pa.string()), pa.array(coverage, pa.float64()), pa.array(n, pa.int64()),
                        pa.array(matches, pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("coverage", pa.float64())]))),
                    ],
                    names=["doc_id", "license", "coverage", "n_matches", "matches"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    one = "struct<license: string, first_word: long, end_word: long, coverage: double>"
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, license string, coverage double, n_matches long, matches array<{one}>"
    )
