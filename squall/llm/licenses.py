"""License scans by patience alignment of documents with license texts.

Words that occur once in a stretch of the document and once in the template
are anchors; the longest run of anchors in the same order on both sides is
kept, and the gaps between them are aligned in the same way. The coverage is
the share of the template's words that found their place. The templates are
notices, opening passages and the whole texts of short licenses; of long ones
(Apache, GPL, MPL) a document with the body alone is not reported unless its
text is given as a template. SPDX-License-Identifier lines are read as they
are: they name a license by a word that must be exact.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squall.llm.common import column, map_arrow
from squall.llm.words import pieces, shingles, words

# License notices and short licenses, as their publishers word them.
_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution.")
_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written permission.")
_NO_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software.")
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.")
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE.")
TEMPLATES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or "
     "(at your option) any later version."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
     "in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
     'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
     "either express or implied. See the License for the specific language governing permissions and limitations "
     "under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-2-Clause", _CONDITIONS),
    ("BSD-2-Clause", f"{_CONDITIONS} {_NO_WARRANTY}"),
    ("BSD-3-Clause", _NAMES),
    ("BSD-3-Clause", f"{_CONDITIONS} {_NAMES}"),
    ("BSD-3-Clause", f"{_CONDITIONS} {_NAMES} {_NO_WARRANTY}"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
     "License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "To the extent possible under law, the person who associated CC0 with this work has waived all "
     "copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation; either version 2 of the License, or (at "
     "your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
     "your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", _ISC),
    ("ISC", f"{_ISC} {_ISC_WARRANTY}"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or "
     "(at your option) any later version."),
    ("MIT", _MIT),
    ("MIT", f"{_MIT} {_MIT_WARRANTY}"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
     "the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
     "modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
     "binary, for any purpose, commercial or non-commercial, and by any means."),
)
#: A license that counts only where a text holds no other: other licenses' headers say it too.
WEAK = "Proprietary"
COVERAGE = 0.8
SEED = 3
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\s\x22'*<>/]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[^\s\x22'*<>/]+)*)")
_NO_IDS = ("AND", "OR", "WITH")

_LETTERS = np.full(256, 32, dtype=np.uint8)         # signs lie between words
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[48:58] = np.arange(48, 58)
_GAP = np.zeros(256, dtype=bool)
_GAP[32] = True


def longest_rise(values: list[int]) -> list[int]:
    """Indices of a longest strictly rising subsequence."""
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = last[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            last.append(i)
        else:
            tails[k], last[k] = v, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places (i, j) of two sequences, rising on both sides."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            found.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            found.append((i1, j1))
        if i0 >= i1 or j0 >= j1:
            continue
        in_a, in_b = Counter(a[i0:i1]), Counter(b[j0:j1])
        place = {v: j for j, v in enumerate(b[j0:j1], j0) if in_b[v] == 1 and in_a.get(v) == 1}
        pairs = [(i, place[v]) for i, v in enumerate(a[i0:i1], i0) if v in place]
        kept = [pairs[k] for k in longest_rise([j for _, j in pairs])]
        if not kept:
            continue
        found += kept
        for (p, q), (r, s) in zip([(i0 - 1, j0 - 1), *kept], [*kept, (i1, j1)], strict=True):
            todo.append((p + 1, r, q + 1, s))
    return sorted(found)


class Templates:
    """The word hashes of all templates and the places of their seeds (three words in a row)."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        w = words(pa.array([t for _, t in templates], pa.string()), _LETTERS, _GAP)
        self.names = [n for n, _ in templates]
        self.words = [w.hashes[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        seed, _, owner = shingles(w, SEED)
        pairs = np.unique(np.stack([seed, owner.astype(np.uint64)], axis=1), axis=0)
        self.seeds, first = np.unique(pairs[:, 0], return_index=True)
        self.at = np.append(first, len(pairs))
        self.owner = pairs[:, 1].astype(np.int64)


@lru_cache(maxsize=2)
def _templates(templates: tuple) -> Templates:
    return Templates(templates)


def matches_in(own: list[int], hits: list[int], template: list[int], least: float) -> list[tuple[int, int, int]]:
    """(first word, words, matched) of each stretch that covers the template. Each try aligns the
    stretch from a quarter of the template before the next seed to a quarter behind its length, so
    copies that follow each other are found one by one."""
    out, done, slack = [], 0, len(template) // 4 + 2
    for h in hits:
        if h < done:
            continue
        begin, end = max(done, h - slack), min(len(own), h + len(template) + slack)
        got = patience(own[begin:end], template)
        if len(got) >= least * len(template):
            first, last = begin + got[0][0], begin + got[-1][0]
            out.append((first, last + 1 - first, len(got)))
            done = last + 1
    return out


def spdx_lines(texts: pa.Array) -> list[tuple]:
    """(row, license, first word, words, matched, coverage) of every SPDX-License-Identifier, one row for
    each license of its expression (exceptions after WITH are none)."""
    out = []
    for row in np.flatnonzero(pc.fill_null(pc.match_substring(texts, "SPDX-License-Identifier:"), False).to_numpy(zero_copy_only=False)).tolist():
        text = texts[row].as_py()
        for found in _SPDX.finditer(text):
            before, line = (int(words(pa.array([t]), _LETTERS, _GAP).count()[0]) for t in (text[:found.start()], found.group(0)))
            names = found.group(1).replace("(", " ").replace(")", " ").split()
            for i, name in enumerate(names):
                if name not in _NO_IDS and (i == 0 or names[i - 1] != "WITH"):
                    out.append((row, name, before, line, line, 1.0))
    return out


def scan_texts(texts: pa.Array, known: Templates, least: float) -> list[tuple]:
    """``aligned`` and ``spdx_lines`` of every text; WEAK only where a text has nothing else."""
    found = sorted(aligned(texts, known, least) + spdx_lines(texts))
    named = {f[0] for f in found if f[1] != WEAK}
    return [f for f in found if f[1] != WEAK or f[0] not in named]


def aligned(texts: pa.Array, known: Templates, least: float) -> list[tuple]:
    """(row, license, first word, words, matched, coverage), a shorter match that mostly lies in a
    longer one left out."""
    out = []
    for begin, end in pieces(texts):
        w = words(texts.slice(begin, end - begin), _LETTERS, _GAP)
        seed, at, doc = shingles(w, SEED)
        if len(seed) == 0 or len(known.seeds) == 0:
            continue
        found = np.searchsorted(known.seeds, seed)
        found[found == len(known.seeds)] = 0
        hits = np.flatnonzero(known.seeds[found] == seed)
        by_doc: dict[int, dict[int, list[int]]] = {}
        for h in hits.tolist():
            d = int(doc[h])
            for t in known.owner[known.at[found[h]]:known.at[found[h] + 1]].tolist():
                by_doc.setdefault(d, {}).setdefault(t, []).append(int(at[h] - w.first[d]))
        for d, by_template in by_doc.items():
            own = w.hashes[w.first[d]:w.first[d + 1]].tolist()
            got = [(-m, len(known.words[t]), s, n, t) for t, places in by_template.items()
                   for s, n, m in matches_in(own, places, known.words[t], least)]
            taken: list[tuple[int, int]] = []
            for m, _, s, n, t in sorted(got):       # most words first, then best covered
                if any(2 * (min(s + n, b) - max(s, a)) > n for a, b in taken):
                    continue
                taken.append((s, s + n))
                out.append((begin + d, known.names[t], s, n, -m, -m / len(known.words[t])))
    return out


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple = TEMPLATES,
                  least: float = COVERAGE) -> DataFrame:
    """(key, license, first_word, n_words, matched, coverage): every stretch of a text that covers
    at least ``least`` of a license text's words, in order, and every license named by an SPDX line.

    Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased. A text can
    hold several; null or empty texts hold none; repeated rows and null keys each give their own
    rows. A stretch that shares no three words in a row with a template is not compared with it.
    No shuffle."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def scan(batches):
        known = _templates(templates)
        for batch in batches:
            found = scan_texts(column(batch, "text"), known, least)
            if found:
                r, name, s, n, m, cover = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "key").take(pa.array(r)), pa.array(name), pa.array(s, pa.int32()),
                     pa.array(n, pa.int32()), pa.array(m, pa.int32()), pa.array(cover, pa.float64())],
                    names=["key", "license", "first_word", "n_words", "matched", "coverage"])

    kind = dict(rows.dtypes)["key"]
    return map_arrow(rows, scan, f"key {kind}, license string, first_word int, n_words int, matched int, "
                                 "coverage double").withColumnRenamed("key", key)
