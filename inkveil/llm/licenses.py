"""License scans: passages compared to license templates by Dice's coefficient over word bigrams.

Text and templates are normalised alike: lower-cased, cut into runs of letters and digits. A passage is a
run of words, in a line or across lines; it begins and ends with a bigram of the template. Its likeness to a template is 2 * shared / (bigrams of both), over bags of bigrams; a
match reaches ``threshold``. Size bounds prune: a match of threshold t has between t / (2 - t) and
(2 - t) / t times the template's bigrams, and shares at least t / 2 of both; a passage starts
only where enough of the template's bigrams follow within its largest size. What remains is compared exactly. Of overlapping matches
the likest stays; of equally likely ones of one license the longest, then the earliest, and those of different
licenses all. A text is walked once, each bigram looked up once for all templates.

Runs in Arrow batches where the text lies, without a shuffle; whole texts, never prefixes. Null or empty
text: no match. Null or repeated ids pass through; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Short licenses whole; notices, file headers and headings in common use, by SPDX identifier.
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER '
    "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_HOPE = " This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details. "


def _gnu(thing: str, kind: str, version: str, stop: str, end: str) -> str:
    """The usual file header of a GNU license."""
    return (
        f"This {thing} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{',' if stop == ':' else ';'} "
        f"either version {version} of the License, or (at your option) any later version." + _HOPE.format(thing, kind) + f"You should have received a copy of the GNU {kind}General Public License along with this {thing}{end}"
    )


_WEB = ". If not, see <https://www.gnu.org/licenses/>."
_POST = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
_VERBATIM = " Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
TEMPLATES = [
    ("AGPL-3.0", _gnu("program", "Affero ", "3", ":", _WEB)),
    ("GPL-2.0", _gnu("program", "", "2", ";", _POST)),
    ("GPL-2.0", _gnu("program", "", "2", ";", _WEB)),
    ("GPL-3.0", _gnu("program", "", "3", ":", _WEB)),
    ("LGPL-2.1", _gnu("library", "Lesser ", "2.1", ";", _POST)),
    ("LGPL-3.0", _gnu("library", "Lesser ", "3", ":", _WEB)),
    ("LGPL-3.0", _gnu("program", "Lesser ", "3", ":", _WEB)),
    # Headings, by which whole copies of the long licenses are found.
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>" + _VERBATIM),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("EPL-2.0", 'Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT\'S ACCEPTANCE OF THIS AGREEMENT.'),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA" + _VERBATIM),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>" + _VERBATIM),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA" + _VERBATIM),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>" + _VERBATIM),
    ("MPL-2.0", 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.'),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END),
    ("BSD-2-Clause", _BSD_START + _BSD_1 + _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("MIT", _MIT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _WARRANTY.replace("OR COPYRIGHT HOLDERS ", ""),
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

_WORD = re.compile(r"[^\W_]+")


def normalised(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        self.threshold = threshold
        words = [normalised(t) for _, t in templates]
        self.names = [name for name, _ in templates]
        self.bags = [Counter(zip(w, w[1:])) for w in words]
        self.sizes = [max(0, len(w) - 1) for w in words]
        self.low = [threshold / (2 - threshold) * n for n in self.sizes]
        self.high = [(2 - threshold) / threshold * n for n in self.sizes]
        self.bigrams = set().union(*self.bags) if self.bags else set()
        self.number = {b: k for k, b in enumerate(sorted(self.bigrams))}
        self.holds = np.array([[b in own for b in self.number] for own in self.bags], bool).reshape(len(self.bags), len(self.number))
        # The shared bigrams are at least ``low`` in number.
        self.need = [max(1, int(np.ceil(n - 1e-9))) for n in self.low]
        # Words that begin a template's bigram: a cheap test before any pair is built.
        self.first = {a for a, _ in self.bigrams}
        self.least = min((n for n in self.low), default=0)
        self.most = max(self.high, default=0)

    def passages(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, likeness, first line, last line) of the runs of words that match, likest first."""
        if not self.bigrams or not text:
            return []
        words: list[str] = []
        begin = []
        for line in text.split("\n"):
            begin.append(len(words))
            words += _WORD.findall(line.lower())
        pairs, first = self.bigrams, self.first
        hits = [i for i, w in enumerate(words[:-1]) if w in first and (w, words[i + 1]) in pairs]
        if len(hits) < self.least:
            return []
        place = np.array(hits)
        number = np.array([self.number[words[i], words[i + 1]] for i in hits])
        # How many places of the whole text have a bigram of each template: most templates go here.
        seen, times = np.unique(number, return_counts=True)
        total = self.holds[:, seen] @ times
        found = []
        for t, own in enumerate(self.bags):
            size, high, need = self.sizes[t], self.high[t], self.need[t]
            if not size or total[t] < need:
                continue
            p = place[self.holds[t, number]]
            # So many must lie within ``high``.
            at = [(i, (words[i], words[i + 1])) for i in p.tolist()]
            for i in np.flatnonzero(p[need - 1 :] - p[: len(p) - need + 1] < high + 1e-9).tolist():
                s = at[i][0]
                left = dict(own)
                shared = 0
                for k in range(i, len(at)):
                    e, b = at[k]
                    n = e - s + 1
                    if n > high + 1e-9:
                        break
                    if left[b]:
                        left[b] -= 1
                        shared += 1
                    likeness = 2 * shared / (n + size)
                    if likeness >= self.threshold:
                        found.append((-likeness, s - e, s, e + 1, self.names[t]))
        found.sort()
        kept: list[tuple[str, float, int, int]] = []
        covered = bytearray(len(words))  # by likelier matches
        mine: dict[str, bytearray] = {}  # by matches of one license
        marked = 0
        for minus, _, s, e, name in found:
            while marked < len(kept) and kept[marked][1] > -minus:
                _, _, x, y = kept[marked]
                covered[x : y + 1] = bytes([1]) * (y + 1 - x)
                marked += 1
            own = mine.setdefault(name, bytearray(len(words)))
            if 1 not in covered[s : e + 1] and 1 not in own[s : e + 1]:
                own[s : e + 1] = bytes([1]) * (e + 1 - s)
                kept.append((name, -minus, s, e))
        edges = np.array(begin)
        line = lambda i: int(np.searchsorted(edges, i, "right")) - 1
        return [(name, x, line(s), line(e)) for name, x, s, e in kept]


@lru_cache(4)
def scanner(templates: tuple[tuple[str, str], ...], threshold: float) -> Scanner:
    return Scanner(templates, threshold)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, matches array<struct<license, likeness, first_line, last_line>>) of every row's whole text."""
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    fixed = tuple(map(tuple, templates))
    match = pa.struct([("license", pa.string()), ("likeness", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(fixed, threshold)
        names = ("license", "likeness", "first_line", "last_line")
        for b in batches:
            found = [[dict(zip(names, m)) for m in own.passages(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(match))], names=[id_col, "matches"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, matches array<struct<license:string,likeness:double,first_line:int,last_line:int>>")


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, number of matches, the likest license and its likeness, all licenses."""
    rows = license_scan(docs, id_col, text_col, **options)
    first = F.get("matches", F.lit(0))
    return rows.select(
        F.col(id_col),
        F.size("matches").cast("long").alias("n_matches"),
        first["license"].alias("license"),
        first["likeness"].alias("likeness"),
        F.array_join(F.array_sort(F.array_distinct(F.col("matches.license"))), ",").alias("licenses"),
    )
