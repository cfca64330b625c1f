"""License scans by patience alignment of texts with templates.

Words that are unique to both sides anchor the alignment; the longest increasing subsequence of the anchors is kept
and the gaps between them are aligned in the same way. A template's coverage is the share of its words that are aligned.
Windows to align are found by those of the template's words that are rarest in the text, so many that no match can lack
them all. Where a match overlaps a better one, what is left of its window is aligned again. Texts are scanned whole in the task
that reads them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planeweave.llm.common import bounded, utf8_column

#: Notices, opening terms and whole short texts of public licenses, as their stewards publish them. Of the long ones
#: (Apache, GPL family, MPL) the notice is here that a file carries.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License.",
    "MIT-terms": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "all-rights-reserved": "All rights reserved.",
}
COVERAGE = 0.8
#: Of a template's words, so many at least of those that are rarest in a text give windows.
RAREST = 4
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words_of(text: str) -> tuple[list[str], list[int], list[int]]:
    """Lower-case words, where each starts and where it ends."""
    found = [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]
    return [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs sorted by their first, the longest run that also rises in its second."""
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        tops[at:at + 1] = [b]
        last[at:at + 1] = [i]
        back.append(last[at - 1] if at else -1)
    found, i = [], last[-1] if last else -1
    while i >= 0:
        found.append(pairs[i])
        i = back[i]
    return found[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions that are aligned, in order."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        alo, ahi, blo, bhi = gaps.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            found.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            found.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        in_a, in_b = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        place = {b[j]: j for j in range(blo, bhi) if in_b[b[j]] == 1}
        anchors = longest_increasing([(i, place[a[i]]) for i in range(alo, ahi) if in_a[a[i]] == 1 and a[i] in place])
        for (i, j), (p, q) in zip([(alo - 1, blo - 1), *anchors], [*anchors, (ahi, bhi)], strict=True):
            if anchors:
                gaps.append((i + 1, p, j + 1, q))
        found += anchors
    return sorted(found)


class Scanner:
    """Finds templates in texts."""

    def __init__(self, templates: dict[str, str] | None = None, least: float = COVERAGE):
        self.least = least
        self.templates = {name: words_of(t)[0] for name, t in (templates or TEMPLATES).items()}
        self.templates = {name: t for name, t in self.templates.items() if t}
        self.sets = {name: frozenset(t) for name, t in self.templates.items()}
        self.all = frozenset().union(*self.sets.values())
        self.counts = {name: Counter(t) for name, t in self.templates.items()}
        #: So many different words any match has.
        self.fewest = min((sum(n < least * len(self.templates[name]) for n in accumulate([0, *sorted(c.values(), reverse=True)])) for name, c in self.counts.items()), default=0)

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(name, coverage, start, end in code points) of the templates found, by start; no two overlap."""
        low = text.lower()
        if sum(w in low for w in self.all) < self.fewest:
            return []
        words, starts, ends = words_of(text)
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.all:
                places.setdefault(w, []).append(i)
        found: list[tuple] = []
        tried: set[tuple[str, int, int]] = set()

        def align(name: str, lo: int, hi: int) -> list[tuple]:
            """What words ``lo`` to ``hi`` hold of a template, if enough: most words first, then best covered, shortest and first."""
            template, near = self.templates[name], held[name]
            lo, hi = max(0, lo), min(len(words), hi)
            if (name, lo, hi) in tried or bisect_left(near, hi) - bisect_left(near, lo) < self.least * len(template):
                return []
            tried.add((name, lo, hi))
            pairs = patience(template, words[lo:hi])
            if not pairs or len(pairs) < self.least * len(template):
                return []
            first, last = lo + pairs[0][1], lo + pairs[-1][1]
            return [(-len(pairs), -len(pairs) / len(template), last - first, first, name, last, lo, hi)]

        held: dict[str, list[int]] = {}
        for name, template in self.templates.items():
            known = [w for w in self.sets[name] if w in places]
            # repeats count, as they do in the coverage
            if sum(min(n, len(places[w])) for w, n in self.counts[name].items() if w in places) < self.least * len(template):
                continue
            held[name] = sorted(p for w in known for p in places[w])
            slack = len(template) // 4 + 4
            spots: dict[str, list[int]] = {}
            for at, w in enumerate(template):
                spots.setdefault(w, []).append(at)
            # a match lacks at most so many words of the template; those that the text lacks are among them
            spare = len(template) * (1 - self.least) - sum(len(x) for w, x in spots.items() if w not in places) + 1e-9
            windows = set()
            for k, w in enumerate(sorted(known, key=lambda w: (len(places[w]), w))):
                if k >= RAREST and spare < 0:
                    break
                spare -= len(spots[w])
                windows |= {(p - at - slack, p - at + len(template) + slack) for p in places[w] for at in spots[w]}
            for lo, hi in windows:
                found += align(name, lo, hi)
        heapify(found)
        taken: list[tuple[str, float, int, int]] = []
        while found:
            n, _, _, lo, name, hi, begin, end = heappop(found)
            clash = [(s, e) for _, _, s, e in taken if lo <= e and s <= hi]
            if not clash:
                taken.append((name, -n / len(self.templates[name]), lo, hi))
                continue
            # the one with most aligned words counts; beside it, the rest of the window may still hold a match
            for s, e in [*sorted(clash), (end, end)]:
                for x in align(name, begin, s):
                    heappush(found, x)
                begin = e + 1
        return sorted(((name, c, starts[lo], ends[hi]) for name, c, lo, hi in taken), key=lambda x: x[2])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = COVERAGE) -> DataFrame:
    """Per row: id_col, n_licenses, licenses (array of name, coverage, start, end in code points), by start; no two overlap.

    A null, empty or blank text has none; a null id stays null. A text of any length is scanned whole. Of matches that overlap the one
    with most aligned words stays, of as many the better covered, then the shorter, then the first. Repeated rows are returned each; an
    empty table gives no rows; further columns, whatever their names, are left out.
    """
    item = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in bounded(batches, text_col):
            found = [scanner.scan(t.decode()) for t in utf8_column(batch, text_col)]
            rows = [[dict(zip(("license", "coverage", "start", "end"), f, strict=True)) for f in x] for x in found]
            yield pa.record_batch([batch.column(0), pa.array(map(len, found), pa.int64()), pa.array(rows, pa.list_(item))], names=[id_col, "n_licenses", "licenses"])

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"{id_col} long, n_licenses long, licenses array<struct<license: string, coverage: double, start: long, end: long>>")
