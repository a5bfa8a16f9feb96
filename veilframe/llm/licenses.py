"""License scans by patience alignment (operator 8).

Words are lower-case runs of letters and digits.  A document is a candidate for a template if it holds enough of the
template's distinct words for the wanted coverage to be possible at all; that bound loses nothing and is computed for a
slice of texts at once.  Around each occurrence of the template words that are rarest in the document, a window is
aligned: words that both sides have exactly once are anchors, the longest increasing subsequence of them is kept, equal
words next to anchors extend it, and each gap is aligned in the same way.  Coverage is the share of template words that
the alignment matches.  The first window of a place is where the template would lie with few words changed; where that isn't enough, one
that reaches ``stretch`` template lengths to both sides follows, so a license spread over a longer stretch isn't found.  Worn copies, one right after another, of a
template that ends with its own first words may count as fewer.

Defined results: a null or empty text has no license; a text with several copies of a license has one row for it with
the best coverage, its earliest window and the number of windows, none over another, that reach the threshold; equal coverages go to the
earlier window.  Repeated rows and rows that share a doc_id give results of their own.  Very long texts are read whole, word by word.
Other columns, also with clashing names, don't enter.  An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from veilframe.llm.common import only, slices, texts, word_codes

WORD = regex.compile(r"[^\W_]+")

#: Parts that several licenses share.
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
MIT_DISCLAIMER = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
ISC_DISCLAIMER = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
GNU_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see https://www.gnu.org/licenses/."

#: Wordings of licenses and notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": MIT_GRANT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + MIT_DISCLAIMER,
    "MIT-0": MIT_GRANT.removesuffix(", subject to the following conditions:") + ". " + MIT_DISCLAIMER,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + ISC_DISCLAIMER,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + ISC_DISCLAIMER,
    "BSD-2-Clause": BSD_CONDITIONS + " " + BSD_DISCLAIMER,
    "BSD-3-Clause": BSD_CONDITIONS + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + BSD_DISCLAIMER,
    "BSD-4-Clause": BSD_CONDITIONS + " All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + BSD_DISCLAIMER,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org",
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004 Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
    "PostgreSQL": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies. IN NO EVENT SHALL THE UNIVERSITY BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION, EVEN IF THE UNIVERSITY HAS BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGE. THE UNIVERSITY SPECIFICALLY DISCLAIMS ANY WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. THE SOFTWARE PROVIDED HEREUNDER IS ON AN \"AS IS\" BASIS, AND THE UNIVERSITY HAS NO OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES, ENHANCEMENTS, OR MODIFICATIONS.",
    "HPND": "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies, and that both that the copyright notice and this permission notice appear in supporting documentation, and that the name of the author not be used in advertising or publicity pertaining to distribution of the software without specific, written prior permission. " + ISC_DISCLAIMER,
    "curl": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT OF THIRD PARTY RIGHTS. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. Except as contained in this notice, the name of a copyright holder shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization of the copyright holder.",
    "X11": MIT_GRANT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + MIT_DISCLAIMER + " Except as contained in this notice, the name of the copyright holders shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the copyright holders.",
    "FSFAP": "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved. This file is offered as-is, without any warranty.",
    "Beerware": "As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, and you think this stuff is worth it, you can buy me a beer in return.",
    "Fair": "Usage of the works is permitted provided that this instrument is retained with the works, so that any entity that uses the works is notified of this instrument. DISCLAIMER: THE WORKS ARE WITHOUT WARRANTY.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. " + GNU_WARRANTY.format("General Public License"),
    "GPL-3.0-full-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. " + GNU_WARRANTY.format("General Public License"),
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. " + GNU_WARRANTY.format("Lesser General Public License"),
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. " + GNU_WARRANTY.format("Affero General Public License"),
    "OFL-1.1-notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at: https://scripts.sil.org/OFL",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-4.0-notice": "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/.",
    "CC-BY-SA-4.0-notice": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/.",
}


@dataclass(frozen=True)
class ScanParams:
    coverage: float = 0.8
    stretch: int = 3


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by their first number, that rises in the second: patience piles."""
    tops: list[int] = []
    piles: list[int] = []
    behind: list[int] = []
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        behind.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[at], piles[at] = b, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = behind[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions (in a, in b), rising in both."""
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
        in_a, in_b = {}, {}
        for i in range(a0, a1):
            in_a[a[i]] = -1 if a[i] in in_a else i
        for j in range(b0, b1):
            in_b[b[j]] = -1 if b[j] in in_b else j
        anchors = rising([(i, in_b[w]) for w, i in in_a.items() if i >= 0 and in_b.get(w, -1) >= 0])
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def probes_of(places: dict[str, list[int]], template: list[str], coverage: float) -> list[tuple[int, str]]:
    """(place, word) of words of the text of which a window with the coverage has one at least."""
    # if coverage is reached, no more than this many template words are missing
    missing = int((1 - coverage) * len(template) + 1e-9)
    count = Counter(template)
    # of any words whose copies in the template exceed ``missing``, one at least is matched: the rarest such set
    out, held = [], 0
    for w in sorted(count, key=lambda w: (len(places.get(w, ())), w)):
        if held > missing:
            break
        out += [(i, w) for i in places.get(w, [])]
        held += count[w]
    return sorted(out)


def windows_at(i: int, at: list[int], size: int, stretch: int):
    """(from, to) of the windows of a place in the text whose word stands at places ``at`` of the template."""
    slack = 2 + size // 8
    for p in at:
        yield i - p - slack, i - p + size + slack
    yield i - stretch * size, i + stretch * size + 1


def core(pairs: list[tuple[int, int]], foreign: float = 0.25) -> list[tuple[int, int]]:
    """The stretch of matches with the greatest count less ``foreign`` for each word of the text that the template lacks
    between two of them: words of a neighbouring copy drop off."""
    best, since, score, top = (0, 1), 0, 0.0, 0.0
    for k, (i, j) in enumerate(pairs):
        if k:
            score -= foreign * max(0, (i - pairs[k - 1][0]) - (j - pairs[k - 1][1]))
        if score < 0:
            since, score = k, 0.0
        score += 1
        if score > top:
            best, top = (since, k + 1), score
    return pairs[best[0] : best[1]]


def best_window(text: list[str], template: list[str], coverage: float, stretch: int = ScanParams.stretch) -> tuple[float, int, int, int] | None:
    """(coverage, first word, end word, windows that reach it) of the best alignment in windows of the text."""
    where: dict[str, list[int]] = {}
    for p, w in enumerate(template):
        where.setdefault(w, []).append(p)
    places: dict[str, list[int]] = {}
    for i, w in enumerate(text):
        if w in where:
            places.setdefault(w, []).append(i)
    best, hits, reach = None, 0, 0
    for i, w in probes_of(places, template, coverage):
        if i < reach:
            continue
        for lo, hi in windows_at(i, where[w], len(template), stretch):
            lo = max(lo, reach)
            got = align(text[lo:hi], template)
            if len(got) >= coverage * len(template) - 1e-9:
                near = core(got)
                got = near if len(near) >= coverage * len(template) - 1e-9 else got
                share, first, reach = len(got) / len(template), lo + got[0][0], lo + got[-1][0] + 1
                hits += 1
                if best is None or share > best[0]:
                    best = (share, first, reach)
                break
    return best and (*best, hits)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, params: ScanParams = ScanParams()) -> DataFrame:
    """doc_id, license, coverage, first_word, end_word, n_windows: a row for each license that a document covers."""
    names = sorted(templates or TEMPLATES)
    wordings = [words_of((templates or TEMPLATES)[n]) for n in names]
    vocabulary = {w: i for i, w in enumerate(sorted({w for ws in wordings for w in ws}))}
    member = np.zeros((len(vocabulary), len(names)), np.int64)
    for k, ws in enumerate(wordings):
        member[[vocabulary[w] for w in ws], k] = 1
    need = np.array([len(set(ws)) - int((1 - params.coverage) * len(ws) + 1e-9) for ws in wordings])

    def run(batches):
        for b in slices(batches):
            text = texts(b)
            codes, starts, dictionary = word_codes(text, lower_ascii=True)
            # template words within each distinct chunk of the slice
            owner, kind = [], []
            for i, chunk in enumerate(dictionary.to_pylist()):
                if chunk.isascii() and chunk.isalpha():
                    if chunk in vocabulary:
                        owner.append(i)
                        kind.append(vocabulary[chunk])
                else:
                    for w in words_of(chunk):
                        if w in vocabulary:
                            owner.append(i)
                            kind.append(vocabulary[w])
            owner, kind = np.array(owner, np.int64), np.array(kind, np.int64)
            first = np.searchsorted(owner, np.arange(len(dictionary) + 1))
            many = np.diff(first)[codes]
            some = np.flatnonzero(many)
            doc = np.repeat(np.searchsorted(starts, some, side="right") - 1, many[some])
            at = np.repeat(first[codes[some]], many[some]) + (np.arange(len(doc)) - np.repeat(np.cumsum(many[some]) - many[some], many[some]))
            seen = np.unique(doc * len(vocabulary) + kind[at])
            present = np.zeros((b.num_rows, len(names)), np.int64)
            np.add.at(present, seen // len(vocabulary), member[seen % len(vocabulary)])
            ids, rows = b.column("doc_id").to_pylist(), []
            for i in np.flatnonzero((present >= need).any(1)).tolist():
                words = words_of(text[i].as_py())
                for k in np.flatnonzero(present[i] >= need).tolist():
                    got = best_window(words, wordings[k], params.coverage, params.stretch)
                    if got:
                        rows.append((ids[i], names[k], *got))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "license", "coverage", "first_word", "end_word", "n_windows"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, license string, coverage double, first_word long, end_word long, n_windows long")
