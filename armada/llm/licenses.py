"""License scans (operator 9): winnowed template fingerprints, then banded alignment.

Templates are token sequences. Their ``GRAM``-token grams are winnowed (the
smallest hash of every ``WINDOW`` neighbouring grams is kept), so any shared
run of ``GRAM + WINDOW - 1`` tokens holds a kept one; of templates below
``SHORT`` tokens, whose finds need not share such a run, all grams are kept
and all pairs of neighbours as well. The kept grams form an inverted index of (template, position), whose size is that of the template
list, and which is broadcast. Every gram of every document is looked up;
hits on nearby diagonals are one candidate where the text holds enough of the template's tokens, and a local alignment inside a
band around them, with substitutions and gaps, gives the matched share of
the template and the span of the text. Of overlapping finds the one with
the best score stays.

Texts are tokenised in pieces. A piece begins ``reach`` tokens before the end
of the one before: more than the longest template and its band cover, so a
find lies whole in one piece however many characters stand between its
tokens. No shuffle: a document is one row.

Defined results: NULL and empty texts have no finds; repeated rows are
scanned one by one; very long texts are scanned whole, piece by piece; of equal
finds the first template of the list stays; an empty table or template list gives
no rows; a template of fewer than ``GRAM`` tokens is an error; other columns are
not read, whatever their names.
"""

from __future__ import annotations

import bisect
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armada.llm.token_files import slices

GRAM = 3                  # tokens
WINDOW = 3                # grams
SHORT = 15                # templates of fewer tokens are not winnowed
BAND = 8                  # diagonals on either side of the hits, but at most a fifth of the template
MATCH, MISS, GAP = 2, -1, -1
COVERAGE = 0.8            # share of the template's tokens that must be matched
PIECE = 1 << 20           # characters tokenised at a time (more where these hold too few tokens)
TOKEN = re.compile(r"[^\W_]+")

#: License notices and license texts, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
           "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
           "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
           "conditions: The above copyright notice and this permission notice shall be included in all copies or "
           "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
           "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
           "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
           "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
           "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met: 1. Redistributions of source code must retain the "
                    "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
                    "binary form must reproduce the above copyright notice, this list of conditions and the following "
                    "disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE "
                    "IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
                    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR "
                    "A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
                    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
                    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
                    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
                    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF "
                    "THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met: 1. Redistributions of source code must retain the "
                    "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
                    "binary form must reproduce the above copyright notice, this list of conditions and the following "
                    "disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither "
                    "the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                    "products derived from this software without specific prior written permission. THIS SOFTWARE IS "
                    "PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
                    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
                    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
                    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT "
                    "NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
                    "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
                    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
                    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
           "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
           "SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
           "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
           "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
           "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
           "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO "
            "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
            "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING "
            "FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
            "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
            "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
            "this software for any purpose, including commercial applications, and to alter it and redistribute it "
            "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; "
            "you must not claim that you wrote the original software. If you use this software in a product, an "
            "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
            "versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. "
            "This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
               "software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, "
               "display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, "
               "and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The "
               "copyright notices in the Software and this entire statement, including the above license grant, this "
               "restriction and the following disclaimer, must be included in all copies of the Software, in whole or in "
               "part, and all derivative works of the Software, unless such copies or derivative works are solely in the "
               "form of machine-executable object code generated by a source language processor."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                 "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                 "binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that "
                 "recognize copyright laws, the author or authors of this software dedicate any and all copyright "
                 "interest in the software to the public domain. We make this dedication for the benefit of the public at "
                 "large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
                 "relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                  "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                  "implied. See the License for the specific language governing permissions and limitations under the "
                  "License."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
                "License"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                "License"),
    ("GFDL-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free "
                "Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with "
                "no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
               "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("Artistic-2.0", "You may distribute this program under the terms of the Artistic License, Version 2.0"),
    ("CC-BY-SA-3.0", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may "
                    "apply"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
                       "International License"),
    ("WTFPL", "This program is free software. It comes without any warranty, to the extent permitted by applicable law. "
             "You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public "
             "License, Version 2"),
)


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


class Index:
    """Vocabulary, winnowed inverted index and token numbers of the templates."""

    def __init__(self, templates):
        words = [tokens(t) for _, t in templates]
        if any(len(w) < GRAM for w in words):
            raise ValueError(f"a template has fewer than {GRAM} tokens")
        self.names = [n for n, _ in templates]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for t in words for w in t}))}
        self.sequences = [np.array([self.vocabulary[w] for w in t], np.int64) for t in words]
        self.bands = [min(BAND, max(1, len(s) // 5)) for s in self.sequences]
        #: Tokens of text that an alignment can cover: a band holds hits of up to BAND diagonals and BAND more on either side.
        self.reach = max(len(t) for t in words) + 4 * BAND
        self.base = len(self.vocabulary) + 1
        self.member = np.zeros((len(words), self.base), bool)  # template x token: does it hold it
        for k, seq in enumerate(self.sequences):
            self.member[k, seq] = True
        self.postings: dict[int, dict[int, list]] = {GRAM: {}, GRAM - 1: {}}  # by size of the gram
        for k, seq in enumerate(self.sequences):
            grams = self.grams(seq)
            ranks = [zlib.crc32(int(g).to_bytes(8, "little")) for g in grams]
            kept = set()
            for i in range(max(1, len(grams) - WINDOW + 1)):
                window = range(i, min(i + WINDOW, len(grams)))
                kept.add(min(window, key=lambda j: (ranks[j], -j)))
            short = len(seq) < SHORT
            for j in range(len(grams)) if short else kept:
                self.postings[GRAM].setdefault(int(grams[j]), []).append((k, j))
            for j, g in enumerate(self.grams(seq, GRAM - 1)) if short else ():
                self.postings[GRAM - 1].setdefault(int(g), []).append((k, j))
        self.keys = {size: np.array(sorted(p), np.int64) for size, p in self.postings.items()}

    def grams(self, ids: np.ndarray, size: int = GRAM) -> np.ndarray:
        """Gram numbers; those with an unknown token (0) are 0."""
        n = max(0, len(ids) - size + 1)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(size):
            out = out * self.base + ids[i:i + n]
            known &= ids[i:i + n] > 0
        return np.where(known, out, 0)


def align(template: np.ndarray, text: np.ndarray, low: int, high: int):
    """Best local alignment on diagonals ``low .. high`` (text position minus
    template position): (score, matched, first text token, last text token)."""
    width = high - low + 1
    nothing = (0, 0, -1, -1)
    best, row = nothing, [nothing] * (width + 2)
    for i, t in enumerate(template.tolist()):
        new = [nothing] * (width + 2)
        for c in range(width):
            p = i + low + c
            if not 0 <= p < len(text):
                continue
            s, m, a, b = row[c + 1]                # both go on
            if text[p] == t:
                cell = (s + MATCH, m + 1, p if a < 0 else a, p)
            else:
                cell = (s + MISS, m, a, b)
            s, m, a, b = row[c + 2]                # a template token is missing in the text
            if s + GAP > cell[0]:
                cell = (s + GAP, m, a, b)
            s, m, a, b = new[c]                    # the text has one token more
            if s + GAP > cell[0]:
                cell = (s + GAP, m, a, b)
            if cell[0] > 0:
                new[c + 1] = cell
                if cell[0] > best[0]:
                    best = cell
        row = new
    return best


def candidates(index: Index, ids: np.ndarray):
    """(template, lowest diagonal, highest diagonal) of every band: hits that
    lie closer than two places where the template stands can."""
    hits: dict[int, list] = {}
    for size, postings in index.postings.items():
        grams = index.grams(ids, size)
        at = np.flatnonzero(np.isin(grams, index.keys[size]))
        for p in at.tolist():
            for k, j in postings[int(grams[p])]:
                hits.setdefault(k, []).append(p - j)
    for k, diagonals in hits.items():
        diagonals.sort()
        band = index.bands[k]
        low = last = diagonals[0]
        for d in diagonals[1:]:
            if d > low + band:
                yield k, low - band, last + band
                low = d
            last = d
        yield k, low - band, last + band


def find(index: Index, text: str) -> list[tuple]:
    """(start, end, template, matched, coverage, score) of a text, by start."""
    found, get = set(), index.vocabulary.get
    begin, size, whole = 0, PIECE, False
    while not whole:
        piece, whole = text[begin:begin + size], begin + size >= len(text)
        words, spans = TOKEN.findall(piece), None
        if not whole:
            spans = [m.span() for m in TOKEN.finditer(piece)]
            if spans and spans[-1][1] == len(piece):  # the last token may go on
                words.pop(), spans.pop()
            if len(words) <= index.reach:
                size *= 2
                continue
        ids = np.fromiter((get(w.lower(), 0) for w in words), np.int64, len(words))
        for k, low, high in candidates(index, ids):
            seq = index.sequences[k]
            # No more tokens can match than the stretch holds of the template's own.
            if np.count_nonzero(index.member[k][ids[max(0, low):high + len(seq)]]) < COVERAGE * len(seq):
                continue
            score, matched, a, b = align(seq, ids, low, high)
            if a < 0 or matched < COVERAGE * len(seq):
                continue
            spans = spans or [m.span() for m in TOKEN.finditer(piece)]
            found.add((begin + spans[a][0], begin + spans[b][1], k, matched, matched / len(seq), score))
        if not whole:
            begin, size = begin + spans[len(spans) - index.reach][0], PIECE
    # Best score first; a find that meets a better one goes. Starts and ends of
    # what stays are kept sorted, so a text with many finds is no problem.
    starts, stops, out = [], [], []
    for f in sorted(found, key=lambda f: (-f[5], -f[4], f[0], f[2])):
        i = bisect.bisect_left(starts, f[1])
        if i and stops[i - 1] > f[0]:
            continue
        starts.insert(i, f[0])
        stops.insert(i, f[1])
        out.append(f)
    return sorted(out)


def scan(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per find: doc_id, license, template (its number in the list),
    n_matched, coverage, start, stop (code points of the text)."""
    schema = "doc_id long, license string, template int, n_matched int, coverage double, start long, stop long"
    if not templates:
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates))

    def run(batches):
        index = shared.value
        for batch in batches:
            for a, b in slices(batch.column(1)):
                rows = [(d, index.names[k], k, m, c, x, y) for d, t in zip(
                    batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()) if t
                    for x, y, k, m, c, _ in find(index, t)]
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)],
                                                     ["doc_id", "license", "template", "n_matched", "coverage", "start", "stop"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return narrow.mapInArrow(run, schema)
