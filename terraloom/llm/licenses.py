"""License scan: winnowed fingerprints in an inverted index, then banded alignment.

Every template's word k-grams are hashed and winnowed (the least hash of each window is kept), which makes an inverted
index from fingerprint to places in templates. All k-grams of every document are looked up in it, so each run of words
that a template and a document share and that is as long as a window finds a place. Places of a template whose diagonals
lie within the band form a candidate; a banded alignment of the whole template against that part of the document then gives
the share of the template's words that are matched, and the span of the document that they take.

Wordings of different licenses overlap (one header within another, a clause more or less). Of places that share more than half of the
words of the shorter one, the best stands: matched words, less two for each word of the template that is missing and each word of the
document that is too many; then the longer template, then the first by name. A place right after "not", "never" or the like is none, nor is a
notice with such a word in it.
Tags (SPDX-License-Identifier) are read as they stand, one row for each license of the expression, with the template "spdx".

The templates are whole texts of the shorter licenses, and grants, headers and notices; others may be given as a list or as a
table (license, template, text), of at most `most_bytes` of text, as their index goes to the tasks. Documents are read once, whole, and not shuffled.

Words are split at ASCII white space and compared in lower case by letters and digits only. Edge cases: null text has no
words; templates shorter than k words are found by shorter grams; repeated rows are each reported; null ids are kept.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import with_computed
from terraloom.llm.decontaminate import seeds, words, words_of

GRAM = 3
WINDOW = 3
BAND = 6

# Wordings of public licenses and their usual notices (license, template, text).
TEMPLATES = [
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "licensed", "This project is licensed under the MIT License."),
    ("MIT", "grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "header", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "notice", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "notice", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "grant", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MIT", "text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", "text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", "text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", "text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", "text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", "text", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", "text", """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSL-1.0", "text", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
        The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
]


#: templates of at most so many words are notices: within them, too, no word may turn them round
NOTICE = 20
#: words before a place that turn it round
_NOT = np.array(sorted(int(words(w)[0]) for w in (b"not", b"never", b"isnt", b"arent", b"wasnt", b"no", b"longer", b"without")), np.uint64)
_TAG = re.compile(rb"SPDX-License-Identifier:[ \t]*([^\r\n]*)")
_ID = re.compile(rb"[A-Za-z0-9][A-Za-z0-9.+-]*")
_OPERATORS = frozenset((b"and", b"or", b"with"))


def tags(raw: bytes) -> list[tuple[str, int]]:
    """(license, place among the words) of every license in the document's tags; exceptions after "with" are none."""
    out = []
    for m in _TAG.finditer(raw):
        found = _ID.findall(m[1])
        at = len(words(raw[: m.start()]))
        out += [(x.decode(), at) for k, x in enumerate(found) if x.lower() not in _OPERATORS and not (k and found[k - 1].lower() == b"with")]
    return out


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the rightmost least hash of every window (all windows, or the only, shorter one)."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64)
    w = min(window, n)
    views = np.lib.stride_tricks.sliding_window_view(hashes, w)[:, ::-1]
    return np.unique(np.arange(n - w + 1) + w - 1 - views.argmin(axis=1))


class Index:
    """Inverted index of the templates' winnowed fingerprints."""

    def __init__(self, templates: list[tuple[str, str, str]], gram: int = GRAM, window: int = WINDOW):
        self.names = [(a, b) for a, b, _ in templates]
        self.tokens = [words(t.encode()) for _, _, t in templates]
        self.grams = sorted({min(gram, len(t)) for t in self.tokens if len(t)})
        hashes, item, pos = [], [], []
        for k, t in enumerate(self.tokens):
            if len(t):
                h = seeds(t, tuple(range(min(gram, len(t)))))
                at = winnow(h, window)
                hashes.append(h[at])
                item += [k] * len(at)
                pos += at.tolist()
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.pos = h[order], np.array(item, np.int64)[order], np.array(pos, np.int64)[order]
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self.hash >> np.uint64(48)] = True

    def candidates(self, tokens: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, template, diagonal) of every candidate: least and greatest diagonal of a group lie within the band."""
        begin, hits = np.r_[0, ends], []
        for g in self.grams:
            h = seeds(tokens, tuple(range(g)))
            at = np.flatnonzero(self.seen.take(h >> np.uint64(48), mode="clip"))
            low, high = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
            doc = np.searchsorted(ends, at, "right")
            real = (low < high) & (at + g <= ends[doc])
            at, low, doc, n = at[real], low[real], doc[real], (high - low)[real]
            own = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            hits.append(np.stack([np.repeat(doc, n), self.item[own], np.repeat(at - begin[doc], n) - self.pos[own]], axis=1))
        out: list[tuple[int, int, int]] = []
        for doc, item, d in np.unique(np.concatenate(hits), axis=0).tolist() if hits else []:
            if not out or out[-1][:2] != (doc, item) or d - out[-1][2] > BAND:
                out.append((doc, item, d))
        return out

    def scan(self, raw: pa.Array, least: float) -> list[list[tuple[int, int, int, int]]]:
        """Of each text (template, first word, words, matched words) of the best places that cover at least the share `least` of a template."""
        tokens, ends = words_of(raw)
        begin = np.r_[0, ends]
        found: list[set] = [set() for _ in range(len(raw))]
        for k, item, d in self.candidates(tokens, ends):
            doc, t = tokens[begin[k] : begin[k + 1]], self.tokens[item]
            # no alignment matches more of the template's words than occur near the diagonal
            if np.isin(t, doc[max(0, d - BAND) : max(0, d + len(t) + BAND + 1)]).sum() >= least * len(t):
                first, end, matched = align(t, doc, d, BAND)
                around = doc[max(0, first - 2) : end if len(t) <= NOTICE else first]
                if matched >= least * len(t) and np.isin(around, _NOT).sum() <= (np.isin(t, _NOT).sum() if len(t) <= NOTICE else 0):
                    found[k].add((item, first, end - first, matched))
        return [self.best(f) for f in found]

    def best(self, found: set) -> list[tuple[int, int, int, int]]:
        """Of places that overlap by more than half of the shorter one's words, the best."""

        def order(f):
            item, _, n, matched = f
            return -(matched - 2 * (len(self.tokens[item]) - matched) - 2 * max(0, n - matched)), -len(self.tokens[item]), self.names[item], f

        kept: list[tuple[int, int, int, int]] = []
        for f in sorted(found, key=order):
            if all(2 * (min(f[1] + f[2], o[1] + o[2]) - max(f[1], o[1])) <= min(f[2], o[2]) for o in kept):
                kept.append(f)
        return sorted(kept)


def align(template: np.ndarray, doc: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """Best alignment of the whole template with a stretch of the document near a diagonal: (begin, end, matched words).

    Match +2, replaced word -1, left-out or added word -1; leaving out document words before and after is free.
    """
    a, b = template.tolist(), doc.tolist()
    width = 2 * band + 1
    low = diagonal - band
    worst = -(1 << 30)
    # cell (i, o): i template words used, document position low + i + o; value (score, matched, begin)
    row = [(0, 0, low + o) if 0 <= low + o <= len(b) else (worst, 0, 0) for o in range(width)]
    for i, w in enumerate(a):
        new = []
        for o in range(width):
            p = low + i + 1 + o
            best = (worst, 0, 0)
            if 0 <= p <= len(b):
                if p >= 1:
                    s, m, g = row[o]
                    same = b[p - 1] == w
                    best = (s + 2, m + 1, g if m else p - 1) if same else (s - 1, m, g)
                if o + 1 < width and row[o + 1][0] - 1 > best[0]:
                    s, m, g = row[o + 1]
                    best = (s - 1, m, g)
                if o and new[o - 1][0] - 1 > best[0]:
                    s, m, g = new[o - 1]
                    best = (s - 1, m, g)
            new.append(best)
        row = new
    s, o = max((x[0], -o) for o, x in enumerate(row))
    _, matched, begin = row[-o]
    end = min(len(b), low + len(a) - o)
    return max(0, begin), max(0, begin, end), matched


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", coverage: float = 0.8, most_bytes: int = 32 << 20) -> DataFrame:
    """One row per document and place: id, `license`, `template`, `coverage`, `first_word`, `n_words`."""
    if isinstance(templates, DataFrame):
        size = templates.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        if size > most_bytes:
            raise ValueError(f"the templates have {size} bytes, more than {most_bytes}")
        templates = [tuple(r) for r in templates.where("text is not null").select("license", "template", "text").distinct().orderBy("license", "template", "text").collect()]
    index = Index(TEMPLATES if templates is None else templates)
    fields = [("license", pa.string()), ("template", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())]

    def run(raw: pa.Array) -> list[pa.Array]:
        out = []
        for text, found in zip(raw.to_pylist(), index.scan(raw, coverage), strict=True):
            rows = [(*index.names[i], matched / len(index.tokens[i]), first, n) for i, first, n, matched in found]
            if text and b"SPDX-License-Identifier:" in text:
                rows += [(name, "spdx", 1.0, at, 1) for name, at in tags(text)]
            out.append([dict(zip([f[0] for f in fields], r, strict=True)) for r in rows])
        return [pa.array(out, pa.list_(pa.struct(fields)))]

    out = with_computed(docs, [id_col], [text_col], run, [("_m", "array<struct<license: string, template: string, coverage: double, first_word: bigint, n_words: bigint>>")])
    out = out.toDF("_id", "_m").where(F.size("_m") > 0).select("_id", F.explode("_m").alias("_m"))
    return out.select(F.col("_id").alias(id_col), "_m.*")
