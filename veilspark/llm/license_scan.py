"""License scans: matching statistics of files against one automaton of all licence texts.

A generalised suffix automaton holds the token sequences of the licence texts and of the short
base phrases. A file's tokens stream through it; at each token the automaton's state and
match length say which substrings of licences end there. Long maximal matches are chained
along a licence. A chain names its licence if it holds one of the phrases that only this licence
has, and enough of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import runs, texts_of

#: Words are runs of a-z, 0-9 and everything beyond ASCII; on UTF-8 bytes lower() changes A-Z alone.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Phrases that count wherever their words stand consecutively (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Licence texts and notices (fixed values: the licences' own wording), each with the phrases that tell it from all others.
TEMPLATES = {
    "agpl": [
        (
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
            ("GNU Affero General Public License",),
        )
    ],
    "apache": [
        (
            "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
            "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
            ("Apache License", "apache.org/licenses", "for the specific language governing permissions and limitations under the License"),
        )
    ],
    "bsd": [
        (
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
            "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
            "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
            "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
            ("Redistribution and use in source and binary forms", "Redistributions of source code must retain", "Redistributions in binary form must reproduce"),
        )
    ],
    "cc-by": [("This work is licensed under a Creative Commons Attribution 4.0 International License", ("Creative Commons Attribution 4.0",)), ("Creative Commons Attribution 3.0 Unported License", ("Creative Commons Attribution 3.0",))],
    "cc-by-nc": [("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("Creative Commons Attribution NonCommercial 4.0",)), ("Licensed under CC BY-NC 4.0", ("CC BY-NC 4.0",))],
    "cc-by-nd": [("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ("Creative Commons Attribution NoDerivatives 4.0",)), ("Licensed under CC BY-ND 4.0", ("CC BY-ND 4.0",))],
    "cc-by-sa": [("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("Creative Commons Attribution ShareAlike 4.0",)), ("Licensed under CC BY-SA 4.0", ("CC BY-SA 4.0",))],
    "cc0": [("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)), ("CC0 1.0 Universal Public Domain Dedication", ("CC0 1.0 Universal",))],
    "gpl": [
        (
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
            "You should have received a copy of the GNU General Public License along with this program.",
            ("GNU General Public License",),
        )
    ],
    "isc": [
        (
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
            "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
            "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
            ("distribute this software for any purpose with or without fee", "with or without fee is hereby granted", "the author disclaims all warranties with regard to this software"),
        ),
    ],
    "lgpl": [
        (
            "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
            "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
            ("GNU Lesser General Public License",),
        )
    ],
    "mit": [
        (
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
            "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
            "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
            "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
            ("to deal in the Software without restriction including without limitation the rights", "shall be included in all copies or substantial portions of the Software"),
        )
    ],
    "mpl": [("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("Mozilla Public License", "copy of the MPL was not distributed with this file"))],
    "unlicense": [
        (
            "This is free and unencumbered software released into the public domain. "
            "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
            "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
            "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
            "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
            ("free and unencumbered software released into the public domain", "dedicate any and all copyright interest in the software to the public domain"),
        )
    ],
    "zlib": [
        (
            "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
            "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
            "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
            "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
            ("Permission is granted to anyone to use this software for any purpose including commercial applications", "Altered source versions must be plainly marked as such"),
        )
    ],
}

#: A match of fewer words is left out of chains; a chain steps over at most GAP words. A chain with a telling phrase names its licence from SHARE of the licence's words on, or from ENOUGH words.
LONG, GAP, SHARE, ENOUGH = 3, 12, 0.6, 20


def tokens(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


class LicenseAutomaton:
    """Generalised suffix automaton of token sequences with, for each state, the phrases and template places that end in it."""

    def __init__(self, templates: dict[str, list[tuple[str, tuple[str, ...]]]], base: dict[str, str]):
        texts = [(label, *template) for label in sorted(templates) for template in templates[label]]
        self.labels = [(label, len(tokens(text))) for label, text, _ in texts]
        self.phrases = sorted(base.items())
        self.vocabulary = _Vocabulary()
        self.next, self.link, self.size = [{}], [-1], [0]
        code = lambda text: [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in tokens(text)]
        sequences = [code(text) for _, text, _ in texts]
        phrases = [code(text) for text, _ in self.phrases]
        #: Places (first word, last word) of each template's telling phrases.
        self.telling = [[(i, i + len(p) - 1) for p in map(code, tell) for i in range(len(s)) if s[i : i + len(p)] == p] for s, (_, _, tell) in zip(sequences, texts, strict=True)]
        for sequence in sequences + phrases:
            last = 0
            for c in sequence:
                last = self._extend(last, c)
        n = len(self.next)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        hits: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for t, sequence in enumerate(sequences):
            s = 0
            for e, c in enumerate(sequence):
                s = self.next[s][c]
                ends[s].append((t, e))
        for p, sequence in enumerate(phrases):
            s = 0
            for c in sequence:
                s = self.next[s][c]
            hits[s].append((p, len(sequence)))
        by_size = sorted(range(1, n), key=self.size.__getitem__)
        for s in by_size:  # a suffix ends wherever the longer string does
            hits[s] = hits[s] + hits[self.link[s]]
        for s in reversed(by_size):
            ends[self.link[s]] = sorted({*ends[self.link[s]], *ends[s]}) if self.link[s] else []
        self.ends, self.hits = ends, hits
        pairs = np.zeros((len(self.vocabulary) + 1,) * 2, bool)
        for sequence in sequences + phrases:
            pairs[sequence[:-1], sequence[1:]] = True
        self.pairs = pairs

    def _state(self, nexts: dict, link: int, size: int) -> int:
        self.next.append(nexts)
        self.link.append(link)
        self.size.append(size)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of p's longest string followed by c, apart from q's longer ones."""
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(dict(self.next[q]), self.link[q], self.size[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        new, p = self._state({}, 0, self.size[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][c], c)
        return new

    def statistics(self, codes: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest substring of any template that ends here) at each token."""
        s = n = 0
        nexts, link, size = self.next, self.link, self.size
        for c in codes:
            while s and c not in nexts[s]:
                s = link[s]
                n = size[s]
            if c in nexts[s]:
                s = nexts[s][c]
                n += 1
            yield s, n

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """(words, base phrases as (phrase, first word), matches as (template, its first word, the file's first word, words))."""
        words = tokens(text)
        codes = np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words))
        base: list[tuple[int, int]] = []
        found: list[tuple[int, int, int, int]] = []
        ok = self.pairs[codes[:-1], codes[1:]]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8)))
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            was, length = 0, 0
            for i, (s, n) in enumerate(self.statistics(codes[lo : hi + 1].tolist()), lo):
                if length >= LONG and n <= length:
                    found += [(t, e - length + 1, i - length, length) for t, e in self.ends[was]]
                base += [(p, i - k + 1) for p, k in self.hits[s] if k <= n]
                was, length = s, n
            if length >= LONG:
                found += [(t, e - length + 1, hi - length + 1, length) for t, e in self.ends[was]]
        return len(words), base, found

    def spans(self, found: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, int, float, bool]]:
        """(label, first word, last word, words covered, their share of the template, whether it names the licence) of each template's best chain.

        A chain is a sequence of matches that go on in the file and in the template, each
        at most GAP words after the one before; words that the one before holds count once. The
        best chain holds a telling phrase inside one of its matches, if any does, and then the most words.
        """
        best: dict[int, tuple[bool, int, int, int]] = {}
        chains: dict[int, list[tuple[int, int, int, list[tuple[int, int] | None]]]] = {}
        for t, at, i, n in sorted(set(found), key=lambda x: (x[2], x[1], x[0])):
            tells = any(at <= a and b < at + n for a, b in self.telling[t])
            mine: list[tuple[int, int] | None] = [None, None]  # (words, -first word) of the best chain that ends here without, with a telling phrase
            mine[tells] = (n, -i)
            live = []
            for c in chains.get(t, []):
                start, end, to, held = c
                if end + GAP + 1 < i:
                    continue
                live.append(c)
                over = max(0, to - at + 1, end - i + 1)  # words that the chain has already
                if over < n and start <= i and at <= to + GAP + 1 and at + n - 1 > to and i + n - 1 > end:
                    for told, x in enumerate(held):
                        if x is not None:
                            longer = (x[0] + n - over, x[1])
                            mine[told or tells] = max(mine[told or tells] or longer, longer)
            live.append((i, i + n - 1, at + n - 1, mine))
            chains[t] = live
            for told, x in enumerate(mine):
                if x is not None:
                    best[t] = max(best.get(t, (False, 0, 0, 0)), (bool(told), x[0], x[1], -(i + n - 1)))
        out = []
        for t, (told, words, first, last) in best.items():
            label, size = self.labels[t]
            out.append((label, -first, -last, words, min(1.0, words / size), told and words >= min(ENOUGH, SHARE * size)))
        return sorted(out)


@lru_cache(maxsize=1)
def _automaton() -> LicenseAutomaton:
    return LicenseAutomaton(TEMPLATES, BASE)


def _scanned(key: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        names = [label for _, label in automaton.phrases]
        for batch in batches:
            texts = texts_of(batch, column)
            for lo, hi in runs(texts):
                rows = []
                for text in texts[lo:hi]:
                    n, base, found = automaton.scan(text)
                    rows.append({"n_words": n, "base": [{"label": names[p], "first_word": i} for p, i in base], "spans": [dict(zip(SPAN, x, strict=True)) for x in automaton.spans(found)]})
                out = pa.Table.from_pylist(rows, schema=ARROW).to_batches()
                for part in out:
                    yield pa.RecordBatch.from_arrays([batch.column(key).slice(lo, hi - lo), *part.columns], names=[key, *part.schema.names])

    return run


SPAN = ("label", "first_word", "last_word", "words", "share", "named")
ARROW = pa.schema([
    ("n_words", pa.int64()),
    ("base", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("words", pa.int64()), ("share", pa.float64()), ("named", pa.bool_())]))),
])


def scan_licenses(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, n_words, base (label and first word of every place of a base phrase) and spans of every whole text.

    spans: for each licence text met by a match of LONG words or more, its best chain: label,
    first and last word, words and share of the licence covered, and named: the chain holds a
    phrase that only this licence has, and SHARE or ENOUGH of its words, so the file carries
    this licence. Null text counts as empty (no words, empty arrays). Rows are independent:
    repeated rows come out repeated, an empty table gives an empty result, other columns are
    not read. No shuffle.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words long, base array<struct<label:string,first_word:long>>, spans array<struct<label:string,first_word:long,last_word:long,words:long,share:double,named:boolean>>"
    return docs.select(key, column).mapInArrow(_scanned(key, column), schema)
