"""License scans by a generalised suffix automaton over the words of licence texts.

A document streams through the automaton, which gives matching statistics: at
each word the longest run up to it that stands in some template.  The suffix
links lead from there to the longest run of every other template's place.  Long
runs are chained, template by template, into covered spans.  A template is found where a
chain covers ``COVERED`` of its words.  Words that no template has, and runs
without three template words in a row, are skipped in numpy; no match can lie there.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cdsloom.llm.common import Words, extended, texts, translated

#: Places of these phrases count as they stand: fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Licence texts and notices by label: fixed values.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "This project is licensed under the MIT License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Released under the BSD License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("eupl-1.2", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence."),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("wtfpl", "This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar."),
    ("busl-1.1", "Use of this software is governed by the Business Source License included in the LICENSE file"),
    ("artistic-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("cddl-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License."),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc0-1.0", "This work has been marked as dedicated to the public domain under CC0 1.0 Universal."),
    ("unlicense", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
]

#: Words of the shortest match that is chained, share of a template that a chain covers, words between two matches of a chain.
SHORTEST, COVERED, GAP = 3, 0.8, 12

#: Words are letters and digits of ASCII in lower case, and all beyond ASCII.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: pa.Array) -> Words:
    return Words(translated(text, _BYTES))


class Automaton:
    """Suffix automaton of several sequences: a state for each class of runs that end at the same places."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        prefixes: list[tuple[int, int, int]] = []
        for k, sequence in enumerate(sequences):
            last = 0
            for at, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                prefixes.append((last, k, at + 1))
        self._order(prefixes, sequences)

    def _order(self, prefixes: list[tuple[int, int, int]], sequences: list[list[int]]) -> None:
        """Each prefix's end once, (template, end, the word after it), in the order of the tree of suffix links.

        What ends where a state's runs end then stands in one stretch, and holds
        the stretches of all states whose links lead to it.
        """
        own: list[list[tuple[int, int, int | None]]] = [[] for _ in self.next]
        below: list[list[int]] = [[] for _ in self.next]
        for state, k, t in prefixes:
            own[state].append((k, t, sequences[k][t] if t < len(sequences[k]) else None))
        for state in range(1, len(self.next)):
            below[self.link[state]].append(state)
        self.all: list[tuple[int, int, int | None]] = []
        self.start, self.end = [0] * len(self.next), [0] * len(self.next)
        todo = [(0, False)]
        while todo:
            state, done = todo.pop()
            if done:
                self.end[state] = len(self.all)
                continue
            self.start[state] = len(self.all)
            self.all += own[state]
            todo.append((state, True))
            todo += [(x, False) for x in below[state]]

    def places(self, state: int) -> list[tuple[int, int, int | None]]:
        """(template, end, the word after it) wherever a state's runs end."""
        return self.all[self.start[state] : self.end[state]]

    def further(self, state: int) -> list[tuple[int, int, int | None]]:
        """Those of a state's suffix link that aren't its own."""
        up = self.link[state]
        return self.all[self.start[up] : self.start[state]] + self.all[self.end[state] : self.end[up]]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        """The state for the runs of ``q`` that aren't longer than one step from ``p``."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, self.next[last][symbol], symbol)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][symbol], symbol)
        return new

    def _walk(self, symbols: list[int]) -> Iterator[tuple[int, int]]:
        """After each symbol the state and the length of the longest run up to it."""
        state, n = 0, 0
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if symbol in self.next[state]:
                state, n = self.next[state][symbol], n + 1
            else:
                state, n = 0, 0
            yield state, n

    def matches(self, symbols: list[int], base: int) -> list[tuple[int, int, int]]:
        """(end, length, state) of runs of ``SHORTEST`` or more that can't be extended to the right; ends count from ``base``."""
        out, was, had = [], 0, 0
        for k, (state, n) in enumerate(self._walk(symbols)):
            if n <= had and had >= SHORTEST:
                out.append((base + k, had, was))
            was, had = state, n
        if had >= SHORTEST:
            out.append((base + len(symbols), had, was))
        return out

    def shared(self, symbols: list[int], base: int) -> list[tuple[int, int, int, int]]:
        """(template, end, template end, length) of all runs of ``SHORTEST`` or more shared with a template that can't be extended there to either side; ends count from ``base``."""
        out = []
        for d, (state, n) in enumerate(self._walk(symbols), 1):
            after = symbols[d] if d < len(symbols) else -1
            places = self.places(state) if n >= SHORTEST else []
            while n >= SHORTEST:
                out += [(k, base + d, t, n) for k, t, symbol in places if symbol != after]
                places = self.further(state)
                state = self.link[state]
                n = self.length[state]
        return out


def chains(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """For each match the most words of a template that a chain up to it covers, and the chain's span of the document.

    ``found``: (document end, template end, length), sorted.  A chain goes forward
    in both, with at most ``GAP`` words between two matches; overlaps count once.
    """
    best: list[tuple[int, int, int]] = []
    for k, (d, t, n) in enumerate(found):
        cover, start = n, d - n
        for j in range(k - 1, -1, -1):
            dj, tj, _ = found[j]
            if dj < d - n - GAP:
                break
            own = min(n, d - dj, t - tj)
            if own > 0 and d - own - dj <= GAP and t - own - tj <= GAP and best[j][0] + own > cover:
                cover, start = best[j][0] + own, best[j][1]
        best.append((cover, start, d))
    return best


def chained(found: list[tuple[int, int, int]], size: int, covered: float) -> list[tuple[int, int, int]]:
    """All chains that cover ``covered`` of the template's ``size`` words and don't overlap better ones in the document, else the best chain.

    What lies between chosen chains is chained again, till no other chain fits in.
    """
    found = sorted(found)
    longest = max(n for *_, n in found)
    out: list[tuple[int, int, int]] = []
    parts = [found]
    while parts:
        part = parts.pop()
        own: list[tuple[int, int]] = []
        for cover, start, end in sorted((x for x in chains(part) if x[0] / size >= covered), key=lambda x: -x[0]):
            at = bisect(own, (start, end))
            if (at == 0 or own[at - 1][1] <= start) and (at == len(own) or end <= own[at][0]):
                own.insert(at, (start, end))
                out.append((cover, start, end))
        if not own:
            continue
        ends = [d for d, *_ in part]
        for a, b in zip([0, *(x for _, x in own)], [*(x for x, _ in own), ends[-1]], strict=True):
            if b - a >= SHORTEST and (b - a) / size >= covered:
                # Matches that reach into a chosen chain count with what lies outside.
                near = part[bisect(ends, a) : bisect(ends, b + longest)]
                rest = sorted((min(d, b), t - max(0, d - b), min(d, b) - max(d - n, a)) for d, t, n in near)
                rest = [x for x in rest if x[2] >= SHORTEST]
                if rest:
                    parts.append(rest)
    return sorted(out, key=lambda x: x[1]) or [max(chains(found), key=lambda x: x[0])]


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES):
        w = words_of(pa.array([t for _, t in templates] + list(PHRASES)))
        names = w.uniq.to_pylist()
        self.ids = {x: k + 1 for k, x in enumerate(names)}
        rows = [(w.idx[a:b] + 1).tolist() for a, b in zip(w.ptr, w.ptr[1:], strict=False)]
        sequences, phrases = rows[: len(templates)], rows[len(templates) :]
        self.phrases = list(zip(phrases, PHRASES.values(), strict=True))
        self.labels = [label for label, _ in templates]
        self.sizes = [len(x) for x in sequences]
        self.automaton = Automaton(sequences)
        self.base = len(names) + 1
        threes = {self.triple(*x[k : k + 3]) for x in sequences for k in range(len(x) - 2)}
        self.threes = np.array(sorted(threes), np.int64)

    def triple(self, a, b, c):
        return (a * self.base + b) * self.base + c

    def scan(self, text: pa.Array, covered: float = COVERED):
        """For each text: words, base places [(start, label)], template spans [(template, start, end, share)].

        A template has the spans of all its chains that cover ``covered`` or more, else that of its best chain.
        """
        w = words_of(text)
        known = np.array([self.ids.get(x, 0) for x in w.uniq.to_pylist()], np.int64)
        seq = known[w.idx] if len(w.idx) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(text)), np.diff(w.ptr))
        out = [(int(n), [], []) for n in np.diff(w.ptr)]
        for phrase, label in self.phrases:
            n = max(0, len(seq) - len(phrase) + 1)
            hit = np.ones(n, bool)
            for k, x in enumerate(phrase):
                hit &= seq[k : k + n] == x
            hit &= row[:n] == row[len(phrase) - 1 :][:n]
            for at in np.flatnonzero(hit):
                out[row[at]][1].append((int(at - w.ptr[row[at]]), label))
        if len(seq) >= SHORTEST:
            n = len(seq) - 2
            at = np.flatnonzero((seq[:n] > 0) & (seq[1 : n + 1] > 0) & (seq[2:] > 0) & (row[:n] == row[2:]))
            at = at[np.isin(self.triple(seq[at], seq[at + 1], seq[at + 2]), self.threes)]
            # Runs of neighbouring triples of one text.
            cut = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])]) if len(at) else at
            found: dict[int, dict[int, list]] = {}
            for a, b in zip(cut, np.r_[cut[1:], len(at)], strict=False):
                r = int(row[at[a]])
                start, end = int(at[a]), int(at[b - 1]) + 3
                for k, d, t, n_ in self.automaton.shared(seq[start:end].tolist(), start - int(w.ptr[r])):
                    found.setdefault(r, {}).setdefault(k, []).append((d, t, n_))
            for r, by in found.items():
                for k, x in by.items():
                    out[r][2].extend((k, start, end, cover / self.sizes[k]) for cover, start, end in chained(x, self.sizes[k], covered))
        return out


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, end: long, share: double>>"


def scanned(docs: DataFrame, *, covered: float = COVERED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and what the scan finds in each whole text: a row per row of ``docs``.

    n_base counts all places of the base phrases, first_word and last_word are
    their smallest and largest start (null if there is none).  labels has the
    base labels and those of templates covered by ``covered`` or more; spans
    has these templates' spans in words.  score is 1 with a base label, else
    the largest share covered.  A null or empty text has no words and labels.
    Texts are scanned whole, whatever their length; rows that repeat a doc_id
    are documents of their own; an empty table gives no rows; other columns are
    not read.  The automaton is built once and sent to the tasks; its size is
    that of the templates.
    """
    scanner = Scanner()

    def make():
        def f(text_: pa.Array, _) -> list[pa.Array]:
            columns: list[list] = [[] for _ in range(8)]
            for n, base, spans in scanner.scan(text_, covered):
                own = [{"label": scanner.labels[k], "start": a, "end": b, "share": s} for k, a, b, s in sorted(spans) if s >= covered]
                starts = [a for a, _ in base]
                names = {x for _, x in base}
                score = 1.0 if base else max((min(1.0, s) for *_, s in spans), default=0.0)
                row = (n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)), ",".join(sorted(names | {x["label"] for x in own})), score, own)
                for c, x in zip(columns, row, strict=True):
                    c.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))]
            return [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]

        return f

    return extended(texts(docs, doc_id=doc_id, text=text), FIELDS, make).drop("text")
