"""Licence scan: a generalised suffix automaton over the words of licence templates and phrases.

Texts are streamed through the automaton word by word. That gives matching statistics: for each word, the longest run
ending there which stands somewhere in a template. Runs of LONG words or more are chained, in order, into every template that
they stand in, at every place there; of all chains whose gaps are no longer than the template the one that covers most is
taken, then the best ones before and after it. What a chain covers of a template is its score, and enough of it gives the
template's label. Phrases are templates as well; a phrase stands where the matched run ends with it as a whole.

The automaton is built from fixed templates once in a task; its size does not depend on the documents. Map-only.

Defined results: a null or empty text has no words, labels or spans and score 0; rows are independent; an empty table
gives an empty one; other columns may be kept by name.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import ASCII_LOWER, map_texts

# Phrases with their labels, and public licence texts.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License. You are free to share, copy and redistribute the material in any medium or format, and to adapt, remix, transform, and build upon the material for any purpose, even commercially, under the following terms: you must give appropriate credit, provide a link to the license, and indicate if changes were made."),
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Least words of a run that is chained; least share of a template that gives its label.
LONG, ENOUGH = 5, 0.5


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(ASCII_LOWER))


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences. For each state: next states, suffix link, longest length, and
    the places (sequence, end) that were read into it; places_of gives all places where its words stand."""

    def __init__(self, sequences: list[list[str]]):
        self.step: list[dict[str, int]] = [{}]
        self.link, self.longest, self.own = [-1], [0], [[]]
        for n, words in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self.own[last].append((n, i + 1))

    def _state(self, longest: int, link: int, step: dict[str, int]) -> int:
        self.step.append(step)
        self.link.append(link)
        self.longest.append(longest)
        self.own.append([])
        return len(self.step) - 1

    def _extend(self, last: int, word: str) -> int:
        if word in self.step[last]:
            there = self.step[last][word]
            return there if self.longest[there] == self.longest[last] + 1 else self._clone(last, word, there)
        new = self._state(self.longest[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            there = self.step[at][word]
            self.link[new] = there if self.longest[there] == self.longest[at] + 1 else self._clone(at, word, there)
        return new

    def _clone(self, at: int, word: str, there: int) -> int:
        """A copy of there for the shorter contexts that reach it through at."""
        new = self._state(self.longest[at] + 1, self.link[there], dict(self.step[there]))
        self.link[there] = new
        while at >= 0 and self.step[at].get(word) == there:
            self.step[at][word] = new
            at = self.link[at]
        return new

    def places_of(self, least: int) -> list[list[tuple[int, int]]]:
        """For each state whose words can be least or more, all places where they stand: its own, and those of the states
        that link to it."""
        places: list[set] = [set(x) for x in self.own]
        for s in sorted(range(1, len(self.step)), key=self.longest.__getitem__, reverse=True):
            places[self.link[s]] |= places[s] if self.longest[self.link[s]] >= least else set()
        return [sorted(p) if n >= least else [] for p, n in zip(places, self.longest, strict=True)]

    def find(self, words: list[str]) -> int:
        at = 0
        for w in words:
            at = self.step[at][w]
        return at

    def statistics(self, words: list[str]):
        """(index, state, matched length) of each word at which a match ends; others match nothing."""
        step, link, longest, root = self.step, self.link, self.longest, self.step[0]
        at = length = 0
        for i, w in enumerate(words):
            if at == 0:
                if w not in root:
                    continue
                at, length = root[w], 1
            else:
                while at and w not in step[at]:
                    at = link[at]
                    length = longest[at]
                if w not in step[at]:
                    length = 0
                    continue
                at, length = step[at][w], length + 1
            yield i, at, length


class LicenceScanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [x for x, _ in templates]
        self.sizes = [len(words_of(t)) for _, t in templates]
        self.phrases = [(words_of(p), label) for p, label in phrases]
        self.automaton = a = SuffixAutomaton([words_of(t) for _, t in templates] + [p for p, _ in self.phrases])
        own = defaultdict(list)
        for n, (p, _) in enumerate(self.phrases):
            own[a.find(p)].append(n)
        # The phrases that end at a state: its own, which need their whole length, and those of the states it links to.
        self.places = a.places_of(LONG)
        self.ends: list[list[int]] = [[] for _ in a.step]
        for s in sorted(range(1, len(a.step)), key=a.longest.__getitem__):
            self.ends[s] = [*own[s], *self.ends[a.link[s]]]

    def scan(self, text: str | None) -> dict:
        """n_words, base [(word index, label)], spans [(label, first word, last word exclusive, words matched, score)]."""
        words = words_of(text)
        base: list[tuple[int, str]] = []
        runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        open_: dict[tuple[int, int], int] = {}  # (sequence, end there) of the runs that reach the word before: place in runs
        for i, state, length in self.automaton.statistics(words):
            for n in self.ends[state]:
                p, label = self.phrases[n]
                if len(p) <= length:
                    base.append((i + 1 - len(p), label))
            if length >= LONG:
                now = {}
                for sequence, end in self.places[state]:
                    if sequence < len(self.sizes):
                        found, at = runs[sequence], open_.get((sequence, end - 1))
                        if at is not None and found[at][0] == i:
                            found[at] = (i + 1, end, found[at][2] + 1)  # the same run, longer
                        else:
                            found.append((i + 1, end, length))
                            at = len(found) - 1
                        now[sequence, end] = at
                open_ = now
            else:
                open_ = {}
        spans = [s for n in sorted(runs) for s in self._chains(n, sorted(runs[n]))]
        return {"n_words": len(words), "base": sorted(base), "spans": spans}

    def _chains(self, sequence: int, runs: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int, float]]:
        """Runs (end in the text, end in the template, length) in order of the text, as the spans of the best chains.

        The chain that covers most is taken, then the best of what is left on either side. What it leaves on its left keeps its
        chains; on its right only those are computed anew that came through what was taken, which are within a gap of it. So
        the work grows with the runs, times those within a gap of one."""
        size, n = self.sizes[sequence], len(runs)
        covered, first, before, reach = [0] * n, [0] * n, [-1] * n, [0] * n
        alive = bytearray(b"\1") * n

        def extend(j: int, low: int) -> None:
            """The best chain that ends with run j and has no run before low."""
            at, end, length = runs[j]
            covered[j], first[j], before[j] = length, at - length, -1
            for i in range(max(low, reach[j]), j):  # what ends within the gap allowed; at most a template's worth of places each
                a, e, _ = runs[i]
                if a < at and e < end:
                    gain = covered[i] + min(length, at - a, end - e)
                    if gain > covered[j]:
                        covered[j], first[j], before[j] = gain, first[i], i

        ends = [at for at, _, _ in runs]
        for j, (at, _, length) in enumerate(runs):
            reach[j] = bisect_left(ends, at - length - size)
            extend(j, 0)
        heap, out = [(-c, j) for j, c in enumerate(covered)], []
        heapify(heap)
        while heap:
            most, best = heappop(heap)
            if not alive[best] or covered[best] != -most:
                continue
            start, stop = first[best], runs[best][0]
            out.append((self.labels[sequence], start, stop, covered[best], covered[best] / size))
            low, high = best, best + 1
            while low and alive[low - 1] and runs[low - 1][0] > start:
                low -= 1
            while high < n and alive[high] and runs[high][0] - runs[high][2] < stop:
                high += 1
            alive[low:high] = bytes(high - low)
            changed, last, j = set(), high - 1, high
            while j < n and alive[j] and ends[j] - 2 * size <= ends[last]:  # no run is longer than the template, nor a gap
                if 0 <= before[j] < high or before[j] in changed:
                    extend(j, high)
                    changed.add(j)
                    last = j
                    heappush(heap, (-covered[j], j))
                j += 1
        return sorted(out, key=lambda s: s[1])


SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("matched", T.LongType()), T.StructField("score", T.DoubleType())])
FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN)),
]


def scan_licenses(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """The columns in keep; n_words, n_base, first_word, last_word (null without a place), base_labels, labels, score and
    spans. score: the largest covered share of a template, 0.5 at least where a phrase stands; 0 without any."""

    def start():
        scanner = LicenceScanner(templates, phrases)

        def one(text):
            x = scanner.scan(text)
            places, base = [i for i, _ in x["base"]], {label for _, label in x["base"]}
            more = {s[0] for s in x["spans"] if s[4] >= ENOUGH}
            score = min(1.0, max([0.5 if base else 0.0, *(s[4] for s in x["spans"])]))
            spans = [dict(zip(SPAN.names, s, strict=True)) for s in x["spans"]]
            return x["n_words"], len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score, spans

        return lambda texts: [one(t) for t in texts]

    return map_texts(docs, start, FIELDS, list(keep))
