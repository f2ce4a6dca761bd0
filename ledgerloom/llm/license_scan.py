"""License scans by template markup (operator 6).

A template is a license's or notice's wording, in which `<<? ... ?>>` holds what may be left out and `<<~n>>` stands for
up to n words of any wording (names, years). It is compiled into an automaton over words; a text is accepted from some
word on if it runs through the automaton, so mandatory words must stand there exactly, in order, with nothing between.
Case, punctuation and line breaks don't matter, as words hold neither.

Beside that, places of a few plain phrases are counted.

Null texts count as empty: no word, no place, no label, score 0. Texts of any length are scanned whole; rows are scanned
one by one, so repeated rows and ids do no harm; an empty table gives no row. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_chunks, utf8

#: Words are runs of digits, a-z and all bytes of non-ASCII characters, after A-Z are lower-cased.
IN_WORD = np.zeros(256, bool)
IN_WORD[ord("0") : ord("9") + 1] = IN_WORD[ord("a") : ord("z") + 1] = IN_WORD[128:] = True
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public license wordings as templates. Fixed values.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<~16>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND <<~16>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<~16>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<? 1 | a ?>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<? 2 | b ?>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of <<~16>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY <<~16>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<~16>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
_GPL = "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or <<? (at your option) ?>> any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program"

#: Whole wordings of licenses, and the notices by which their authors say to put files under them.
WHOLE = {
    "mit-text": f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files <<? (the \"Software\") ?>> to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<? (including the next paragraph) ?>> shall be included in all copies or substantial portions of the Software. {_AS_IS}",
    "isc-text": f"Permission to use, copy, modify, and<<? /or ?>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}",
    "0bsd-text": f"Permission to use, copy, modify, and<<? /or ?>> distribute this software for any purpose with or without fee is hereby granted. {_ISC_AS_IS}",
    "bsd-2-clause-text": f"{_BSD} {_BSD_AS_IS}",
    "bsd-3-clause-text": f"{_BSD} <<? 3 | c ?>> {_BSD_NAMES}. {_BSD_AS_IS}",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<? 1 ?>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<? 2 ?>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<? 3 ?>> This notice may not be removed or altered from any source distribution",
    "unlicense-text": f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_AS_IS}",
    "apache-2.0-text": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<? http | https ?>> <<? www ?>> apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License",
    "gpl-2.0-text": f"This program is free software; you can redistribute it and/or modify {_GPL.format(2)}",
    "gpl-3.0-text": f"This program is free software: you can redistribute it and/or modify {_GPL.format(3)}",
}

#: Statements that something is under a license, whole.
NOTICES = {
    "mit-notice": "<<? released | licensed | distributed ?>> under <<? the | the terms of the ?>> MIT license",
    "apache-2.0": "licensed under the Apache License <<? , ?>> Version 2.0",
    "gpl-2.0": "<<? under ?>> the GNU General Public License <<? as published by the Free Software Foundation ?>> <<? either ?>> version 2",
    "gpl-3.0": "<<? under ?>> the GNU General Public License <<? as published by the Free Software Foundation ?>> <<? either ?>> version 3",
    "lgpl": "the GNU <<? Lesser | Library ?>> General Public License <<? as published by the Free Software Foundation ?>> <<? either ?>> version 2.1",
    "agpl-3.0": "the GNU Affero General Public License <<? as published by the Free Software Foundation ?>> <<? either ?>> version 3",
    "mpl-2.0": "subject to the terms of the Mozilla Public License <<? , v. ?>> <<? version ?>> 2.0",
    "cc-by-4.0": "licensed under <<? a | the ?>> <<? Creative Commons Attribution ?>> <<? CC BY ?>> 4.0 <<? International ?>>",
    "cc-by-nc-4.0": "licensed under <<? a | the ?>> CC BY-NC 4.0",
    "cc-by-sa-4.0": "licensed under <<? a | the ?>> CC BY-SA 4.0",
    "cc0": "<<? dedicated to ?>> the public domain under <<? the ?>> CC0",
    "all-rights-reserved": "Copyright <<~12>> All rights reserved",
}

#: Openings and single clauses of licenses: what follows may differ from the license's wording, so they say less.
PARTS = {
    "mit-part": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "isc-part": "Permission to use, copy, modify, and<<? /or ?>> distribute this software for any purpose with or without fee is hereby granted",
    "bsd-part": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-3-part": _BSD_NAMES,
    "unlicense-part": "This is free and unencumbered software released into the public domain",
}
TEMPLATES = WHOLE | NOTICES | PARTS
#: The score of a text by the best that stands in it.
SCORES = dict.fromkeys(WHOLE, 1.0) | dict.fromkeys(NOTICES, 0.8) | dict.fromkeys(PARTS, 0.6)
PHRASE_SCORE = 0.5

MARK = re.compile(r"<<\?|\?>>|<<~(\d+)>>|\||[^\s<>|?]+|\S")


@dataclass
class Automaton:
    """States are numbers, 0 the first and `last` the accepting one. `on[s]` has the states that a word leads to, `free[s]`
    those that are reached without one, `any` those that any word leads on from."""

    label: str
    on: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    anything: dict[int, int] = field(default_factory=dict)
    last: int = 0

    def new(self) -> int:
        self.on.append({})
        self.free.append([])
        return len(self.on) - 1

    def closed(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def step(self, states: set[int], word: bytes) -> set[int]:
        out = {t for s in states if (t := self.on[s].get(word)) is not None} | {self.anything[s] for s in states if s in self.anything}
        return self.closed(out)

    def starts(self) -> set[bytes]:
        """Words that an accepted run can begin with."""
        return {w for s in self.closed({0}) for w in self.on[s]}

    def mandatory(self) -> set[bytes]:
        """Words that each accepted run holds: without one of them the last state can't be reached."""

        def reached(without: bytes | None) -> bool:
            seen, todo = {0}, [0]
            while todo:
                s = todo.pop()
                onward = [t for w, t in self.on[s].items() if w != without] + self.free[s] + ([self.anything[s]] if s in self.anything else [])
                for t in onward:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return self.last in seen

        return {w for w in {x for s in self.on for x in s} if not reached(w)}

    def run(self, words: list[bytes], at: int) -> int:
        """Where the shortest accepted run from word `at` ends, or -1."""
        states = self.closed({0})
        for k in range(at, len(words)):
            states = self.step(states, words[k])
            if not states:
                return -1
            if self.last in states:
                return k + 1
        return -1


def compiled(label: str, template: str) -> Automaton:
    """The automaton of one template."""
    a, at = Automaton(label), 0
    open_groups: list[tuple[int, int]] = []  # where each optional region begins and where it ends
    for m in MARK.finditer(template):
        if m[0] == "<<?":
            open_groups.append((at, a.new()))
        elif m[0] in ("|", "?>>"):
            start, end = open_groups[-1]
            a.free[at].append(end)
            at = start
            if m[0] == "|":
                at = a.new()
                a.free[start].append(at)
            else:
                a.free[start].append(end)
                open_groups.pop()
                at = end
        elif m[1]:
            ends = a.new()
            for _ in range(int(m[1])):
                a.free[at].append(ends)
                a.anything[at] = a.new()
                at = a.anything[at]
            a.free[at].append(ends)
            at = ends
        else:
            for word in WORD.findall(m[0].encode().lower()):
                if a.on[at]:  # another branch goes on from here by a word
                    a.free[at].append(fork := a.new())
                    at = fork
                a.on[at][word] = a.new()
                at = a.on[at][word]
    a.last = at
    return a


def hint_words(needs: list[set[bytes]]) -> list[bytes]:
    """Words such that each of `needs` has one of them, so a text that holds none, not even inside a word, has no run and
    no phrase. Long words are rare in prose: the one that serves most needs is taken in turn, of seven letters at least
    where there is one."""
    out, left = [], list(needs)
    while left:
        long = [{w for w in x if len(w) >= 7} or {max(x, key=lambda w: (len(w), w))} for x in left]
        best = max({w for x in long for w in x}, key=lambda w: (sum(w in x for x in long), len(w), w))
        out.append(best)
        left = [x for x in left if best not in x]
    return out


class Scanner:
    """All automata, found by the words that their runs begin with."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.automata = [compiled(k, v) for k, v in templates.items()]
        self.by_start: dict[bytes, list[Automaton]] = {}
        for a in self.automata:
            for w in a.starts():
                self.by_start.setdefault(w, []).append(a)
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.hints = re.compile(b"|".join(map(re.escape, hint_words([a.mandatory() for a in self.automata] + [set(p) for p, _ in self.phrases]))))

    def scan(self, text: bytes) -> tuple[list[bytes], list[tuple[int, str]], list[tuple[int, int, str]]]:
        """Its words, (start, label) of the phrases, (start, end, label) of the templates' runs."""
        words = WORD.findall(text)
        places = [(k, label) for phrase, label in self.phrases for k, w in enumerate(words) if w == phrase[0] and words[k : k + len(phrase)] == phrase]
        runs = []
        for k, w in enumerate(words):
            for a in self.by_start.get(w, ()):
                if (end := a.run(words, k)) >= 0:
                    runs.append((k, end, a.label))
        return words, places, runs


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(TEMPLATES, PHRASES)


def count_words(text: bytes) -> int:
    """Words of a lower-cased text, by its bytes."""
    inside = IN_WORD[np.frombuffer(text, np.uint8)]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]) + inside[:1].sum())


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans of the templates' runs.

    score is 1 if a license's whole wording stands in the text, 0.8 if a whole notice does, 0.6 if only an opening or a
    clause of a license does, 0.5 if only a phrase does, else 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner()
        for part in in_chunks(batches):
            rows = []
            for text in utf8(part.column(1)):
                low = text.lower()
                if not scan.hints.search(low):
                    rows.append((count_words(low), 0, None, None, "", "", 0.0, ""))
                    continue
                words, places, runs = scan.scan(low)
                base = {x for _, x in places}
                labels = base | {x for _, _, x in runs}
                at = [k for k, _ in places]
                spans = ",".join(f"{x}:{a}:{b}" for a, b, x in sorted(runs))
                rows.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), max([SCORES[x] for _, _, x in runs] + [PHRASE_SCORE] * bool(at), default=0.0), spans))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
