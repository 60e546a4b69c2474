"""License scans: normalised text against licence templates by Dice coefficient over word bigrams.

A text is compared as a whole, by paragraphs (lines up to an empty one), by lines, and by the runs of neighbouring
lines that come nearest to a template, empty lines or not, so a licence is found whether it fills a document, stands
as a header, goes on into code or other paragraphs, or is one sentence in it. Text is normalised alike on both
sides: lower case, words are runs of letters, digits and dots within them, "licence" is "license". With A and B
the sets of word bigrams, Dice is 2 |A & B| / (|A| + |B|), so it reaches the threshold d only if |A| lies within
d / (2 - d) and (2 - d) / d times |B|: templates outside are not compared. For the same reason a text must hold at
least d / (2 - d) of a template's bigrams somewhere for any run of it to reach the threshold; most texts end there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_HEAD = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL_HEAD = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program."""
_LGPL_HEAD = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
You should have received a copy of the GNU Lesser General Public License along with this library."""
_AGPL_HEAD = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.
You should have received a copy of the GNU Affero General Public License along with this program."""
_AGPL_13 = """Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software. This Corresponding Source shall include the Corresponding Source for any work covered by version 3 of the GNU General Public License that is incorporated pursuant to the following paragraph."""
_MPL_HEAD = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

#: (licence, template). A licence may have several.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("ISC", _ISC),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n{_BSD_3}\n{_BSD_TAIL}"),
    ("Apache-2.0", _APACHE_HEAD),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", _GPL_HEAD.format(v=2)),
    ("GPL-3.0", _GPL_HEAD.format(v=3)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", _LGPL_HEAD.format(v="2.1")),
    ("LGPL-3.0", _LGPL_HEAD.format(v=3)),
    ("AGPL-3.0", _AGPL_HEAD),
    ("AGPL-3.0", _AGPL_13),  # what its full text has and the GPL's has not
    ("MPL-2.0", _MPL_HEAD),
    ("Unlicense", _UNLICENSE),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
)
#: Licences whose full text is in the folder licences.
FULL = ("Apache-2.0", "Artistic-1.0-Perl", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0")
_WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")


@lru_cache(maxsize=1)
def all_templates() -> tuple[tuple[str, str], ...]:
    """TEMPLATES, then the full texts."""
    folder = resources.files("tracequarry.llm") / "licences"
    return TEMPLATES + tuple((name, (folder / f"{name}.txt").read_text(encoding="utf-8")) for name in FULL)


def normal_words(text: str) -> list[str]:
    return _WORD.findall(text.lower().replace("licence", "license"))


def bigrams(words: list[str]) -> frozenset[tuple[str, str]]:
    return frozenset(zip(words, words[1:]))


class Matcher:
    """The best template for a list of words."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        self.names = [name for name, _ in templates]
        self.sets = [bigrams(normal_words(t)) for _, t in templates]
        self.threshold = threshold
        ratio = threshold / (2 - threshold)
        self.ratio = ratio
        self.low = min((len(s) for s in self.sets), default=0) * ratio
        self.bounds = [(len(s) * ratio - 1e-9, len(s) / ratio + 1e-9) for s in self.sets]
        self.known = frozenset().union(*self.sets)
        self.firsts = frozenset(a for a, _ in self.known)

    def best(self, words: list[str]) -> tuple[str, float, int] | None:
        """Licence, Dice and how many templates were compared; None below the threshold. Ties go to the first template."""
        if len(words) - 1 < self.low or self.firsts.isdisjoint(words):
            return None
        own = bigrams(words)
        if self.known.isdisjoint(own):
            return None
        found, compared = None, 0
        for name, other, (low, high) in zip(self.names, self.sets, self.bounds):
            if low <= len(own) <= high:
                compared += 1
                dice = 2 * len(own & other) / (len(own) + len(other))
                if dice >= self.threshold and (found is None or dice > found[1]):
                    found = (name, dice, compared)
        return found

    def possible(self, words: list[str]) -> list[int]:
        """Templates that some stretch of a text's words may reach: enough of their bigrams are somewhere in it."""
        own = bigrams(words)
        return [k for k, s in enumerate(self.sets) if len(own) >= len(s) * self.ratio - 1e-9 and len(own & s) >= len(s) * self.ratio - 1e-9]

    def runs(self, lines: list[list[str]]) -> list[tuple[int, int]]:
        """First line and line after the last of the runs nearest to each template, from the threshold on.

        From every line on the run of highest Dice is taken (of equal ones the shortest), and of these the highest
        first, as long as they do not overlap with one already taken for the same template. A run of highest Dice
        begins with a line that a bigram of the template begins in, and ends with one that such a bigram ends in.
        """
        words = [w for x in lines for w in x]
        possible = self.possible(words) if len(words) > 1 else []
        if not possible:
            return []
        line_of = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
        first_of = np.searchsorted(line_of, np.arange(len(lines) + 1))
        number: dict[tuple[str, str], int] = {}
        ids = np.array([number.setdefault(b, len(number)) for b in zip(words, words[1:])])
        order = np.argsort(ids, kind="stable")
        before = np.full(len(ids), -1)  # the place where the same bigram was last
        same = ids[order[1:]] == ids[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        out: dict[tuple[int, int], None] = {}
        for k in possible:
            size, high = len(self.sets[k]), self.bounds[k][1]
            inside = np.zeros(len(number), bool)
            inside[[number[b] for b in self.sets[k] if b in number]] = True
            most, mine = int(inside.sum()), inside[ids]
            ends = np.zeros(len(ids), bool)  # bigrams that end a run: in the template, and the next word is the last of its line
            ends_in = np.unique(line_of[np.flatnonzero(mine) + 1])
            # A line's last bigram (with its first word in the line before, if the line has one word).
            ends[first_of[ends_in + 1] - 2] = True
            found = []
            for line in np.unique(line_of[np.flatnonzero(mine)]).tolist():
                s = int(first_of[line])
                best, a, c, at, width = None, 0, 0, s, 2 * size + 64
                while at < len(ids):
                    to = min(len(ids), at + width)
                    new = before[at:to] < s
                    grown, common = a + np.cumsum(new), c + np.cumsum(new & mine[at:to])
                    stop = np.flatnonzero(ends[at:to] & (grown <= high))
                    if len(stop):
                        dice = 2 * common[stop] / (grown[stop] + size)
                        top = int(dice.argmax())
                        if best is None or dice[top] > best[0]:
                            best = (float(dice[top]), int(line_of[at + stop[top] + 1]) + 1)
                    a, c, at, width = int(grown[-1]), int(common[-1]), to, 2 * width
                    # No longer run from here can be better.
                    if a > high or 2 * most / (a + size) <= (best[0] if best else 0):
                        break
                if best and best[0] >= self.threshold:
                    found.append((-best[0], line, best[1]))
            taken = np.zeros(len(lines), bool)
            for _, begin, end in sorted(found, key=lambda x: (x[0], x[1], x[2])):
                if not taken[begin:end].any():
                    taken[begin:end] = True
                    out[begin, end] = None
        return sorted(out)


@lru_cache(maxsize=2)
def matcher_of(templates: tuple[tuple[str, str], ...], threshold: float) -> Matcher:
    return Matcher(templates, threshold)


def units(text: str, matcher: Matcher | None = None) -> Iterator[tuple[int, int, list[str]]]:
    """First line, line after the last, and words of: every line, every paragraph of several lines, the whole text if it has several of those, and the matcher's runs, each range once."""
    lines = [normal_words(x) for x in text.split("\n")]
    blank = [not x.strip() for x in text.split("\n")]
    seen = set()
    for i, words in enumerate(lines):
        if words:
            seen.add((i, i + 1))
            yield i, i + 1, words
    begin, paragraphs = 0, []
    for i in range(len(lines) + 1):
        if i == len(lines) or blank[i]:
            if i - begin > 1:
                seen.add((begin, i))
                yield begin, i, [w for x in lines[begin:i] for w in x]
            if i > begin:
                paragraphs.append(begin)
            begin = i + 1
    if len(paragraphs) > 1:
        seen.add((0, len(lines)))
        yield 0, len(lines), [w for x in lines for w in x]
    for begin, end in (matcher or matcher_of(all_templates(), THRESHOLD)).runs(lines):
        if (begin, end) not in seen:
            yield begin, end, [w for x in lines[begin:end] for w in x]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Licences in every whole text.

    templates: (licence, template) pairs, all_templates() if not given. Returns one row for each input row: id_col, licence (of the best hit; of equal ones the first in the text, then
    the shortest; null if none), dice double (its coefficient; 0 if none), first_line and last_line int (of that
    hit, from 0, inclusive; null if none), n_hits long (units that reach the threshold) and licences
    array<string> (all found, sorted). A null or empty text has no hit. Repeated rows and null ids give rows too.
    One pass without a shuffle; the templates travel with the task.
    """
    kind = dict(docs.dtypes)[id_col]
    templates = all_templates() if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for batch in batches:
            out: list[tuple] = []
            for t in batch.column(1):
                text = t.as_py() or ""
                hits = [(-hit[1], begin, end, hit[0]) for begin, end, words in units(text, matcher) if (hit := matcher.best(words))] if matcher.possible(normal_words(text)) else []
                top = min(hits, default=None)
                out.append((top[3], -top[0], top[1], top[2] - 1, len(hits), sorted({h[3] for h in hits})) if top else (None, 0.0, None, None, 0, []))
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[id_col, "licence", "dice", "first_line", "last_line", "n_hits", "licences"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, licence string, dice double, first_line int, last_line int, n_hits long, licences array<string>")
