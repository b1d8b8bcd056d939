"""License scan: every run of words of a text against license templates, by the Dice coefficient of their word bigrams.

Texts and templates are normalised (lower case, copyright lines dropped, everything but letters and digits is a gap).
A candidate is any window of consecutive words, over any number of lines: the whole text, a line, a block of lines, a
notice within prose. A copyright line (with a year or sign) is left out between its neighbours, and searched by itself. The windows are all
covered, by these bounds, which lose nothing: the coefficient 2 |A & B| / (|A| + |B|) doesn't fall if a window is
trimmed to bigrams of the template at both ends, nor if it is widened by a bigram of the template, so a best window
begins where a run of the template's bigrams begins; and a text with c of the template's bigrams can't exceed
2 c / (c + |B|), so few texts are searched at all. Bigrams are taken as a set.

The best window is a match, and what lies before and after it is searched likewise, so matches don't overlap. Order:
the highest coefficient, the first template by name, the first place, the fewest words. The line of a match is the one
of its first word. A null or empty text, or one without a window that reaches the threshold, has no license (nulls, 0
matches). Equal rows are scanned each. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

THRESHOLD = 0.8

#: Wordings of public licenses and of the notices that refer to them.
TEMPLATES = {
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "AGPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "AGPL-3.0/notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0/header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause/notice": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0/notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0/header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-2.0/notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0/header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "LGPL-2.0/header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Library General Public License for more details.",
    "LGPL-2.1/header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-2.1/notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "LGPL-3.0/notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT/notice": "Released under the MIT License.",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense/notice": "This is free and unencumbered software released into the public domain.",
}
#: The full texts are files: of a template's name, without what stands behind the terms.
TEMPLATES |= {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted((files("mintleaf.llm") / "license_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}

# a statement with a year or sign: a wrapped line "copyright notice and ..." or an item "(c)" belongs to the license
_COPYRIGHT = re.compile(r"^[ \t]*(?:copyright\b.*?(?:\d{4}|\(c\)|©|year|yyyy|all rights)|\(c\)[ \t]*(?:copyright|\d{4})|©).*$", re.I | re.M)
_WORD = re.compile(r"[^\W_]+")


def normalised_words(text: str) -> list[str]:
    return _WORD.findall(_COPYRIGHT.sub(" ", text).lower())


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    """A single word is its own bigram."""
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else {(w, "") for w in words}


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        self.templates = [(name, bigrams(normalised_words(templates[name]))) for name in sorted(templates)]
        # the bounds on the bigrams of a candidate
        self.bounds = [(threshold / (2 - threshold) * len(t), (2 - threshold) / threshold * len(t)) for _, t in self.templates]
        self.least = min((low for low, _ in self.bounds), default=0)
        self.most = max((high for _, high in self.bounds), default=-1)
        self.owners: dict[tuple[str, str], list[int]] = {}
        for k, (_, t) in enumerate(self.templates):
            for pair in t:
                self.owners.setdefault(pair, []).append(k)
        self.known = frozenset(self.owners)
        # templates of one word, by the word; of equal ones the first
        self.single = {w: own[0] for (w, more), own in self.owners.items() if not more}

    def best(self, text: str) -> tuple[str, float] | None:
        """The best template for one candidate."""
        # n words have at most n bigrams, and a word has a letter at least: too short a candidate is dropped unread
        if len(text) < self.least:
            return None
        words = normalised_words(text)
        if len(words) < self.least:
            return None
        own = bigrams(words)
        if not self.least <= len(own) <= self.most:
            return None
        found = None
        for (name, template), (low, high) in zip(self.templates, self.bounds, strict=True):
            if low <= len(own) <= high and (d := dice(own, template)) >= self.threshold and (found is None or d > found[1]):
                found = name, d
        return found

    def window(self, pairs: list[tuple[str, str]], which: int, start: int, end: int, possible: int) -> tuple[float, int] | None:
        """The best of the windows of pairs[start:end] that begin at start: (coefficient, its end).

        No window there has more than ``possible`` of the template's bigrams.
        """
        template = self.templates[which][1]
        seen: set[tuple[str, str]] = set()
        best, hits = None, 0
        for j in range(start, end):
            pair = pairs[j]
            if pair in seen:
                continue
            seen.add(pair)
            if pair in template:
                hits += 1
                d = 2 * hits / (len(seen) + len(template))
                if d >= self.threshold and (best is None or d > best[0]):
                    best = d, j + 1
                if hits == possible:
                    break
            elif 2 * possible / (possible + len(seen) - hits + len(template)) < self.threshold:
                break
        return best

    def matches(self, words: list[str]) -> list[tuple[float, int, int, int]]:
        """(coefficient, template, first word, end) of the matches in the words."""
        hits = self.known.intersection(zip(words, words[1:], strict=False))
        counts = Counter(t for h in hits for t in self.owners[h])
        near = {t: c for t, c in counts.items() if 2 * c / (c + len(self.templates[t][1])) >= self.threshold}
        single = self.single.keys() & set(words) if self.single else ()
        if not near and not single:
            return []
        pairs = list(zip(words, words[1:], strict=False))
        heap: list[tuple[float, int, int, int]] = [(-1.0, self.single[w], at, at + 1) for at, w in enumerate(words) if w in single]
        heap.sort()

        def push(which: int, start: int, end: int, possible: int) -> None:
            # end counts words: a window of pairs has one word more
            if (got := self.window(pairs, which, start, end - 1, possible)) is not None:
                heappush(heap, (-got[0], which, start, got[1] + 1))

        for t in near:
            template = self.templates[t][1]
            own = [at for at, pair in enumerate(pairs) if pair in template]
            rest: set[tuple[str, str]] = set()
            for k in range(len(own) - 1, -1, -1):
                rest.add(pairs[own[k]])
                if (not k or own[k - 1] < own[k] - 1) and 2 * len(rest) / (len(rest) + len(template)) >= self.threshold:
                    push(t, own[k], len(words), len(rest))
        out, starts, ends = [], [], []
        while heap:
            d, t, start, end = heappop(heap)
            place = bisect_left(starts, start + 1)
            if place and ends[place - 1] > start:
                continue
            limit = starts[place] if place < len(starts) else len(words)
            if end > limit:
                push(t, start, limit, near[t])
                continue
            out.append((-d, t, start, end))
            starts.insert(place, start)
            ends.insert(place, end)
            if end < len(pairs):  # a run of the template's bigrams that began in the match goes on behind it
                for other in near:
                    if pairs[end] in self.templates[other][1] and pairs[end - 1] in self.templates[other][1]:
                        push(other, end, limit, near[other])
        return out

    def scan(self, text: str) -> tuple[str | None, float | None, int | None, int]:
        """(template, coefficient, line of its first word from 1, or 0 for all words of several lines, number of matches)."""
        words = normalised_words(text)
        found = self.matches(words)
        n, best = len(found), None
        if found:
            d, t, start, end = min(found, key=lambda f: (-f[0], *f[1:]))
            whole = "\n" in text and (start, end) == (0, len(words))
            best = -d, t, 0 if whole else self._line(text, start)
        for m in _COPYRIGHT.finditer(text):
            found = self.matches(_WORD.findall(m[0].lower()))
            n += len(found)
            if found and (own := min((-f[0], f[1]) for f in found)) < (best or (1.0,))[:2]:
                best = *own, text.count("\n", 0, m.start()) + 1
            elif found and own == best[:2]:
                best = min(best, (*own, text.count("\n", 0, m.start()) + 1)) if best[2] > 1 else best
        return (self.templates[best[1]][0], -best[0], best[2], n) if best else (None, None, None, 0)

    @staticmethod
    def _line(text: str, word: int) -> int:
        """The line of a word of the text without copyright lines."""
        for line, part in enumerate(text.split("\n"), 1):
            n = len(normalised_words(part))
            if word < n:
                return line
            word -= n
        return 0


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, license, dice, line (0: the whole text), n_matches."""
    given = templates if templates is not None else TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given, threshold)
        for batch in batches:
            found = [scanner.scan(t) if t else (None, None, None, 0) for t in batch.column(1).to_pylist()]
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.int32(), pa.int64()), strict=True))], names=["id", "license", "dice", "line", "n_matches"]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    more = [StructField("license", StringType()), StructField("dice", DoubleType()), StructField("line", IntegerType()), StructField("n_matches", LongType())]
    return rows.mapInArrow(run, StructType([rows.schema["id"], *more]))
