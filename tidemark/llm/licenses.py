r"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures them.

Templates are tokenised (ASCII words, lower case) and their k-grams hashed; of each window of WINDOW hashes the least is kept.
An inverted index leads from a kept hash to (template, place). All k-grams of a document are looked up in it, so no fingerprint of a
template is missed; hits of a template near a diagonal make a candidate. If the document's tokens around the diagonal, in any order,
can't hold the least share of the template's, that is all; else a banded alignment of the whole template with them gives the matched
share of the template and the span. Templates shorter than a window keep all hashes, so that notices
of a single line are found. The template set is a rule table given by parameter (TEMPLATES if none is); tasks get its index by
broadcast; documents never move.

Of overlapping occurrences that with the most matched tokens counts (of equal ones the shorter template). Rows: doc_id, license, coverage (matched template tokens / template tokens), matched, begin, end (the span in tokens) and
start_char, end_char (in code points), one for each separate occurrence with coverage of LEAST or more.

Nulls and empty texts: no rows. Repeated rows give their rows each. Very long texts are scanned whole; only stretches around
hits are aligned. An empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 3
WINDOW = 4
LEAST = 0.8
#: Insertions and deletions that an alignment may hold, as a share of the template, and at least.
BAND_SHARE, BAND_LEAST = 0.1, 3

WORD = re.compile(r"[a-z0-9]+")

# Public license notices and texts.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License.""",
    "mit-notice": "Released under the MIT License",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE
IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU General Public License for more details.""",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies.""",
    "all-rights-reserved": "All rights reserved",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission.""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "lgpl-2.1-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU Lesser General Public License for more details.""",
    "agpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU Affero General Public License for more details.""",
    "cc0-1.0-notice": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}


def winnowed(tokens: list[str], window: int = WINDOW) -> dict[int, int]:
    """Places and hashes of the fingerprints: of each `window` k-gram hashes the least, the last of equal ones."""
    import xxhash

    hashes = [xxhash.xxh3_64_intdigest(" ".join(tokens[i : i + K])) for i in range(len(tokens) - K + 1)]
    out = {}
    for i in range(max(1, len(hashes) - window + 1)):
        part = hashes[i : i + window]
        if part:
            j = max(range(len(part)), key=lambda x: (-part[x], x))
            out[i + j] = part[j]
    return out


Index = tuple[dict[str, list[str]], dict[int, list[tuple[str, int]]], frozenset[str]]


def index(templates: dict[str, str] = TEMPLATES) -> Index:
    """The templates' tokens, the inverted index, and the words that begin an indexed gram (a cheap test of a document's place)."""
    tokens = {name: WORD.findall(text.lower()) for name, text in templates.items()}
    inverted = defaultdict(list)
    for name, words in tokens.items():
        # A document's window around a short template holds foreign hashes too: all of a short one's are indexed and asked for.
        for place, h in winnowed(words, 1 if len(words) < K + 3 * WINDOW else WINDOW).items():
            inverted[h].append((name, place))
    heads = frozenset(words[p] for name, words in tokens.items() for p in range(len(words) - K + 1))
    return tokens, dict(inverted), heads


def align(template: list[str], tokens: list[str], begin: int, band: int) -> tuple[int, int, int]:
    """Matched tokens and the span (begin, end) in tokens of the best alignment of the whole template, whose first token lies
    within band of begin; a path strays from the diagonal by band at most. Of equal ones the shortest span."""
    width = 2 * band + 1
    worst = (-1, 0, 0, 0)
    # cell k of row i: document tokens up to begin - band + i + k are consumed; (matches, -gaps, first, last) of the best path
    row = [(0, -abs(k - band), -1, -1) for k in range(width)]
    for i, word in enumerate(template):
        new = [worst] * width
        for k in range(width):
            at = begin - band + i + k
            best = worst
            if row[k][0] >= 0:
                m, g, first, last = row[k]
                if 0 <= at < len(tokens) and tokens[at] == word:
                    best = (m + 1, g, at if first < 0 else first, at)
                else:
                    best = (m, g - 1, first, last)  # a substitution
            if k + 1 < width and row[k + 1][0] >= 0:  # a template token is missing from the document
                m, g, first, last = row[k + 1]
                best = max(best, (m, g - 1, first, last))
            if k and new[k - 1][0] >= 0:  # a token of the document is put in
                m, g, first, last = new[k - 1]
                best = max(best, (m, g - 1, first, last))
            new[k] = best
        row = new
    m, _, first, last = max(row)
    return m, first, last + 1


class Around:
    """How many of a template's tokens the document has around a diagonal, whatever their order: no alignment there matches more. The
    diagonals asked for must not fall."""

    def __init__(self, template: list[str], tokens: list[str], band: int):
        self.wanted = Counter(template)
        self.tokens, self.band, self.length = tokens, band, len(template)
        self.held: Counter = Counter()
        self.low = self.high = 0
        self.common = 0

    def at(self, diagonal: int) -> int:
        low, high = max(0, diagonal - self.band), min(len(self.tokens), diagonal + self.length + self.band)
        if low >= self.high:
            self.held.clear()
            self.common, self.low, self.high = 0, low, low
        while self.high < high:
            word = self.tokens[self.high]
            self.held[word] += 1
            self.common += self.held[word] <= self.wanted[word]
            self.high += 1
        while self.low < low:
            word = self.tokens[self.low]
            self.common -= self.held[word] <= self.wanted[word]
            self.held[word] -= 1
            self.low += 1
        return self.common


def scan(text: str, rules: Index, least: float = LEAST) -> list[tuple[str, float, int, int, int, int, int]]:
    """license, coverage, matched, begin, end, start_char, end_char of each occurrence, by place."""
    import xxhash

    templates, inverted, heads = rules
    lower = text.encode().lower().decode()  # A-Z alone, so places stay
    tokens = WORD.findall(lower)
    hits = defaultdict(set)
    for i, word in enumerate(tokens[: len(tokens) - K + 1]):
        if word in heads:
            for name, place in inverted.get(xxhash.xxh3_64_intdigest(" ".join(tokens[i : i + K])), ()):
                hits[name].add(i - place)
    out = []
    for name, diagonals in hits.items():
        template = templates[name]
        band = max(BAND_LEAST, int(len(template) * BAND_SHARE))
        done = -len(template) - 1
        around = Around(template, tokens, band)
        for d in sorted(diagonals):
            if d <= done or around.at(d) < least * len(template):
                continue
            matched, begin, end = align(template, tokens, d, band)
            if matched >= least * len(template):
                out.append((name, matched, begin, end))
                done = max(done, end - len(template) // 2)
    if not out:
        return []
    best: list[tuple[int, int, str, int]] = []  # of overlapping occurrences the longest match counts; by place, without overlaps
    for name, matched, begin, end in sorted(out, key=lambda x: (-x[1], len(templates[x[0]]), x[3] - x[2], x[2], x[0])):
        at = bisect_left(best, (begin, -1, "", 0))
        if (at == len(best) or end <= best[at][0]) and (at == 0 or best[at - 1][1] <= begin):
            best.insert(at, (begin, end, name, matched))
    places = [m.span() for m in WORD.finditer(lower)]
    return sorted(((name, matched / len(templates[name]), matched, begin, end, places[begin][0], places[end - 1][1]) for begin, end, name, matched in best), key=lambda x: (x[3], x[0]))


FOUND = "doc_id bigint, license string, coverage double, matched int, begin int, end int, start_char int, end_char int"


def find_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row for each occurrence of a template (by name, its text) in each row of docs."""
    rules = docs.sparkSession.sparkContext.broadcast(index(templates))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.float64(), *[pa.int32()] * 5]
        for b in batches:
            rows = [(i, *x) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) if t for x in scan(t, rules.value)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], [x.split()[0] for x in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)
