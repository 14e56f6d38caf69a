"""License scans by a positional rare-token index.

The templates (licence texts and exact phrases) are indexed as word -> (template,
position). One pass over the corpus counts in how many documents each template word
occurs, which gives its IDF. The second pass looks up, per document, the words of
highest IDF of each template that could be there, intersects the postings by relative
position (document position minus template position), weighs the template words that
agree on an alignment, and then demands the template's mandatory key phrases inside the
aligned window. Exact phrases are templates whose words must all agree.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import lean

#: Lower-cases A-Z and blanks every other ASCII character that is no digit or letter.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


@dataclass(frozen=True)
class Template:
    """``mandatory``: phrases that must stand inside the aligned window, word by word."""

    label: str
    text: str
    mandatory: tuple[str, ...] = field(default=())


#: Phrases that count wherever their words stand consecutively.
PHRASES = (
    Template("mit", "under the mit license"),
    Template("apache-2", "apache license version 2"),
    Template("cc-by-nc", "cc by nc"),
)
# The public texts of common licences, without their copyright lines.
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions
of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific
prior written permission."""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB_TEXT = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented
as being the original software. 3. This notice may not be removed or altered from any source distribution."""
BOOST_TEXT = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
(the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom
the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this
restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or
derivative works are solely in the form of machine-executable object code generated by a source language processor."""
UNLICENSE_TEXT = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
copyright law."""
APACHE_TEXT = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License
at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_TEXT = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."""
#: Whole licence texts, and short public notices and grants.
TEMPLATES = (
    Template("mit", MIT_TEXT, ("deal in the software without restriction", "the software is provided as is")),
    Template("bsd-2", BSD_GRANT + " " + BSD_END, ("redistributions in binary form must reproduce", "even if advised of the possibility of such damage")),
    Template("bsd-3", BSD_GRANT + " " + BSD_NAMES + " " + BSD_END, ("to endorse or promote products", "even if advised of the possibility of such damage")),
    Template("isc", ISC_TEXT, ("with or without fee is hereby granted", "the author disclaims all warranties")),
    Template("zlib", ZLIB_TEXT, ("must not be misrepresented", "altered source versions")),
    Template("bsl-1", BOOST_TEXT, ("machine executable object code generated by a source language processor",)),
    Template("unlicense", UNLICENSE_TEXT, ("unencumbered software", "in perpetuity")),
    Template("apache-2", APACHE_TEXT, ("apache license", "limitations under the license")),
    Template("gpl", GPL_TEXT, ("gnu general public license", "without any warranty")),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("mit", "Released under the MIT License.", ("mit license",)),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", ("apache license", "in compliance with the license")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ("gnu general public license", "version 2")),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license", "version 3")),
    Template("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu general public license", "version 3")),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered software released into the public domain",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ("waived all copyright",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("attribution sharealike",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc",)),
    Template("proprietary", "All rights reserved. No part of this publication may be reproduced without permission.", ("all rights reserved",)),
)


@dataclass(frozen=True)
class ScanRule:
    """``slack``: words by which an edited text may drift from the template (a sixteenth of
    a long template's words, if that is more);
    ``least``: share of the template's IDF weight that an alignment needs. The postings
    hold a template's rarest words until the others weigh less than that, so every such
    alignment hits one of them."""

    slack: int = 4
    least: float = 0.7


class Index:
    """Postings of the templates' words, and the rarest words that anchor each template."""

    def __init__(self, phrases: tuple[Template, ...], templates: tuple[Template, ...], idf: dict[bytes, float], rule: ScanRule):
        self.rule, self.phrases, self.templates = rule, phrases, templates
        weigh = lambda w: idf.get(w, 0.0)
        self.phrase_words = [words(t.text) for t in phrases]
        # position of a phrase's rarest word -> where each phrase starts from it
        self.starts: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, ws in enumerate(self.phrase_words):
            at = max(range(len(ws)), key=lambda i: (weigh(ws[i]), -i))
            self.starts[ws[at]].append((k, at))
        self.words = [words(t.text) for t in templates]
        self.keys = [[words(p) for p in t.mandatory] for t in templates]
        self.weight = [[weigh(w) for w in ws] for ws in self.words]
        self.total = [sum(x) or 1.0 for x in self.weight]
        self.slack = [max(rule.slack, len(ws) // 16) for ws in self.words]
        # rare word -> (template, position); an alignment of least weight must hit some of them, of weight ``need``
        self.rare: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.need: list[float] = []
        for k, ws in enumerate(self.words):
            order = sorted(set(ws), key=lambda w: (-weigh(w), w))
            covered = 0.0
            for w in order:
                places = [i for i, x in enumerate(ws) if x == w]
                if self.total[k] - covered < rule.least * self.total[k]:
                    break
                covered += sum(self.weight[k][i] for i in places)
                self.rare[w] += [(k, i) for i in places]
            self.need.append(rule.least * self.total[k] - (self.total[k] - covered) - 1e-9)
        self.anchors = frozenset(self.starts) | frozenset(self.rare)

    def base(self, ws: list[bytes], where: dict[bytes, list[int]]) -> list[tuple[int, int]]:
        """(start, phrase) of each place where a phrase's words stand consecutively."""
        found = []
        for w, places in where.items():
            for k, at in self.starts.get(w, ()):
                phrase = self.phrase_words[k]
                found += [(i - at, k) for i in places if i >= at and ws[i - at : i - at + len(phrase)] == phrase]
        return sorted(found)

    def share(self, k: int, start: int, ws: list[bytes]) -> float:
        """Share of template ``k``'s IDF weight that stands within the slack of an alignment at ``start``, if its key phrases are there too, else 0."""
        slack, text = self.slack[k], self.words[k]
        lo = max(0, start - slack)
        window = ws[lo : max(0, start + len(text) + slack)]
        place: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(window):
            place[w].append(lo + i - start)
        found = sum(x for i, (w, x) in enumerate(zip(text, self.weight[k])) if any(abs(p - i) <= slack for p in place.get(w, ()))) / self.total[k]
        return min(1.0, found) if found >= self.rule.least and all(holds(window, p) for p in self.keys[k]) else 0.0

    def aligned(self, ws: list[bytes], where: dict[bytes, list[int]]) -> dict[int, tuple[float, int]]:
        """template -> (its best share at any alignment, the first such start), where one has enough weight and its key phrases."""
        votes: dict[int, Counter[int]] = defaultdict(Counter)
        for w, places in where.items():
            for k, at in self.rare.get(w, ()):
                for i in places:
                    votes[k][i - at] += self.weight[k][at]
        best: dict[int, tuple[float, int]] = {}
        for k, weights in votes.items():
            if sum(weights.values()) < self.need[k]:
                continue
            # The rare words around each start bound what it can reach; few starts get further.
            slack, starts = self.slack[k], sorted(weights)
            edges: Counter[int] = Counter()
            for start in starts:
                edges[start - slack] += weights[start]
                edges[start + slack + 1] -= weights[start]
            near, points = 0.0, sorted(edges)
            for begin, end in zip(points, points[1:]):
                near += edges[begin]
                if near < self.need[k]:
                    continue
                for start in range(begin, end):
                    share = self.share(k, start, ws)
                    if share > best.get(k, (0.0, 0))[0] + 1e-12:
                        best[k] = (share, start)
        return {k: (share, max(0, start)) for k, (share, start) in best.items()}


def holds(window: list[bytes], phrase: list[bytes]) -> bool:
    n = len(phrase)
    return any(window[i : i + n] == phrase for i in range(len(window) - n + 1) if window[i] == phrase[0])


SCANNED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("method_start", T.LongType()),
])
COUNTED = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])


def word_weights(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, float]:
    """IDF of each word of ``vocabulary`` over all documents; what comes back is one row per word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(vocabulary.intersection(words(text)))
                found[b""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=COUNTED.names)

    counts = {bytes(r.word): r.n for r in docs.select("text").mapInArrow(lean(count), COUNTED).groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n = counts.get(b"", 0)
    return {w: math.log((n + 1) / (counts.get(w, 0) + 1)) + 1e-9 for w in sorted(vocabulary)}


def scan(docs: DataFrame, phrases: tuple[Template, ...] = PHRASES, templates: tuple[Template, ...] = TEMPLATES, rule: ScanRule = ScanRule()) -> DataFrame:
    """One row per document: its phrases' places, all labels and a score.

    ``n_base`` counts all places of all phrases; ``first_word`` and ``last_word`` are
    their smallest and largest start (null without a place). ``labels`` joins the labels
    of the phrases and of the templates that align; ``score`` is 1 with a phrase, else
    the best aligned share, else 0. A null text is empty and gives zeros and empty
    labels. Repeated rows are scanned each, a null ``doc_id`` stays null, other columns
    are ignored, an empty table gives no rows.
    """
    vocabulary = {w for t in (*phrases, *templates) for w in words(t.text)}
    idf = word_weights(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(phrases, templates, idf, rule)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for text in batch.column(1).to_pylist():
                ws = words(text)
                n, first, last, base_labels, labels, score, start = 0, None, None, "", "", 0.0, None
                hit = index.anchors.intersection(ws)
                if hit:
                    where: dict[bytes, list[int]] = {w: [] for w in sorted(hit)}
                    for i, w in enumerate(ws):
                        if w in hit:
                            where[w].append(i)
                    base, best = index.base(ws, where), index.aligned(ws, where)
                    names = {phrases[k].label for _, k in base}
                    base_labels = ",".join(sorted(names))
                    labels = ",".join(sorted(names | {templates[k].label for k in best}))
                    score = 1.0 if base else max((s for s, _ in best.values()), default=0.0)
                    start = min((i for _, i in best.values()), default=None)
                    if base:
                        n, first, last = len(base), base[0][0], base[-1][0]
                for column, x in zip(out, (len(ws), n, first, last, base_labels, labels, score, start)):
                    column.append(x)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, types))], names=SCANNED.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), SCANNED)
