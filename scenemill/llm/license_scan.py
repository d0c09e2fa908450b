"""License scans by patience alignment.

A template and a stretch of text are aligned on the words that occur exactly once in each: the longest
increasing subsequence of these pairs is kept, and the gaps between its members are aligned the same way
until no word is unique on both sides (equal words at the edges of a gap are taken as they come). The share
of a template's words that find a partner is its coverage.

A template can only stand where its key words do, the words that tell it from the other templates and occur
once in it. Around each of them the stretch is aligned in which the template could lie, so a text that holds
a notice twice, or thousands of words besides, is scanned whole and its notices are found one by one.

Coverage alone does not tell licenses apart. The words of a template that name its license (``TELLING``) must
all be aligned, with no such word of another license put in before them; a notice that lacks one is reported
as ``UNKNOWN``, and only where no license that can be told covers the place.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenemill.llm.common import bounded_batches

COVERAGE = 0.8

#: Key words looked for, per template.
KEYS = 3

#: A stretch has a quarter of spare words, and templates above this length as many as they are longer: that much may be put into a notice.
SHORT = 30

#: The license of a notice whose wording is known but not the license it names.
UNKNOWN = "unknown"

#: The words that tell each license from its neighbours.
TELLING = {
    "MIT": "mit",
    "BSD": "bsd",
    "Apache-1.1": "apache 1.1",
    "Apache-2.0": "apache 2.0",
    "GPL-2.0": "gnu general gpl 2 2.0",
    "GPL-3.0": "gnu general gpl 3 3.0",
    "LGPL-3.0": "gnu lesser lgpl 3 3.0",
    "AGPL-3.0": "gnu affero agpl 3 3.0",
    "CC-BY-4.0": "by attribution 4.0",
    "CC-BY-SA-4.0": "by sa attribution sharealike 4.0",
    "CC-BY-ND-4.0": "by nd attribution noderivatives 4.0",
    "CC-BY-NC-4.0": "by nc attribution noncommercial 4.0",
    "CC-BY-NC-SA-4.0": "by nc sa attribution noncommercial sharealike 4.0",
    "CC-BY-NC-ND-4.0": "by nc nd attribution noncommercial noderivatives 4.0",
}

# Wording of public licenses and of notices that name them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("BSD", "Released under the BSD License."),
    ("BSD", "Licensed under the BSD License."),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("Apache-1.1", "SPDX-License-Identifier: Apache-1.1"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
)

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_NAMING = {w for words in TELLING.values() for w in words.split()}
_NUMBER = re.compile(r"v?[0-9]+(?:\.[0-9]+)*")


def words_of(text: str) -> tuple[list[str], list[int], list[int]]:
    """The lower-cased words of a text, with where each starts and ends."""
    found = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
    return tuple(map(list, zip(*found))) if found else ([], [], [])


def _longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions of two word lists, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once = {w for w, n in Counter(a[a0:a1]).items() if n == 1}
        in_b = Counter(w for w in b[b0:b1] if w in once)
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b.get(w) == 1}
        pairs = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if w in where]
        anchors = [pairs[k] for k in _longest_increasing([j for _, j in pairs])]
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:])]
    return sorted(out)


@dataclass(frozen=True)
class Found:
    license: str
    coverage: float
    matched: int
    start: int
    end: int


class Scanner:
    """Templates prepared for scanning."""

    def __init__(self, templates: tuple[tuple[str, str], ...], least: float):
        self.least = least
        self.names = [name for name, _ in templates]
        self.words = [words_of(text)[0] for _, text in templates]
        self.counted = [Counter(words) for words in self.words]
        self.needed = [least * len(words) - 1e-9 for words in self.words]
        # Where each template's telling words first stand.
        self.telling = [
            [words.index(w) for w in TELLING.get(name, "").split() if w in words] for name, words in zip(self.names, self.words)
        ]
        spread = Counter(w for words in self.words for w in set(words))
        self.keys: dict[str, list[tuple[int, int]]] = {}
        for k, words in enumerate(self.words):
            once = [w for w, n in Counter(words).items() if n == 1] or words
            # A match may lack some words, so one key alone is not relied on.
            lack = int((1 - least) * len(words) + 1e-9)
            for w in sorted(once, key=lambda w: (spread[w], -len(w), w))[: max(KEYS, lack + 1)]:
                self.keys.setdefault(w, []).append((k, words.index(w)))

    def _told(self, k: int, pairs: list[tuple[int, int]], words: list[str]) -> bool:
        """Whether the telling words of template ``k`` are aligned, none of another license put in before them."""
        at, taken = dict(pairs), {j for _, j in pairs}
        for i in self.telling[k]:
            j = at.get(i)
            if j is None:
                return False
            if j and j - 1 not in taken and (words[j - 1] in _NAMING or _NUMBER.fullmatch(words[j - 1])) and i:
                return False
        return True

    def scan(self, text: str) -> list[Found]:
        """The notices of a text, by start; where stretches overlap, the one with most words matched stays, one that tells its license first."""
        lowered = text.lower()
        if not any(key in lowered for key in self.keys):
            return []
        words, starts, ends = words_of(text)
        # A template of whose words too few are in the text, or in a stretch, cannot be covered there: no alignment has more pairs.
        there = set(words)
        open_ = {k for k, held in enumerate(self.counted) if sum(n for w, n in held.items() if w in there) >= self.needed[k]}
        if not open_:
            return []
        seen: set[tuple[int, int]] = set()
        found: list[Found] = []
        for p, w in enumerate(words):
            for k, i in self.keys.get(w, ()):
                if k not in open_:
                    continue
                template = self.words[k]
                slack = max(2 + len(template) // 4, len(template) - SHORT)
                lo, hi = max(0, p - i - slack), min(len(words), p - i + len(template) + slack)
                # The stretch ends where the same key word stands again: there another copy may begin.
                before = [q for q in range(lo, p) if words[q] == w]
                after = [q for q in range(p + 1, hi) if words[q] == w]
                lo = max(lo, before[-1] + 1) if before else lo
                hi = min(hi, after[0]) if after else hi
                if sum(map(self.counted[k].__contains__, words[lo:hi])) < self.needed[k]:
                    continue
                pairs = patience(template, words[lo:hi])
                coverage = len(pairs) / len(template)
                if coverage >= self.least:
                    first, last = lo + pairs[0][1], lo + pairs[-1][1]
                    if (k, first) not in seen:
                        seen.add((k, first))
                        name = self.names[k] if self._told(k, pairs, words[lo:hi]) else UNKNOWN
                        found.append(Found(name, coverage, len(pairs), starts[first], ends[last]))
        kept: list[Found] = []  # by start; they do not overlap, so only the neighbours of a place are in question
        for f in sorted(found, key=lambda f: (f.license == UNKNOWN, -f.matched, -f.coverage, f.start, f.end, f.license)):
            at = bisect_left(kept, f.start, key=lambda g: g.start)
            if (not at or kept[at - 1].end <= f.start) and (at == len(kept) or f.end <= kept[at].start):
                kept.insert(at, f)
        return kept


@lru_cache(maxsize=4)
def scanner(templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = COVERAGE) -> Scanner:
    return Scanner(templates, least)


_KIND = "array<struct<license: string, coverage: double, matched: int, start: long, end: long>>"
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def notices_column(text: Column, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = COVERAGE) -> Column:
    def notices(texts: pa.Array) -> pa.Array:
        scan = scanner(templates, least)
        return pa.array([[f.__dict__ for f in scan.scan(t.as_py())] if t.is_valid else [] for t in texts], _ARROW)

    notices.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(notices, T.DataType.fromDDL(_KIND))(text)


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = COVERAGE
) -> DataFrame:
    """One row per input row: ``id_col, n_notices, license, coverage, start, end, notices``.

    ``license``, ``coverage`` and the span are those of the notice with the most words matched (then the
    first), of those that tell their license if any does, null where there is none; ``notices`` lists all as license:start:end, by start. Positions are code
    points, ends exclusive. Null texts count as empty; repeated rows give repeated results; extra columns are
    ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), notices_column(F.col(text_col), templates, least).alias("found"))
    order = lambda f: F.struct(f.license == UNKNOWN, -f.matched, f.start, f.license, f.coverage, f.end)
    best = F.array_min(F.transform("found", order))
    joined = F.array_join(F.transform("found", lambda f: F.concat_ws(":", f.license, f.start.cast("string"), f.end.cast("string"))), ",")
    rows = rows.withColumn("best", best)
    return rows.select(
        id_col, F.size("found").cast("long").alias("n_notices"), F.col("best.license").alias("license"), F.col("best.coverage").alias("coverage"),
        F.col("best.start").alias("start"), F.col("best.end").alias("end"), joined.alias("notices"),
    )
