"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures them.

Words are runs of ASCII letters and digits, in lower case, and of any bytes beyond ASCII. Of each template, the hashes of
all GRAM consecutive words are winnowed: the least of each WINNOW consecutive hashes is kept. They form an inverted index
(hash -> template, place). A document's hashes, all of them, are looked up; each hit gives a place of the text at which
the template would begin. Hits that are close to one another form one candidate, and the template is aligned with that
part of the text within a band around its hits. A match that has COVERAGE of the template's words is reported with the
text span from its first to its last matched word, and the words before and after it are aligned again until none is
left; of overlapping matches the one with most matched words stays. Where a place of the template comes again among the
hits of a candidate, as in repeated short notices, each part up to there is a candidate of its own besides. A template
of more than LONG words, such as a whole license, repeats phrases within itself; its hits are gathered by diagonal, and
those of one strip of diagonals are a candidate if they are a SHARE of its fingerprints.

Any passage that shares GRAM + WINNOW - 1 consecutive words with a shorter template is a candidate. The index is as large
as the templates, whatever the corpus. Texts are hashed window by window, so that memory doesn't follow their length.

Defined results: a null or empty text has no match; offsets count code points, from 0, the end excluded; ties go to the
larger coverage, then to the template that comes first by name. Rows that repeat, and null ids, get rows of their own. An
empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from bisect import bisect, insort
from functools import cache
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

GRAM, WINNOW = 3, 3
COVERAGE = 0.8
#: Words by which an alignment may leave the diagonals of its hits, and by which hits of one candidate may lie apart.
BAND = 16
#: Bytes of a text in which matches are looked for at once; neighbours overlap by more than the longest template.
PIECE, OVERLAP = 4 << 20, 128 << 10
MATCH, GAP = 4, 1
#: Words of a long template, width of its strips of diagonals, and the share of its fingerprints that a strip must hold.
LONG, STRIP, SHARE = 400, 128, 0.1

# Public license notices, by SPDX name and form.
TEMPLATES = {
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause/text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    "BSD-3-Clause/line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-3-Clause/text": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0/line": "Licensed under CC BY 4.0.",
    "CC-BY-4.0/work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0/work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0/line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0/work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0/line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0/line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0/notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0/line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT/line": "Released under the MIT License.",
    "MIT/text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Proprietary/bare": "All rights reserved.",
    "Proprietary/line": "All rights reserved. No part of this publication may be reproduced without prior written permission.",
    "Unlicense/text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

#: Whole licenses, as published, by SPDX name.
_WHOLE = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}
TEMPLATES |= {f"{name}/whole": (Path(__file__).parent / "license_texts" / f"{file}.txt").read_text(encoding="utf-8") for name, file in _WHOLE.items()}

_BETWEEN = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a text in UTF-8."""
    buf = _LOWER[np.frombuffer(raw, np.uint8)]
    starts, ends = C.word_bounds(buf, _BETWEEN)
    return starts, ends, C.word_hashes(buf, starts, ends)


def grams(word: np.ndarray) -> np.ndarray:
    n = len(word) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(GRAM):
            h = h * np.uint64(0xD6E8FEB86659FD93) + word[j : j + n]
    return C.mix64(h)


def winnowed(h: np.ndarray) -> np.ndarray:
    """Places of the least of each WINNOW consecutive hashes, the rightmost of equals."""
    if len(h) <= WINNOW:
        return np.flatnonzero(h == h.min())[-1:] if len(h) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h, WINNOW)
    return np.unique(np.arange(len(views)) + WINNOW - 1 - views[:, ::-1].argmin(1))


class Index:
    """Inverted index of winnowed template fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [words(templates[n].encode())[2] for n in self.names]
        rows = []
        for t, w in enumerate(self.words):
            g = grams(w)
            if not len(g):
                raise ValueError(f"a template needs {GRAM} words at least: {self.names[t]}")
            rows += [(int(g[p]), t, p) for p in winnowed(g).tolist()]
        rows.sort()
        self.hash = np.array([r[0] for r in rows], np.uint64)
        self.template, self.place = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        self.prints = np.bincount(self.template, minlength=len(self.names))
        self.seen = np.zeros(1 << 18, bool)
        self.seen[(self.hash % np.uint64(len(self.seen))).astype(np.int64)] = True

    def hits(self, g: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, place in it, place in the text) of each gram that the index holds."""
        at = np.flatnonzero(self.seen[(g & np.uint64(len(self.seen) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hash, g[at], "left"), np.searchsorted(self.hash, g[at], "right")
        out = []
        for q, a, b in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
            out += [(int(self.template[i]), int(self.place[i]), q) for i in range(a, b)]
        return out


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """Matched places (template, text) of the best alignment whose diagonals, text place minus template place, lie from
    low to high. A match counts MATCH, each skipped word between matches costs GAP; ends of either side are free."""
    n, width = len(template), high - low + 1
    none = -(1 << 20)
    score = np.full((n + 1, width), none, np.int64)
    step = np.zeros((n + 1, width), np.int8)  # 0 start, 1 match, 2 template word skipped, 3 text word skipped
    score[0] = 0
    offsets = np.arange(width) * GAP
    for i in range(1, n + 1):
        j = i - 1 + low + np.arange(width)
        inside = (j >= 0) & (j < len(text))
        equal = inside & (text[np.clip(j, 0, max(0, len(text) - 1))] == template[i - 1]) if len(text) else inside
        match = np.where(equal, np.maximum(score[i - 1], 0) + MATCH, none)
        skip = np.append(score[i - 1][1:], none) - GAP
        best = np.maximum(np.maximum(match, skip), 0)
        run = np.maximum.accumulate(best + offsets) - offsets
        score[i] = run
        step[i] = np.where(run > best, 3, np.where(best == match, 1, np.where((best == skip) & (best > 0), 2, 0)))
    i, k = np.unravel_index(int(score.argmax()), score.shape)
    i, k, out = int(i), int(k), []
    while i > 0 and step[i, k]:
        if step[i, k] == 1:
            out.append((i - 1, i - 1 + low + k))
            if score[i - 1, k] <= 0:
                break
            i -= 1
        elif step[i, k] == 2:
            i, k = i - 1, k + 1
        else:
            k -= 1
    return out[::-1]


def _strips(found: list[tuple[int, int]], size: int, least: float):
    """Hits (place in the text, diagonal) of a long template, by strips of diagonals that overlap by half, and within a
    strip by stretches of the text; only those that are enough."""
    strips: dict[int, list] = {}
    for x in found if len(found) >= least else ():
        for k in (x[1] // (STRIP // 2), x[1] // (STRIP // 2) + 1):
            strips.setdefault(k, []).append(x)
    for strip in strips.values():
        held: list = []
        for x in sorted(strip):
            if held and x[0] - held[-1][0] > size:
                if len(held) >= least:
                    yield held
                held = []
            held.append(x)
        if len(held) >= least:
            yield held


def _candidates(hits: list[tuple[int, int, int]], sizes: list[int], prints: np.ndarray):
    """(template, hits of it that lie near one another)."""
    group: dict[int, list] = {}
    for t, p, q in hits:
        group.setdefault(t, []).append((q, q - p))
    for t, found in group.items():
        if sizes[t] > LONG:
            yield from ((t, held) for held in _strips(found, sizes[t], SHARE * prints[t]))
            continue
        found.sort()
        held = [found[0]]
        for x in found[1:]:
            if x[0] - held[-1][0] > sizes[t] + BAND or abs(x[1] - held[-1][1]) > BAND:
                yield t, held
                held = []
            held.append(x)
        yield t, held


def _parts(held: list[tuple[int, int]]):
    """A candidate, and its parts, each without a template place twice."""
    yield held
    part: list = []
    seen: set = set()
    for q, d in held:
        if q - d in seen:
            yield part
            part, seen = [], set()
        part.append((q, d))
        seen.add(q - d)
    if len(part) < len(held):
        yield part


def _matches(template: np.ndarray, word: np.ndarray, low: int, high: int, coverage: float):
    """(matched words, first and last place in the text) of alignments that reach the coverage and don't overlap."""
    todo = [(max(0, low), min(len(word), high + len(template)))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < coverage * len(template):
            continue
        got = align(template, word[lo:hi], low - lo, high - lo)
        if got and len(got) >= coverage * len(template):
            first, last = lo + got[0][1], lo + got[-1][1]
            yield len(got), first, last
            todo += [(lo, first), (last + 1, hi)]


def scan(raw: bytes, index: Index, coverage: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, matched words, first byte, end byte) of the matches in a text."""
    sizes = [len(w) for w in index.words]
    found = set()
    for at in range(0, max(1, len(raw)), PIECE):
        a, b = max(0, at - OVERLAP), min(len(raw), at + PIECE + OVERLAP)
        while 0 < a and not _BETWEEN[raw[a - 1]]:
            a -= 1
        while b < len(raw) and not _BETWEEN[raw[b]]:
            b += 1
        starts, ends, word = words(raw[a:b])
        hits = index.hits(grams(word))
        tried = set()
        for t, held in _candidates(hits, sizes, index.prints) if hits else ():
            whole = True
            for part in _parts(held) if sizes[t] <= LONG else [held]:
                low, high = min(d for _, d in part) - BAND, max(d for _, d in part) + BAND
                # a whole that has parts may be long; these find what is beside its best match
                got = _matches(index.words[t], word, low, high, coverage) if (t, low, high) not in tried else ()
                tried.add((t, low, high))
                for n, first, last in got:
                    found.add((index.names[t], n / sizes[t], n, int(a + starts[first]), int(a + ends[last])))
                    if whole and high - low > 2 * (sizes[t] + 2 * BAND):
                        break
                whole = False
    chosen: list = []
    for x in sorted(found, key=lambda x: (-x[2], -x[1], x[0], x[3])):
        at = bisect(chosen, x[3], key=lambda y: y[3])
        if (at == 0 or chosen[at - 1][4] <= x[3]) and (at == len(chosen) or x[4] <= chosen[at][3]):
            insort(chosen, x, key=lambda y: y[3])
    return chosen


@cache
def _index(templates: tuple) -> Index:
    return Index(dict(templates))


def code_points(raw: bytes, places: list[int]) -> list[int]:
    """Code points before each byte place."""
    begins = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return [int(begins[p - 1]) if p else 0 for p in places]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, template, coverage, matched_words, start, end): one row for each match in docs (doc_id, text).
    Template names are license/form."""
    key = tuple(sorted((templates or TEMPLATES).items()))
    C.bounded(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        index = _index(key)
        C.worker_for("licenses", lambda: None)
        for whole in batches:
            for batch in C.slices(whole):
                rows = []
                for doc, raw in zip(batch["doc_id"].to_pylist(), C.text_bytes(batch["text"]), strict=True):
                    if got := scan(raw, index, coverage):
                        places = code_points(raw, [p for g in got for p in g[3:]])
                        rows += [(doc, g[0].partition("/")[0], g[0], g[1], g[2], places[2 * i], places[2 * i + 1]) for i, g in enumerate(got)]
                kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["doc_id", "license", "template", "coverage", "matched_words", "start", "end"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license string, template string, coverage double, matched_words int, start long, end long")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
