"""License scan: known license texts in documents, with matched coverage and spans.

Templates are cut into lower-cased words. Their 3-word grams are winnowed: of every
WINDOW + 1 consecutive grams the one with the least hash is a fingerprint, so every run of
WINDOW + GRAM words in common with a template holds one. A template so short that
COVERAGE does not force such a run has all its grams as fingerprints, and shorter grams
where no run of three is forced. An inverted index maps fingerprints to places in
templates. A document's grams are looked up in it, and from each hit on the template is
aligned with the text in a band that is as wide as the hits nearby are spread, up to the
template's own length, and BAND words more on either side: matching words gain, differing,
missing and added words lose, so words put in between two parts are bridged while the
smaller part gains more than they lose. A candidate that matches COVERAGE or more of the
template's words is reported with its span in the text; of overlapping spans the one with
most words stays.

Templates are a parameter; the index is sent to every executor, and templates of more than
MAX_TEMPLATE_CHARS in all are refused. Documents are scanned in the task that reads them,
whole and without a shuffle.

Defined cases: null and empty texts have no spans; a license that occurs several times in
a text gives a row each time; equal rows give equal rows, once each; templates without
words are ignored and such with fewer than 3 words are matched as a whole; an empty table
gives no rows; columns of the input other than the two named are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

GRAM, WINDOW = 3, 1
BAND_SHARE, BAND = 4, 12
COVERAGE = 0.8
MAX_TEMPLATE_CHARS = 20_000_000
MATCH, MISS = 2, -1
WORD = re.compile(r"\w+")

# The wording of public licenses and of common notices of them.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    "MIT-notice": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


class Index:
    """Templates as word numbers, and their fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.vocabulary: dict[str, int] = {}
        self.names, self.words = [], []
        for name, text in sorted(templates.items()):
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in WORD.findall(text.lower())]
            if words:
                self.names.append(name)
                self.words.append(np.array(words, np.int64))
        self.places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for t, words in enumerate(map(np.ndarray.tolist, self.words)):
            run = forced_run(len(words))
            k = min(GRAM, run)
            grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
            hashes = [xxhash.xxh64_intdigest(np.array(g, np.int64).tobytes()) for g in grams]
            for i in winnowed(hashes) if run >= GRAM + WINDOW else range(len(grams)):
                self.places.setdefault(grams[i], []).append((t, i))
        self.lengths = sorted({len(g) for g in self.places})
        self.keys = {k: np.sort(np.array([self.key(g) for g in self.places if len(g) == k], np.int64)) for k in self.lengths}

    def key(self, gram) -> int:
        n, key = len(self.vocabulary) + 1, 0
        for w in gram:
            key = (key * n + w) % (1 << 62)
        return key

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, its word, the document's word) of every fingerprint found."""
        out = []
        n = len(self.vocabulary) + 1
        for k in self.lengths:
            if len(ids) < k:
                continue
            key, known = np.zeros(len(ids) - k + 1, np.int64), np.ones(len(ids) - k + 1, bool)
            for i in range(k):
                part = ids[i : len(ids) - k + 1 + i]
                known &= part > 0
                key = (key * n + part) % (1 << 62)
            at = np.flatnonzero(known)
            at = at[np.isin(key[at], self.keys[k])]
            out += [(t, i, p) for p in at.tolist() for t, i in self.places.get(tuple(ids[p : p + k].tolist()), ())]
        return out


def winnowed(hashes: list[int]) -> list[int]:
    """Places that are least (the last of equals) in some window; a shorter list has its least."""
    width = min(WINDOW + 1, len(hashes))
    return sorted({min(range(i, i + width), key=lambda x: (hashes[x], -x)) for i in range(len(hashes) - width + 1)})


def forced_run(n: int) -> int:
    """The longest run of words that any text keeps which matches COVERAGE of n words, nothing put in between."""
    missing = int(n * (1 - COVERAGE) + 1e-9)
    return -(-(n - missing) // (missing + 1))


_SCORE, _MATCH, _FIRST = 1 << 42, 1 << 21, (1 << 21) - 1


def aligned(template: np.ndarray, ids: np.ndarray, start: int, low: int, high: int) -> tuple[int, int, int]:
    """Local alignment between the diagonals start + low and start + high: (matches, first word, word after the last).

    A cell is one whole number of its score, its matches and, the earlier the greater, its
    first word; a row is worked out at once, its gaps by a running maximum.
    """
    width = high - low + 1
    offset = np.arange(width)
    slide = offset * _SCORE
    origin = start + low
    best, end = 0, start
    above = _FIRST - offset
    for i, word in enumerate(template.tolist()):
        j = origin + i + offset
        inside = (j >= 0) & (j < len(ids))
        equal = inside & (ids[np.clip(j, 0, len(ids) - 1)] == word)
        nothing = _FIRST - (j + 1 - origin)
        cell = above + np.where(equal, MATCH * _SCORE + _MATCH, MISS * _SCORE)
        cell[:-1] = np.maximum(cell[:-1], above[1:] + MISS * _SCORE)
        cell = np.where(inside & (cell >= _SCORE), cell, nothing)
        row = np.maximum.accumulate(cell + slide) - slide
        above = np.where(inside & (row >= _SCORE), row, nothing)
        ended = np.where(equal, above, 0)
        at = int(np.argmax(ended))
        if ended[at] > best:
            best, end = int(ended[at]), int(j[at]) + 1
    return (best >> 21) & _FIRST, origin + _FIRST - (best & _FIRST) if best else start, end


def occurrences(template: np.ndarray, ids: np.ndarray, hits: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(matches, first word, word after the last) of a template, from hits (its word, the text's word) in text order."""
    n = len(template)
    # A part too short for a hit gains no more than bridging so many words loses.
    edge = max(2 * GRAM, min(BAND, n // BAND_SHARE))
    own, place = (np.array(x) for x in zip(*hits, strict=True))
    diagonal = place - own
    wanted = np.bincount(template)
    left = np.ones(len(hits), bool)
    free = ids.copy()  # without the words of what has been found
    found = []
    for k in range(len(hits)):
        start = int(diagonal[k])
        reach = int(np.searchsorted(place, place[k] + 2 * n, side="right"))
        apart = diagonal[k:reach] - start
        while left[k]:
            near = apart[left[k:reach] & (abs(apart) <= n)]
            low, high = int(near.min()) - edge, int(near.max()) + edge
            words = free[max(0, start + low) : start + high + n]
            # No alignment matches more than the words that both have.
            common = np.minimum(np.bincount(words[(words > 0) & (words < len(wanted))], minlength=len(wanted)), wanted).sum()
            matches, a, b = aligned(template, free, start, low, high) if common >= COVERAGE * n else (0, 0, 0)
            if matches / n >= COVERAGE:
                # Another place nearby may be the better one; then this hit is looked at again without it.
                found.append((matches, a, b))
                free[a:b] = -1
                left[np.searchsorted(place, a) : np.searchsorted(place, b)] = False
            else:
                left[k:reach] &= abs(apart) > edge
                left[k] = False
    return found


def spans(index: Index, text: str) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, matched words, start, end) in characters, in text order."""
    words = list(WORD.finditer(text))
    ids = np.array([index.vocabulary.get(m[0].lower(), 0) for m in words], np.int64)
    hits: dict[int, list[tuple[int, int]]] = {}
    for t, i, p in sorted(index.hits(ids), key=lambda h: (h[2], h[1])):
        hits.setdefault(t, []).append((i, p))
    found = {(*one, t) for t, own in hits.items() for one in occurrences(index.words[t], ids, own)}
    kept: list[tuple[int, int, int, int]] = []
    for one in sorted(found, key=lambda f: (-f[0], f[1], f[2], f[3])):
        if all(one[2] <= k[1] or k[2] <= one[1] for k in kept):
            kept.append(one)
    return [(index.names[t], n / len(index.words[t]), n, words[a].start(), words[b - 1].end()) for n, a, b, t in sorted(kept, key=lambda k: k[1])]


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, template, coverage, matched_words, span_start, span_end) of every license found."""
    if sum(map(len, templates.values())) > MAX_TEMPLATE_CHARS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_CHARS} characters")
    shared = docs.sparkSession.sparkContext.broadcast(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        known = index.vocabulary.get
        for batch in batches:
            rows, source = [], []
            for n, value in enumerate(batch.column(1)):
                body = value.as_py() or ""
                words = WORD.findall(body.lower())
                if index.hits(np.fromiter(map(known, words, repeat(0)), np.int64, len(words))):
                    found = spans(index, body)
                    rows += found
                    source += [n] * len(found)
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *map(pa.array, columns, kinds)], ["doc_id", "template", "coverage", "matched_words", "span_start", "span_end"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, template string, coverage double, matched_words long, span_start long, span_end long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
