"""License scans: winnowed template fingerprints, then banded alignment.

Templates and texts are word sequences (letters and digits, lower-cased). Of a template's
hashed word trigrams, winnowing keeps the least of every ``WINDOW`` in a row, all of them
for templates of at most ``SHORT`` words; templates under 6 words have shorter grams, so
that one survives a changed word. An inverted index leads from a fingerprint to
(template, position). Every trigram of a text is looked up, so a copy of ``GRAM + WINDOW - 1``
words in a row is never missed. Hits of one template on near diagonals make candidate
regions, one for each diagonal, and what a match leaves of a region is searched again. There a banded alignment (matches count 1, mismatches and gaps cost 1/2, free ends in the text)
finds how many template words are matched and where. A match is reported if it
covers ``min_coverage`` of the template; of overlapping matches the one with most matched
words stays, then the one with better coverage, then the name that sorts first.

Defined results: null, empty and wordless texts have no matches; repeated rows are judged
alike; spans are code points with an exclusive end; extra columns are ignored; empty
tables give empty results; templates without words are ignored; a very long text is handled
whole, by itself, in some 40 bytes of memory for each of its own.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c
from .license_texts import TEXTS

GRAM, WINDOW, BAND = 3, 4, 8
#: Templates up to this many words keep all grams: one changed word may leave no run of GRAM + WINDOW - 1 others.
SHORT = 2 * (GRAM + WINDOW - 1)
SCHEMA = "doc_id bigint, n_matches bigint, licenses array<string>, matches array<struct<license:string,coverage:double,start:bigint,end:bigint>>"
_MATCH = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

#: Short licenses as a whole, and notices by which texts name their terms.
TEMPLATES = TEXTS | {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT notice": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL notice": "licensed under the GNU Lesser General Public License",
    "AGPL notice": "licensed under the GNU Affero General Public License",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights",
    "BSD clause": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD notice": "Use of this source code is governed by a BSD-style license",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "All rights reserved": "All rights reserved. No part of this publication may be reproduced",
}


def _words(text: str) -> list[bytes]:
    data = np.frombuffer(text.encode().translate(c.LOWER.tobytes()), np.uint8)
    starts, ends, _ = c.word_spans(data, np.array([0, len(data)]), c.NOT_ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def _word_hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = c.word_spans(data, np.array([0, len(data)]), c.separators((32, 32)))
    return c.span_hash(c.prefix_hash(data), starts, ends)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = c.mix64(out + words[k : k + n])
    return out


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of every window (the last of equal ones); all positions if there is no whole window."""
    if len(hashes) < window + 1:
        return np.arange(len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(1))


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.words, self.size = [], [], []
        entries: list[tuple[int, int, int]] = []
        for name, text in sorted(templates.items()):
            words = _words(text)
            if not words:
                continue
            hashes = _word_hashes(words)
            size = GRAM if len(words) >= 2 * GRAM else max(1, len(words) // 2)
            found = grams(hashes, size)
            self.names.append(name)
            self.words.append(hashes)
            self.size.append(size)
            chosen = winnow(found, WINDOW) if len(words) > SHORT else range(len(found))
            entries += [(int(found[p]), len(self.names) - 1, int(p)) for p in chosen]
        self.tables = {}
        for size in sorted(set(self.size)):
            own = sorted(e for e in entries if self.size[e[1]] == size)
            self.tables[size] = (np.array([e[0] for e in own], np.uint64), np.array([e[1] for e in own]), np.array([e[2] for e in own]))


def align(template: np.ndarray, text: np.ndarray, offset: int, band: int = BAND) -> tuple[int, int, int]:
    """Banded alignment of a template to a text with template word 0 about at ``offset``.

    Returns (matched words, first and last matched text word); ends of the text are free.
    """
    m, width = len(template), 2 * band + 1
    base = offset - band  # cell (i, d) stands for text word base + i + d
    low = -1e9
    score = np.zeros((m + 1, width))
    how = np.zeros((m + 1, width), np.int8)
    for i in range(1, m + 1):
        at = base + i - 1 + np.arange(width)  # the text word that template word i-1 would match
        ok = (at >= 0) & (at < len(text))
        same = np.zeros(width, bool)
        same[ok] = text[at[ok]] == template[i - 1]
        diagonal = score[i - 1] + np.where(same, 1.0, -0.5)
        up = np.concatenate([score[i - 1][1:], [low]]) - 0.5  # template word without a partner
        best = np.maximum(diagonal, up)
        how[i] = np.where(diagonal >= up, np.where(same, 1, 2), 3)
        for d in range(1, width):  # text word without a partner
            if best[d - 1] - 0.5 > best[d]:
                best[d], how[i, d] = best[d - 1] - 0.5, 4
        score[i] = best
    i, d = m, int(score[m].argmax())
    matched, first, last = 0, -1, -1
    while i > 0:
        step = how[i, d]
        if step == 4:
            d -= 1
            continue
        if step == 1:
            at = base + i - 1 + d
            matched, first, last = matched + 1, at, (at if last < 0 else last)
        if step == 3:
            d += 1
        i -= 1
    return matched, first, last


@lru_cache(maxsize=4096)
def _aligned(template: bytes, text: bytes, offset: int) -> tuple[int, int, int]:
    return align(np.frombuffer(template, np.uint64), np.frombuffer(text, np.uint64), offset)


def find(words: np.ndarray, index: Index, hits: list[tuple[int, int, int]], min_coverage: float) -> list[tuple[int, float, int, int]]:
    """Matches (template, coverage, first word, last word) of a text from its fingerprint hits (template, diagonal, position)."""
    found: list[tuple[int, int, int, int]] = []
    hits = sorted(set(hits))
    k = 0
    while k < len(hits):
        t, diagonal, _ = hits[k]
        group = k
        while k < len(hits) and hits[k][0] == t and hits[k][1] - diagonal <= BAND:
            k += 1
        m = len(index.words[t])
        own = [x[1] for x in hits[group:k]]
        # the middle diagonal stands for hits shifted by edits; occurrences close together have diagonals of their own
        for at in dict.fromkeys([own[len(own) // 2], *own]):
            lo, hi = max(0, at - BAND), min(len(words), at + m + BAND)
            todo = [(lo, hi)]
            while todo:  # what an accepted match leaves of the region is aligned again
                a, b = todo.pop()
                if b - a < min_coverage * m:
                    continue
                if np.isin(words[a:b], index.words[t]).sum() < min_coverage * m:  # no alignment matches more words
                    continue
                matched, first, last = _aligned(index.words[t].tobytes(), words[a:b].tobytes(), at - a)
                if matched and matched >= min_coverage * m:
                    found.append((matched, t, a + first, a + last))
                    todo += [(a, a + first), (a + last + 1, b)]
    found = sorted(set(found), key=lambda x: (-x[0], -x[0] / len(index.words[x[1]]), x[1], x[3] - x[2], x[2]))
    kept: list[tuple[int, int, int, int]] = []  # in order of the text, none overlaps another
    for x in found:
        place = bisect.bisect_right(kept, x[3], key=lambda y: y[2])
        if not place or kept[place - 1][3] < x[2]:
            kept.insert(place, x)
    return [(t, matched / len(index.words[t]), a, b) for matched, t, a, b in kept]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: matches, names of the licenses, coverage and span of each match."""
    chosen = tuple(sorted((templates or TEMPLATES).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(dict(chosen))
        for batch in batches:
            for i, j, data, off in c.text_chunks(batch, 1):
                data = np.frombuffer(data.tobytes().translate(c.LOWER.tobytes()), np.uint8)
                starts, ends, first = c.word_spans(data, off, c.NOT_ALNUM)
                words = c.span_hash(c.prefix_hash(data), starts, ends)
                hits: dict[int, list[tuple[int, int, int]]] = {}
                for size, (table, template, place) in index.tables.items():
                    found = grams(words, size)
                    left, right = np.searchsorted(table, found, "left"), np.searchsorted(table, found, "right")
                    for p in np.flatnonzero(right > left).tolist():
                        r = int(np.searchsorted(first, p, "right")) - 1
                        if p + size <= first[r + 1]:
                            for e in range(left[p], right[p]):
                                hits.setdefault(r, []).append((int(template[e]), int(p - first[r] - place[e]), int(p)))
                matches: list[list[dict]] = [[] for _ in range(j - i)]
                for r, own in hits.items():
                    got = find(words[first[r] : first[r + 1]], index, own, min_coverage)
                    if got:
                        before = np.concatenate([[0], np.cumsum((data[off[r] : off[r + 1]] & 0xC0) != 0x80)])
                        for t, coverage, a, b in got:
                            matches[r].append({"license": index.names[t], "coverage": coverage, "start": int(before[starts[first[r] + a] - off[r]]), "end": int(before[ends[first[r] + b] - off[r]])})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array([len(x) for x in matches], pa.int64()), pa.array([sorted({y["license"] for y in x}) for x in matches], pa.list_(pa.string())), pa.array(matches, _MATCH)],
                    names=["doc_id", "n_matches", "licenses", "matches"],
                )

    return c.keyed(docs, id_col, text_col).mapInArrow(run, SCHEMA)
