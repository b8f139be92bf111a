"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from math import ceil
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corposieve.llm._text import Words, slices, words

_SEPARATOR = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])

TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-notice": "Released under the MIT License",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "BSD-3-Clause-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}

#: The full texts beside this module, by their names.
TEMPLATES |= {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Aligned positions: anchors are values unique to both, in the longest increasing run; gaps are aligned alike.

    Equal ends of a gap are aligned first; a gap without an anchor stays unaligned between them.
    """
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
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {b[j]: j for j in range(b0, b1)}
        pairs = [(i, at[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and in_b.get(a[i]) == 1]
        tails: list[int] = []
        last: list[int] = []
        before: list[int] = []
        for k, (_, j) in enumerate(pairs):
            x = bisect_left(tails, j)
            before.append(last[x - 1] if x else -1)
            if x == len(tails):
                tails.append(j)
                last.append(k)
            else:
                tails[x], last[x] = j, k
        anchors, k = [], last[-1] if last else -1
        while k >= 0:
            anchors.append(pairs[k])
            k = before[k]
        if anchors:
            out += anchors
            ends = [(a1, b1), *anchors, (a0 - 1, b0 - 1)]
            todo += [(lo[0] + 1, hi[0], lo[1] + 1, hi[1]) for hi, lo in zip(ends, ends[1:], strict=False)]
    return sorted(out)


#: Templates of so many words at most are aligned at every start and to every end that can be one.
EVERY = 64


class Template:
    """A template and the search for it in a slice of texts."""

    def __init__(self, name: str, hashes: np.ndarray, coverage: float, stretch: float) -> None:
        self.name, self.words, self.stretch = name, hashes, stretch
        self.own, codes, self.counts = np.unique(hashes, return_inverse=True, return_counts=True)
        self.codes = codes.tolist()
        self.need = ceil(coverage * len(hashes) - 1e-9)
        self.reach = ceil(stretch * len(hashes))
        spare = len(hashes) - self.need
        self.heads, self.tails = np.unique(hashes[: spare + 1]), set(self.codes[len(hashes) - spare - 1 :])  # the first and the last aligned word are among these

    def aligned(self, codes: np.ndarray, p: int, q: int) -> tuple[int, int, int] | None:
        """(words aligned, first, last) of the text's words p to q, or None if they don't carry the template."""
        cut = codes[p:q]
        known = cut[cut >= 0]
        if np.minimum(np.bincount(known, minlength=len(self.counts)), self.counts).sum() < self.need:
            return None
        pairs = patience(cut.tolist(), self.codes)
        if len(pairs) < self.need or pairs[-1][0] - pairs[0][0] + 1 > self.stretch * len(pairs):
            return None
        return len(pairs), p + pairs[0][0], p + pairs[-1][0]

    def at(self, codes: np.ndarray, p: int, end: int) -> list[tuple[int, int, int]]:
        """The alignments that start at word ``p``."""
        q = min(end, p + self.reach)
        stops = {q, min(end, p + len(self.words))}
        if len(self.words) <= EVERY:
            stops |= {p + k + 1 for k, c in enumerate(codes[p:q].tolist()) if c in self.tails}
        return [x for stop in sorted(stops) if (x := self.aligned(codes, p, stop))]

    def places(self, w: Words, text: np.ndarray, near: np.ndarray) -> Iterator[tuple[int, tuple[int, int, int]]]:
        """(text, place) of places that carry the template, the most covered first where they overlap; ``near``: words of any template."""
        at = near[np.isin(w.hashes[near], self.own)]
        if len(at) < self.need:
            return
        a, b = at[: len(at) - self.need + 1], at[self.need - 1 :]
        starts = a[(b - a < self.stretch * len(self.words)) & (text[a] == text[b])]
        starts = starts[np.isin(w.hashes[starts], self.heads)]
        if not len(starts):
            return
        codes = np.full(len(w.hashes), -1, np.int64)
        codes[at] = np.searchsorted(self.own, w.hashes[at])
        long, past, later, hits = len(self.words) > EVERY, -1, -1, []
        for p in starts.tolist():
            if long and (p <= past or (p < later and codes[p + 1 : p + 2].tolist() != self.codes[1:2])):
                continue
            found = self.at(codes, p, int(w.first[text[p] + 1]))
            hits += found
            later = p + len(self.words) // 32
            past = max((x[2] for x in found), default=past)
        taken: list[tuple[int, int, int]] = []  # in order of their places
        for x in sorted(hits, key=lambda x: (-x[0], x[2] - x[1], x[1])):
            k = bisect_left(taken, (x[1], x[2]), key=lambda y: y[1:])
            if (k == 0 or taken[k - 1][2] < x[1]) and (k == len(taken) or x[2] < taken[k][1]):
                taken.insert(k, x)
        for x in taken:
            yield int(text[x[1]]), x


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, stretch: float = 1.5) -> DataFrame:
    """``doc_id, license, coverage, first_word, last_word, licenses, places``: one row per input row.

    A text carries a template if at least ``coverage`` of the template's words are aligned with words of the text
    that span at most ``stretch`` times as many words as are aligned. license is the one most covered (ties: more
    words, then its name), with its place in words counted from 0; licenses has all, by name; places has every place of each, from
    the left, places of one template don't overlap. Words are runs of ASCII letters and digits or other letters, A-Z folded.

    Search: an alignment starts at a word of the template's first words from which on enough of the template's words
    come within its stretch. A template of up to EVERY words is aligned at each such start, up to each word that can be
    its last; a longer one at starts a 32nd of its length apart and wherever its first two words stand, up to the
    stretch and over as many words as it has. So a second copy behind takes no anchor away.

    Null or empty text, or one without a license: nulls and empty lists. Repeated rows get equal results; no
    rows in, none out. Other columns are neither read nor returned.
    """
    given = templates or TEMPLATES
    coded = [(k, words(pa.array([given[k]]), space=_SEPARATOR).hashes) for k in sorted(given)]
    tests = [Template(k, h, coverage, stretch) for k, h in coded if len(h)]
    every = np.unique(np.concatenate([t.own for t in tests])) if tests else np.zeros(0, np.uint64)
    place = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = words(part.column(1), space=_SEPARATOR)
                text = np.repeat(np.arange(part.num_rows), w.count)
                found: dict[int, list[tuple]] = {}
                near = np.flatnonzero(np.isin(w.hashes, every))
                for t in tests:
                    for row, (n, p, q) in t.places(w, text, near):
                        low = int(w.first[row])
                        found.setdefault(row, []).append((t.name, n / len(t.words), n, p - low, q - low))
                rows: list[tuple] = []
                for row in range(part.num_rows):
                    own = found.get(row, [])
                    k = min(own, key=lambda x: (-x[1], -x[2], x[0], x[3]), default=(None,) * 5)
                    rows.append((k[0], k[1], k[3], k[4], sorted({x[0] for x in own}), [dict(zip(("license", "coverage", "first_word", "last_word"), (x[0], x[1], x[3], x[4]), strict=True)) for x in sorted(own, key=lambda x: (x[3], x[0]))]))
                kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(place)]
                cols = zip(*rows, strict=True) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "license", "coverage", "first_word", "last_word", "licenses", "places"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(scan, "doc_id long, license string, coverage double, first_word long, last_word long, licenses array<string>, places array<struct<license:string,coverage:double,first_word:long,last_word:long>>")
