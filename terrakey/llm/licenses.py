"""License scans by conditional compression against license templates."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakey.llm.wordhash import chunks

# Wordings of licenses, by identifier.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0-line": "Licensed under the Mozilla Public License, version 2.0.",
    "BSD-3-Clause-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0-line": "Released into the public domain under CC0 1.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
        "or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# Words of which every finding has at least one; line ends and comment signs may stand within a pair.
ANCHORS = r"(?i)licen[sc]e|copyright|warrant(?:y|ies)|permission|redistribut|public\W+domain|creative\W+commons|unencumbered|\bcc(?:0|\W+by)|merchantability|liability"
_ANCHOR = re.compile(ANCHORS)
_WORD = re.compile(r"[^\W_]+")
# Words that name a license or a variant of one, and how a version is announced.
NAMES = frozenset("affero apache gnu lesser mozilla academic eclipse nc nd sa noncommercial noderivatives sharealike cc cc0".split())
VERSION = frozenset("version v".split())
#: Words after a finding in which another template may go on, and words of it that show that it does.
BEYOND, GOES_ON = 16, 4
#: Least share of a template's words in a finding, and the reduction in size that a finding's template has to exceed.
MIN_SHARE, MIN_GAIN = 0.85, 0.0
#: Words that a template's word outweighs in an alignment; the later ones are for wordings that the first cannot hold together or apart.
WEIGHTS = (4, 16, 2)


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _size(block: bytes, template: bytes | None) -> int:
    if template is None:
        return len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(block))
    return len(_compressor(template).compress(block))


@cache
def _compressor(template: bytes) -> zstandard.ZstdCompressor:
    raw = zstandard.ZstdCompressionDict(template, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False)


@cache
def _lexicon(templates: tuple[tuple[str, str], ...]) -> tuple[dict[str, int], list[tuple[str, np.ndarray, np.ndarray]]]:
    """Numbers of all template words from 1 on, and each template as (name, numbers of its words, counts by number)."""
    split = [(k, [m[0].lower() for m in _WORD.finditer(t)]) for k, t in templates]
    number = {w: i for i, w in enumerate(sorted({w for _, ws in split for w in ws}), 1)}
    ids = [(k, np.array([number[w] for w in ws], np.int64)) for k, ws in split]
    return number, [(k, x, np.bincount(x, minlength=len(number) + 1)) for k, x in ids if x.size]


def candidate_blocks(text: str, words: list[tuple[int, int]], reach: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of ``words``, the spans of a text's words, within ``reach`` words of an anchor. Lines and blank lines make no difference."""
    starts = [a for a, _ in words]
    first = end = None
    for m in _ANCHOR.finditer(text):
        a, b = bisect_right(starts, m.start()) - 1 - reach, bisect_left(starts, m.end()) + reach
        if first is not None and a > end:
            yield first, end
            first = None
        first = max(a, 0) if first is None else first
        end = min(b, len(words))
    if first is not None:
        yield first, end


def _aligned(block: np.ndarray, template: np.ndarray, weight: int) -> tuple[int, int, int]:
    """(first, end, words found) of the part of ``block`` that best holds the template's words in order.

    A word found counts ``weight``, a word put in costs one, template words left out are free. Of equal parts the earliest
    end and the latest first stay. A cell holds score and first in one number.
    """
    row = np.zeros(template.size + 1, np.int64)
    best = first = end = 0
    for i, w in enumerate(block.tolist()):
        new = np.maximum(row - (1 << 32), i + 1)
        if w:
            np.maximum(new[1:], np.where(template == w, row[:-1] + (weight << 32), 0), out=new[1:])
            np.maximum.accumulate(new, out=new)
        row = new
        top = int(row[-1])
        if top >> 32 > best:
            best, first, end = top >> 32, top & 0xFFFFFFFF, i + 1
    return first, end, (best + end - first) // (weight + 1)


def _wording(block: np.ndarray, template: np.ndarray) -> tuple[int, int, int] | None:
    """The best part of ``block`` with MIN_SHARE of the template's words and at most twice as many words, if there is one."""
    for weight in WEIGHTS:
        first, end, found = _aligned(block, template, weight)
        if found >= MIN_SHARE * template.size and end - first <= 2 * template.size:
            return first, end, found
    return None


def _regions(block: np.ndarray, counts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Parts of ``block`` outside which no part of twice the template's length has MIN_SHARE of its words, in whatever order."""
    need = MIN_SHARE * n
    if np.minimum(np.bincount(block, minlength=counts.size), counts).sum() < need:
        return
    width = min(2 * n, block.size)
    have = np.zeros(block.size - width + 1, np.int64)
    for w in np.flatnonzero(counts):
        at = np.concatenate([[0], np.cumsum(block == w)])
        have += np.minimum(at[width:] - at[: at.size - width], counts[w])
    good = np.flatnonzero(have >= need)
    if good.size:
        for part in np.split(good, np.flatnonzero(np.diff(good) > width) + 1):
            yield int(part[0]), int(part[-1]) + width


def _wordings(block: np.ndarray, template: np.ndarray, counts: np.ndarray, saved: Callable[[int, int], tuple[int, float]]) -> Iterator[tuple[int, int, int]]:
    """All wordings of one template in ``block``, apart from each other: (first, end, words found).

    Only pieces whose compressed size the template reduces are aligned; ``saved`` gives the reduction of the words between two places.
    """
    n = template.size
    todo = list(_regions(block, counts, n))
    while todo:
        at, stop = todo.pop()
        while stop - at >= MIN_SHARE * n:
            # Every part of 2 n words lies within one of these pieces.
            end = min(at + 4 * n, stop)
            found = _wording(block[at:end], template) if saved(at, end)[1] > MIN_GAIN else None
            if found is None:
                at = at + 2 * n if end < stop else stop
                continue
            a, b, k = at + found[0], at + found[1], found[2]
            if k < n and end < stop:
                # The piece's end may have cut it.
                again = _wording(block[a : a + 4 * n][: stop - a], template)
                if again is not None and again[2] > k:
                    a, b, k = a + again[0], a + again[1], again[2]
            yield a, b, k
            if a - at >= MIN_SHARE * n:
                todo.append((at, a))
            at = b


def differences(block: list[str], template: list[str]) -> list[str]:
    """The exact differences in wording: template words left out or changed, and words put in."""
    edits = []
    for op, a, b, c, d in SequenceMatcher(None, block, template, autojunk=False).get_opcodes():
        if op != "equal":
            edits.append(f"{op}:{' '.join(template[c:d])}>{' '.join(block[a:b])}")
    return edits


def _marks(words: list[str]) -> tuple[set[str], set[tuple[str, ...]]]:
    """What tells a license from its sisters: the names in a wording, and its versions as runs of numbers."""
    names = {w for w in words if w in NAMES}
    if any(a == "gnu" and b == "library" for a, b in zip(words, words[1:], strict=False)):
        names.add("gnu library")
    versions = set()
    for i, w in enumerate(words):
        if w in VERSION:
            run = []
            for x in words[i + 1 :]:
                if not x.isdigit():
                    break
                run.append(x)
            while run and run[-1] == "0":  # version 2.0 is version 2
                run.pop()
            if run:
                versions.add(tuple(run))
    return names, versions


@cache
def _continuations(templates: tuple[tuple[str, str], ...]) -> dict[str, list[list[str]]]:
    """For each template how others go on that hold its last eight words."""
    split = {k: [m[0].lower() for m in _WORD.finditer(t)] for k, t in templates}
    out: dict[str, list[list[str]]] = {k: [] for k in split}
    for k, own in split.items():
        tail = own[-8:]
        for other, words in split.items():
            if other != k and len(tail) == 8:
                ends = [i + 8 for i in range(len(words) - 8) if words[i : i + 8] == tail]
                out[k] += [words[e : e + GOES_ON + 2] for e in ends if len(words) - e > GOES_ON]
    return out


def confirmed(found: list[str], after: list[str], name: str, templates: dict[str, str]) -> bool:
    """Whether a wording is that of its template and not of a sister: the same names and versions, and no other template goes on after it.

    Any other word may be left out, changed or put in, as the differences say.
    """
    if _marks(found) != _marks([m[0].lower() for m in _WORD.finditer(templates[name])]):
        return False
    for more in _continuations(tuple(templates.items()))[name]:
        at = 0
        for w in after[:BEYOND]:
            at += at < len(more) and w == more[at]
        if at >= GOES_ON:
            return False
    return True


def _scan_words(text: str, words: list[tuple[int, int]], templates: dict[str, str]) -> list[tuple[str, float, float, int, int, list[str]]]:
    number, lexicon = _lexicon(tuple(templates.items()))
    block = np.array([number.get(text[a:b].lower(), 0) for a, b in words], np.int64)
    out: list[tuple[str, float, float, int, int, list[str]]] = []
    alone: dict[tuple[int, int], int] = {}

    def saved(name: str, first: int, end: int) -> tuple[int, float]:
        """Bytes that the template as dictionary takes off the compressed size of the words, and the share of it."""
        raw = normal(text[words[first][0] : words[end - 1][1]]).encode()
        if (first, end) not in alone:
            alone[first, end] = _size(raw, None)
        less = alone[first, end] - _size(raw, normal(templates[name]).encode())
        return less, less / alone[first, end]

    todo = [(0, block.size)]
    while todo:
        lo, hi = todo.pop()
        found = []
        for k, template, counts in lexicon:
            for first, end, same in _wordings(block[lo:hi], template, counts, lambda a, b, k=k, lo=lo: saved(k, lo + a, lo + b)):
                less, gain = saved(k, lo + first, lo + end)
                own = [text[x:y].lower() for x, y in words[lo + first : lo + end]]
                if gain > MIN_GAIN and confirmed(own, [text[x:y].lower() for x, y in words[lo + end : lo + end + BEYOND]], k, templates):
                    edits = differences(own, [m[0].lower() for m in _WORD.finditer(templates[k])])
                    found.append((less, same - len(edits), k, gain, same / template.size, lo + first, lo + end, edits))
        taken: list[tuple[int, int]] = []
        # The conditional size decides: of confirmed templates that overlap, the one that takes most off.
        for _, _, k, gain, share, first, end, edits in sorted(found, key=lambda x: (-x[0], -x[1], x[2])):
            i = bisect_left(taken, (first, end))
            if (i == 0 or taken[i - 1][1] <= first) and (i == len(taken) or end <= taken[i][0]):
                taken.insert(i, (first, end))
                out.append((k, round(gain, 4), round(share, 4), words[first][0], words[end - 1][1], edits))
        # What lies between may hold wordings that overlapped a better one in part.
        if taken:
            todo += [(a, b) for a, b in zip([lo, *(x[1] for x in taken)], [*(x[0] for x in taken), hi], strict=True) if a < b]
    return out


def scan_block(block: str, templates: dict[str, str]) -> list[tuple[str, float, float, int, int, list[str]]]:
    """(license, size reduction, share, start, end, differences) of all findings in one block, in no order.

    A finding has MIN_SHARE of its template's words in order, without more extra words than template words between them,
    its template reduces its compressed size as a dictionary, and the words that tell licenses apart are the template's own. Every template whose words are there in number is
    compressed with, wherever that is so and as often as it is so, and aligned where it reduces the size. Of findings that overlap, the one whose
    template takes most bytes off stays, then the one with the most template words; then what lies between those that stay is scanned again until nothing more is found.
    """
    return _scan_words(block, [m.span() for m in _WORD.finditer(block)], templates)


def _scan(templates: dict[str, str]):
    names = ["doc_id", "license", "gain", "share", "start", "end", "differences"]
    types = [pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = 2 * max((x.size for _, x, _ in _lexicon(tuple(templates.items()))[1]), default=0)
        for batch in batches:
            doc, text = batch.columns
            for a, b, _, _ in chunks(text):
                rows = []
                for i, t in zip(doc.slice(a, b - a).to_pylist(), text.slice(a, b - a).to_pylist(), strict=True):
                    words = [m.span() for m in _WORD.finditer(t or "")]
                    for first, end in candidate_blocks(t or "", words, reach):
                        rows += [(i, *x) for x in _scan_words(t, words[first:end], templates)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names)

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All license wordings in all documents: (doc_id, license, gain, share, start, end, differences).

    Candidate blocks are runs of words about anchor words, over the whole text, with room for the longest template on both
    sides. In each, the parts that hold a template's words are compressed with the template as zstandard raw dictionary; where
    that reduces their size, the wording is aligned. The template that takes most off the wording's size is its license, if confirmed by their exact differences in wording: template words left out or changed, and words put in. All findings that
    do not overlap are given, however many a block has. ``start`` and ``end`` are code points.

    Null and empty texts have no findings, nor have documents without an anchor word. Null and repeated ids are kept as
    they are, repeated rows give repeated findings, other columns are not used. An empty table gives an empty result.
    """
    rows = docs.where(F.col(text_col).rlike(ANCHORS)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(templates), "doc_id long, license string, gain double, share double, start long, end long, differences array<string>")


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license wordings in all documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
