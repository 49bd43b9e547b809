"""License scans by patience alignment.

Text and template are words; anchors are the words that occur once in both; the longest increasing
subsequence of their places is kept, and the gaps between anchors (and before and after them, as
far as the template reaches) are aligned in the same way. Coverage is the share of the template's words that
are aligned; a place with COVER or more is a finding if the words that tell the license from its neighbours (name, version,
variant, clause; in brackets in the templates) stand there whole and side by side. So a notice may miss words that tell nothing.
Of findings that overlap the one with more aligned words stays, then the one with more coverage.

Templates are wordings of notices, operative paragraphs, and whole texts (`license_texts/`). Of CC's legal codes only BY-SA is held;
the others are found by the sentences that name them. A BSD text that breaks off before its second clause is `BSD`.

Scale: one narrow scan, no shuffle. Word fingerprints of whole texts are compared with all telling words at once;
a template is aligned only in texts that hold its telling words, around the rarest of them, so time follows the text. Templates are
fixed values of about 150 KB. Word fingerprints only propose; words are aligned as text.

Nulls and repeats: a null or empty text has no findings; a null doc_id is carried; each row has one
row in the result, repeated or not; a license that stands several times has a span for each, however near they stand. Findings with the same words and
coverage: the one that begins first, then the first name. Very long texts are scanned whole; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache
from pkgutil import get_data

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm._shared import ALNUM, LOWER, chunks, only, small_batches, text_buffer, word_hashes, word_spans

COVER = 0.8

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = _BSD.replace("Redistributions of source code", "[Redistributions of source code]") + " [Redistributions in binary form] must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " Neither the name of the copyright holder [nor the names of] its contributors may be used to [endorse or promote products] derived from this software without specific prior written permission."
_BSD_4 = " [All advertising materials mentioning features] or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this [permission notice shall be included] in all copies or substantial portions of the Software."""
_MIT_END = """ THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = "Permission to use, copy, modify, and/or distribute this software [for any purpose with or without fee] is hereby granted"
_ISC_MORE = ", [provided that the above copyright notice] and this permission notice appear in all copies."
_ISC_END = """ THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def _gnu(kind: str, short: str, n: str) -> list[str]:
    """Wordings of the GNU licenses: with the kind ("Lesser ") and the version."""
    full, thing = f"GNU {kind}General Public License", "library" if short == "LGPL" else "program"
    names = [f"{full}, version {n}", f"{full} v{n}", f"GNU {short} version {n}", f"GNU {short} v{n}", f"GNU {short}v{n}", f"{short} version {n}", f"{short} v{n}", f"{short}v{n}", f"{short} {n}"]
    more = [f"version {n} of the {full}", f"version {n} of the GNU {short}"]
    terms = f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the"
    return [
        f"This work is licensed [under] the [{full}, version {n}].",
        f"{terms} [{full}] as published by the Free Software Foundation, either [version {n}] of the License, or (at your option) any later version.",
        f"{terms} [{full} version {n}] as published by the Free Software Foundation.",
        f"{terms} [{full}] as published by the Free Software Foundation; [version {n}] of the License.",
        *_notices(*names, *more),
    ]


def _notices(*names: str) -> list[str]:
    ways = ("Licensed [under] [{}]", "Licensed [under] the [{}]", "Released [under] the [{}]", "Distributed [under] the terms of the [{}]", "[under] [{}]", "[License: {}]", "[SPDX-License-Identifier: {}]")
    return [w.format(n) for n in names for w in ways]


def _cc(code: str, name: str) -> list[str]:
    short, full = f"CC {code} 4.0", f"Creative Commons Attribution{name} 4.0"
    return [f"Licensed [under] [{short}].", f"This work is licensed [under] a [{full} International] License.", f"terms and conditions of this [{full} International] Public License", *_notices(short, f"{full} International License", f"{full} License")]


#: Usual notices and the operative paragraphs of public licenses. In brackets what tells a license from its neighbours.
TEMPLATES = {
    "Apache-2.0": ["Licensed [under] the [Apache License, Version 2.0].", """Licensed under the [Apache License, Version 2.0] (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""", *_notices("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache-2.0")],
    "MIT": ["Released [under] the [MIT License].", _MIT, _MIT + _MIT_END, *_notices("MIT License"), "[SPDX-License-Identifier: MIT]", "[License: MIT]"],
    "GPL-3.0": _gnu("", "GPL", "3"),
    "GPL-2.0": _gnu("", "GPL", "2"),
    "AGPL-3.0": _gnu("Affero ", "AGPL", "3"),
    "LGPL-3.0": _gnu("Lesser ", "LGPL", "3"),
    "LGPL-2.1": _gnu("Lesser ", "LGPL", "2.1"),
    "LGPL-2.0": _gnu("Library ", "LGPL", "2"),
    "CC-BY-NC-4.0": _cc("BY-NC", "-NonCommercial"),
    "CC-BY-4.0": _cc("BY", ""),
    "CC-BY-SA-4.0": _cc("BY-SA", "-ShareAlike"),
    "CC-BY-ND-4.0": _cc("BY-ND", "-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _cc("BY-NC-SA", "-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _cc("BY-NC-ND", "-NonCommercial-NoDerivatives"),
    "ISC": [_ISC + _ISC_MORE, _ISC + _ISC_MORE + _ISC_END, *_notices("ISC License"), "[SPDX-License-Identifier: ISC]"],
    "0BSD": [_ISC + "." + _ISC_END, "[SPDX-License-Identifier: 0BSD]"],
    "BSD-2-Clause": [_BSD_2, _BSD_2 + _BSD_END, *_notices("BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause", "Simplified BSD License")],
    "BSD-3-Clause": [_BSD_2 + _BSD_3, _BSD_2 + _BSD_3 + _BSD_END, *_notices("BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause", "New BSD License", "Modified BSD License")],
    "BSD-4-Clause": [_BSD_2 + _BSD_4 + _BSD_3, _BSD_2 + _BSD_4 + _BSD_3 + _BSD_END, *_notices("BSD 4-Clause License", "4-Clause BSD License", "BSD-4-Clause")],
    "BSD": [_BSD.replace("Redistributions of source code", "[Redistributions of source code]")],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the [Mozilla Public License, v. 2.0]. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", *_notices("Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0")],
    "Unlicense": ["This is free and [unencumbered software released into the public domain]. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", *_notices("Unlicense")],
    "CC0-1.0": ["To the extent possible under law, the author has [waived all copyright and related or neighboring rights] to this work.", "[CC0 1.0 Universal]", *_notices("CC0 1.0", "CC0-1.0", "Creative Commons Zero v1.0 Universal")],
}

#: Whole texts and the words in them that tell.
WHOLE = {
    "Apache-2.0": ["Grant of Copyright License", "Grant of Patent License"],
    "GPL-2.0": ["Activities other than copying, distribution and modification"],
    "GPL-3.0": ["Use with the GNU Affero General Public License"],
    "LGPL-2.0": ["GNU Library General Public License", "work that uses the Library"],
    "LGPL-2.1": ["GNU Lesser General Public License", "work that uses the Library"],
    "LGPL-3.0": ["Exception to Section 3 of the GNU GPL"],
    "CC-BY-SA-4.0": ["Attribution-ShareAlike 4.0 International Public License"],
}


def _whole() -> Iterator[tuple[str, str]]:
    for name, tells in WHOLE.items():
        text = re.sub(r"[\[\]]", " ", get_data(__package__, f"license_texts/{name}.txt").decode())
        told = text
        for tell in tells:
            told = re.sub(r"[^A-Za-z0-9]+".join(re.findall("[A-Za-z0-9]+", tell)), lambda m: f"[{m[0]}]", told, count=1, flags=re.IGNORECASE)
        yield name, told
        if name == "GPL-3.0":
            # The AGPL is this text with its own name and section 13.
            own = re.sub(r"GNU\s+General\s+Public", "GNU Affero General Public", text, flags=re.IGNORECASE)
            yield "AGPL-3.0", re.sub(r"Use with the GNU Affero General Public License", "[Remote Network Interaction]; Use with the GNU General Public License", own, count=1)


def words(text: str) -> list[str]:
    raw, offs = text_buffer(pa.array([text]))
    raw = LOWER[raw]
    starts, ends, _ = word_spans(raw, offs, ALNUM)
    data = raw.tobytes()
    return [data[a:b].decode() for a, b in zip(starts, ends, strict=True)]


class Template:
    """A license's words; tells: (place, words) of what must stand whole."""

    def __init__(self, name: str, text: str):
        self.name, self.words, self.tells = name, [], []
        for k, part in enumerate(re.split(r"[\[\]]", text)):
            own = words(part)
            if k % 2:
                self.tells.append((len(self.words), own))
            self.words += own
        self.need = needed(len(self.words))


#: Names and texts of templates; None: those of this module.
Given = tuple[tuple[str, str], ...] | None


def given(templates: dict[str, list[str]] | None) -> Given:
    """Templates of one's own: name -> texts, with what tells them apart in brackets (a text without brackets tells as a whole)."""
    return None if templates is None else tuple((name, t if "[" in t else f"[{t}]") for name, own in templates.items() for t in own)


@cache
def _templates(own: Given = None) -> list[Template]:
    found = [(name, t) for name, own_ in TEMPLATES.items() for t in own_] + list(_whole()) if own is None else own
    return [t for t in (Template(*f) for f in dict.fromkeys(found)) if any(words for _, words in t.tells)]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by the first number) that increases in the second: patience sorting with back links."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        if pile == len(tops):
            tops.append(y)
            at.append(k)
        else:
            tops[pile], at[pile] = y, k
        back[k] = at[pile - 1] if pile else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs (place in text, place in template) of equal words, increasing in both."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(text), 0, len(template))]
    while stack:
        a, b, c, d = stack.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        once, here = Counter(text[a:b]), Counter(template[c:d])
        where = {w: k for k, w in enumerate(template[c:d], c) if here[w] == 1}
        chain = increasing([(k, where[w]) for k, w in enumerate(text[a:b], a) if once[w] == 1 and w in where])
        if not chain:
            continue
        out += chain
        x, y = a, c
        for i, j in [*chain, (b, d)]:
            stack.append((x, i, y, j))
            x, y = i + 1, j + 1
    return sorted(out)


def needed(m: int) -> int:
    """Aligned words that a template of m words needs."""
    return -int(-m * COVER // 1)


def _place(text: list[str], template: Template, tell: int, p: int, low: int) -> list[tuple[int, int]] | None:
    """The alignment of a template whose tell stands at p, if it is a finding."""
    g, own = template.tells[tell]
    m, k = len(template.words), len(own)
    # As many words may stand between as on either side belong there.
    start, end = max(low, p - 2 * g), min(len(text), p + k + 2 * (m - g - k))
    pairs = [(start + i, j) for i, j in align(text[start:p], template.words[:g])]
    pairs += [(p + i, g + i) for i in range(k)]
    pairs += [(p + k + i, g + k + j) for i, j in align(text[p + k : end], template.words[g + k :])]
    if len(pairs) < template.need:
        return None
    at = {j: i for i, j in pairs}
    whole = all(t in at and at.get(t + x) == at[t] + x for t, w in template.tells for x in range(len(w)))
    return pairs if whole else None


def find(text: list[str], among: list[int] | None = None, own: Given = None) -> list[tuple[str, int, int, float]]:
    """(license, first word, last word + 1, coverage) in a text; among: the templates that can stand there."""
    found, held = [], _templates(own)
    where: dict[str, list[int]] = {}
    for k, w in enumerate(text):
        where.setdefault(w, []).append(k)
    for template in held if among is None else [held[k] for k in among]:
        stands = []
        for _, tell in template.tells:
            # By the rarest word of each tell.
            rare = min(range(len(tell)), key=lambda x: len(where.get(tell[x], ())))
            stands.append([k - rare for k in where.get(tell[rare], ()) if k >= rare and text[k - rare : k - rare + len(tell)] == tell])
        tell, low = min(range(len(stands)), key=lambda x: len(stands[x])), 0
        for p in stands[tell] if all(stands) else ():
            pairs = _place(text, template, tell, p, low) if p >= low else None
            if pairs:
                low = pairs[-1][0] + 1
                found.append((len(pairs), len(pairs) / len(template.words), template.name, pairs[0][0], low))
    out: list[tuple[str, int, int, float]] = []
    for _, share, name, first, last in sorted(found, key=lambda f: (-f[0], -f[1], f[3], f[2])):
        if all(last <= x or y <= first for _, x, y, _ in out):
            out.append((name, first, last, share))
    return sorted(out, key=lambda f: f[1:3])


@cache
def _telling(templates: Given = None) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all telling words, sorted, and for each template which of them it needs."""
    own = [sorted({w for _, tell in t.tells for w in tell}) for t in _templates(templates)]
    raw, offs = text_buffer(pa.array([" ".join(w for ws in own for w in ws)]))
    starts, ends, _ = word_spans(raw, offs, ALNUM)
    known, at = np.unique(word_hashes(raw, starts, ends), return_inverse=True)
    need = np.zeros((len(own), len(known)), bool)
    need[np.repeat(np.arange(len(own)), [len(ws) for ws in own]), at] = True
    return known, need


_FOUND = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())]))


def _found(batch: pa.RecordBatch, templates: Given = None) -> tuple[np.ndarray, pa.Array]:
    raw, offs = text_buffer(batch.column("text"))
    raw = LOWER[raw]
    starts, ends, rows = word_spans(raw, offs, ALNUM)
    hashes, n = word_hashes(raw, starts, ends), batch.num_rows
    counts = np.bincount(rows, minlength=n)
    base = np.concatenate([[0], np.cumsum(counts)])
    known, need = _telling(templates)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    own = np.flatnonzero(known[at] == hashes)
    has = np.zeros((n, len(known)), bool)
    has[rows[own], at[own]] = True
    # A template can stand where none of its telling words is missing.
    can = (~has).astype(np.float32) @ need.T.astype(np.float32) == 0
    data, out = raw.tobytes(), [[] for _ in range(n)]
    for i in np.flatnonzero(can.any(axis=1)):
        text = [data[a:b].decode() for a, b in zip(starts[base[i] : base[i + 1]], ends[base[i] : base[i + 1]], strict=True)]
        out[i] = [dict(zip(("license", "first", "last", "coverage"), f, strict=True)) for f in find(text, np.flatnonzero(can[i]).tolist(), templates)]
    return counts.astype(np.int64), pa.array(out, _FOUND)


def scan(documents: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, n_words, found (license, first word, last word + 1, coverage). templates: see given(); else those of this module."""
    own = given(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            counts, found = _found(batch, own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), found], names=["doc_id", "n_words", "found"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(docs).mapInArrow(run, "doc_id long, n_words long, found array<struct<license: string, first: long, last: long, coverage: double>>")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_found, licenses (sorted, distinct), covered_words, best coverage, spans."""
    found = scan(only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
    spans = F.transform("found", lambda f: F.concat_ws(":", f["license"], f["first"].cast("string"), f["last"].cast("string")))
    return found.select("doc_id", "n_words", F.size("found").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"), F.coalesce(F.array_max("found.coverage"), F.lit(0.0)).alias("coverage"), F.array_join(spans, ",").alias("spans"))
