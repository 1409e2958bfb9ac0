"""License scans: MinHash bands over text windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import mix, parts, shingles, texts_buffer, words

SHINGLE = 5

# Published license notices and the usual sentences that name a license.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "mit-line-2": "Licensed under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd-line": "Distributed under the terms of the BSD License.",
    "mpl-2.0-line": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_CC = {
    "by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}
for _code, _name in _CC.items():
    for _version, _port in (("4.0", "International"), ("3.0", "Unported")):
        if f"cc-{_code}-{_version}-line" not in TEMPLATES:
            TEMPLATES[f"cc-{_code}-{_version}-line"] = f"This work is licensed under a Creative Commons {_name} {_version} {_port} License."
        TEMPLATES[f"cc-{_code}-{_version}-short"] = f"Licensed under CC {_code.upper()} {_version}."
        TEMPLATES[f"cc-{_code}-{_version}-spdx"] = f"SPDX-License-Identifier: CC-{_code.upper()}-{_version}"
for _id in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later"):
    TEMPLATES[f"{_id.lower()}-spdx"] = f"SPDX-License-Identifier: {_id}"
for _key, _name in (("lgpl", "Lesser General"), ("agpl", "Affero General")):
    for _version in ("2.1", "3") if _key == "lgpl" else ("3",):
        TEMPLATES[f"{_key}-{_version}-line"] = f"This work is licensed under the GNU {_name} Public License, version {_version}."
        _notice = TEMPLATES["gpl-3.0-or-later"].replace("GNU General Public License", f"GNU {_name} Public License")
        TEMPLATES[f"{_key}-{_version}-or-later"] = _notice.replace("either version 3 of", f"either version {_version} of")
TEMPLATES |= {
    "bsd-3-clause-line": "Licensed under the BSD 3-Clause License.",
    "bsd-2-clause-line": "Licensed under the BSD 2-Clause License.",
    "cc0-1.0-short": "Licensed under CC0 1.0 Universal.",
    "cc0-1.0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mit-disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "bsd-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "isc-disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
}


class Index:
    """Band keys of template stretches. A stretch is the largest power of two in four fifths of the template's shingles, so that a text which is only
    a shortened notice has one too; document windows have the same sizes, so a copy meets its template at a Jaccard index of 7/9 or more, and one with a fifth of its
    shingles changed at about 0.54: with 24 bands of 2 the chances of a common band are 1 - 4e-10 and 0.9997."""

    def __init__(self, templates: dict[str, str], bands: int = 24, rows: int = 2, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.mult = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.names, self.sets, keys, owner, self.sizes = [], [], [], [], set()
        for name in templates:
            data, offsets = texts_buffer(pa.array([templates[name]]))
            s = shingles(*words(data, offsets), SHINGLE)[0]
            if not len(s):
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            size = 1 << (max(1, -(-4 * len(s) // 5)).bit_length() - 1)
            self.sizes.add(size)
            for at in sorted({*range(0, len(s) - size + 1, max(1, size // 2)), len(s) - size}):
                keys.append(self.keys(self.minima(s[at : at + size], size)[:1], size)[0])
                owner += [(len(self.names), at)] * bands
            self.names.append(name)
            self.sets.append(s)
        self.key = np.concatenate(keys)
        self.owner = np.array(owner)
        order = np.argsort(self.key, kind="stable")
        self.key, self.owner = self.key[order], self.owner[order]
        self.known = np.unique(np.concatenate(self.sets))
        self.sizes = sorted(self.sizes)

    def reach(self, t: int) -> int:
        """Shingles of a text in which a copy of template t stands: a quarter more than its own, eight at least."""
        return len(self.sets[t]) + max(8, len(self.sets[t]) // 4)

    def minima(self, s: np.ndarray, size: int) -> np.ndarray:
        """MinHash values (window, hash) of every window of ``size`` shingles, by doubling."""
        m = mix(s[:, None] * self.mult[None, :])
        step = 1
        while step < size:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        return m

    def keys(self, m: np.ndarray, size: int) -> np.ndarray:
        k = np.zeros((len(m), self.bands), np.uint64)
        for r in range(self.rows):
            k = mix(k ^ m[:, r :: self.rows]) + np.uint64(r + 1)
        return mix(k + (np.arange(self.bands, dtype=np.uint64) * np.uint64(1000) + np.uint64(size))[None, :])


def _densest(s: np.ndarray, a: int, b: int, want: np.ndarray, width: int, least: float) -> tuple[float, int, int] | None:
    """(containment, first, last) of the first stretch of ``width`` shingles within a..b that holds most of the distinct shingles of ``want``."""
    names = np.unique(want)
    which = np.minimum(np.searchsorted(names, s[a:b]), len(names) - 1)
    at = np.flatnonzero(names[which] == s[a:b])
    if len(at) < least * len(names) - 1e-9:
        return None
    which = which[at]
    order = np.argsort(which, kind="stable")
    before = np.full(len(at), -1)  # the hit before of the same shingle
    same = which[order][1:] == which[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    end = np.searchsorted(at, at + width)
    top = (0, 0)
    for i in range(len(at)):  # hits in the stretch from hit i, each shingle once
        if end[i] - i > top[0]:
            n = int((before[i : end[i]] < i).sum())
            top = (n, i) if n > top[0] else top
    n, i = top
    return None if n < least * len(names) - 1e-9 else (n / len(names), a + int(at[i]), a + int(at[end[i] - 1]))


def _scan(x: Index, s: np.ndarray, pos: np.ndarray, row: np.ndarray, least: float) -> list[tuple[int, int, float, int, int]]:
    """(row, template, containment, first word, last word) of the best place of each template in each row."""
    at = np.minimum(np.searchsorted(x.known, s), len(x.known) - 1)
    known = np.flatnonzero(x.known[at] == s)  # a window without any template shingle contains no template
    doc = row[pos]
    start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    bounds = {int(doc[b]): (int(b), int(e)) for b, e in zip(start, np.concatenate((start[1:], [len(doc)])), strict=True)}
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    if not len(known):
        return []
    reach = x.sizes[-1]
    gap = np.flatnonzero((np.diff(known) > 2 * reach) | (np.diff(doc[known]) != 0)) + 1
    for run in np.split(known, gap):
        d = int(doc[run[0]])
        low, high = bounds[d]
        a, b = max(low, int(run[0]) - reach), min(high, int(run[-1]) + reach + 1)
        tried = set()
        for size in x.sizes:
            stride = max(1, size // 4)
            for p in range(a, max(a + 1, b - size + 1), 4096):  # long runs in stretches
                piece = s[p : min(b, p + 4096 + size - 1)]
                if len(piece) < size:
                    continue
                k = x.keys(x.minima(piece, size)[::stride], size)
                lo, hi = np.searchsorted(x.key, k), np.searchsorted(x.key, k, "right")
                for w, c in zip(*np.nonzero(hi > lo), strict=True):
                    for t, offset in x.owner[lo[w, c] : hi[w, c]].tolist():
                        tried.add((t, p + int(w) * stride - offset))
        for t, begin in sorted(tried):
            width = x.reach(t)
            got = _densest(s, max(low, begin - width), min(high, begin + 2 * width), x.sets[t], width, least)
            if got:
                share, first, last = got
                got = (share, int(pos[first]) - int(pos[low]), int(pos[last]) - int(pos[low]) + SHINGLE - 1)
                if (d, t) not in best or (got[0], -got[1]) > (best[d, t][0], -best[d, t][1]):
                    best[d, t] = got
    found = [(d, t, *v) for (d, t), v in sorted(best.items())]
    by_doc: dict[int, list] = {}
    for m in found:
        by_doc.setdefault(m[0], []).append(m)
    shared = lambda m: m[2] * len(x.sets[m[1]])
    return [m for m in found if not any(o[2] > m[2] and shared(o) >= shared(m) and o[3] <= m[4] and m[3] <= o[4] for o in by_doc[m[0]])]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """(doc_id, license, containment, first_word, last_word): for each document row and template, the first stretch of ``Index.reach`` shingles with most of the template's, where ``least`` or
    more of the template's distinct five-word shingles stand together, unless a template with a higher containment and as many shingles in common overlaps it (another version of a license); words count from 0, case and punctuation are ignored.

    Null, empty and shorter texts match nothing; repeated rows give rows of their own; other columns are ignored. Templates
    are a fixed small set that goes to the tasks with the code; documents are read in place and never shuffled.
    """
    x = Index(TEMPLATES if templates is None else templates)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_buffer(batch.column(1))
            ids, found = batch.column(0).to_pylist(), []
            for low, high in parts(offsets):
                h, row = words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                s, pos = shingles(h, row, SHINGLE)
                found += [(ids[low + d], x.names[t], *v) for d, t, *v in _scan(x, s, pos, row, least)]
            columns = list(zip(*found, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "license", "containment", "first_word", "last_word"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(each, "doc_id bigint, license string, containment double, first_word bigint, last_word bigint")
