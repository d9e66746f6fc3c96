"""License scan: winnowed template fingerprints, then banded alignment.

Texts are read as runs of ASCII letters, digits and non-ASCII bytes, in lower case. Every
``K`` words make a hash; of every ``WINDOW`` neighbouring hashes the smallest is kept
(winnowing), on both sides, so a run of ``K + WINDOW - 1`` words shared with a template always
shares a kept hash. The templates' kept hashes form an inverted index (hash to template and
position). A document's hits name candidate templates. Notices are aligned locally in a band of
``BAND`` words around the diagonals of their hits. Longer templates are aligned along the longest
chain of hits that increases in both texts, over all diagonals: two neighbouring hits bound the
alignment between them, so words put in or left out, page marks or moved paragraphs, however long,
do not lose what follows. An alignment reports how much of the template is matched and where.
Coverage is the matched part of the template's words and the words put in between;
matches below ``min_coverage`` are dropped. So are matches without a deciding word of the
template (a license's name or version), or with one the template lacks ("Lesser", "NC"): these
are a sibling. Of overlapping matches the one with the most matched words stays, less half a
word for each word left out or put in. A template is aligned only with a hit for every ``RARE`` of
its kept hashes: chance phrases would cost an alignment each.

The index is built from the template list alone (a parameter of known size, shipped with the
task); documents stream through it whole, row by row, with no shuffle. Null and empty texts
have no match; texts of any length are scanned whole. Repeated rows are scanned alike. Of equal
matches the first in the text, then the first template by name stays. Columns other than the id and
the text do not take part, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, WINDOW, BAND = 3, 3, 8
MIN_COVERAGE = 0.8
RARE = 20
SHORT, LONG = 30, 120         # words: every number decides up to SHORT, names up to LONG

# Short notices and opening passages of well-known public licenses. What follows
# a # in a name tells wordings of one license apart and is not reported.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See "
        "the License for the specific language governing permissions and limitations under the "
        "License."),
    "BSD-opening": (                 # of every BSD license
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:"),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the "
        "terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version."),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."),
}

_GNU = {"GPL": "General", "LGPL": "Lesser General", "AGPL": "Affero General",
        "LGPL-2.0": "Library General"}
_NAMED = {
    "0BSD": ["BSD Zero Clause License", "0BSD License"],
    "Apache-1.1": ["Apache License, Version 1.1", "Apache Software License, Version 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "Artistic-1.0": ["Artistic License 1.0"], "Artistic-2.0": ["Artistic License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License",
                     "Modified BSD License"],
    "BSD-4-Clause": ["BSD 4-Clause License", "4-Clause BSD License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons CC0 1.0 Universal", "CC0 1.0 Universal license"],
    "CDDL-1.0": ["Common Development and Distribution License, Version 1.0"],
    "EPL-1.0": ["Eclipse Public License, Version 1.0", "Eclipse Public License v1.0",
                "Eclipse Public License 1.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License v2.0",
                "Eclipse Public License 2.0"],
    "EUPL-1.2": ["European Union Public Licence, Version 1.2", "EUPL, Version 1.2"],
    "ISC": ["ISC License"], "MIT": ["MIT License"],
    "MPL-1.1": ["Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    "Unlicense": ["Unlicense License"], "WTFPL": ["Do What The Fuck You Want To Public License"],
    "Zlib": ["zlib License"],
}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
       "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def _common() -> dict[str, str]:
    """Notices of the common licenses and their versions, and the bodies in ``license_texts``."""
    named = {k: list(v) for k, v in _NAMED.items()}
    out: dict[str, str] = {}
    for kind, versions in (("GPL", "1.0 2.0 3.0"), ("LGPL", "2.0 2.1 3.0"), ("AGPL", "3.0")):
        for full in versions.split():
            name, v = f"{kind}-{full}", full.removesuffix(".0")
            title = f"GNU {_GNU.get(name, _GNU[kind])} Public License"
            named[name] = [f"{title}, version {v}", f"{title} v{full}", f"GNU {kind} version {v}",
                           f"GNU {kind} v{v}"]
            what = "library" if name in ("LGPL-2.0", "LGPL-2.1") else "program"
            out[f"{name}-notice#long"] = (
                f"This {what} is free software: you can redistribute it and/or modify it under "
                f"the terms of the {title} as published by the Free Software Foundation, either "
                f"version {v} of the License, or (at your option) any later version.")
    for code, title in _CC.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            named[f"CC-{code}-{v}"] = [f"CC {code} {v}",
                                       f"Creative Commons {title} {v} International License",
                                       f"Creative Commons {title} {v} License"]
    for name, titles in named.items():
        out[f"{name}#spdx"] = f"SPDX-License-Identifier: {name}"
        for k, title in enumerate(titles):
            the = "" if title.startswith("CC") else "the " if "Creative" not in title else "a "
            for n, verb in enumerate(("Licensed", "Released", "This work is licensed")):
                out[f"{name}#{k}.{n}"] = f"{verb} under {the}{title}."
    for path in sorted(Path(__file__).with_name("license_texts").glob("*.txt")):
        out[f"{path.stem}#text"] = path.read_text(encoding="utf-8")
    return out


_SHIPPED = _common()
TEMPLATES |= {k: v for k, v in _SHIPPED.items() if v not in TEMPLATES.values()}

#: Words that name a license, and those that tell it from a sibling.
_NAMES = (b"affero apache artistic boost bsd bsl cc cc0 cddl clause creative eclipse eupl european gnu gpl "
          b"isc lesser lgpl agpl library mit modified mozilla mpl new simplified unlicense wtfpl zero zlib 0bsd")
_APART = (b"affero lesser nc nd sa noncommercial noderivatives noderivs sharealike")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128
              else 32 for b in range(256))      # same length: offsets stay valid
_WORD = re.compile(rb"[^ ]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def word_codes(text: bytes) -> np.ndarray:
    words = text.translate(_FOLD).split()
    return np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words))


_NAME_CODES = frozenset(map(crc32, _NAMES.split()))
_APART_CODES = frozenset(map(crc32, _APART.split()))
_NUMBER = re.compile(rb"v?[0-9]+")


def numbers(text: bytes) -> frozenset[int]:
    return frozenset(crc32(x) for x in text.translate(_FOLD).split() if _NUMBER.fullmatch(x))


def same_license(template: np.ndarray, words: np.ndarray, given: frozenset[int],
                 found: frozenset[int]) -> bool:
    """Whether the matched words have the template's deciding words and no others.

    ``given`` and ``found``: the codes that are numbers in the template and in the text."""
    n = len(template)
    if n > LONG:
        return True
    want, got = Counter(template.tolist()), Counter(words.tolist())
    if n <= SHORT:
        if any(got[x] < k for x, k in want.items() if x in given or x in _NAME_CODES):
            return False
        extra = _APART_CODES | found
    else:
        if any(x not in got for x in want if x in given or x in _NAME_CODES):
            return False
        extra = _APART_CODES
    if any(x in _APART_CODES and x not in got for x in want):
        return False
    return all(x in want for x in got if x in extra)


def winnow(codes: np.ndarray, always: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the kept hashes of a word sequence (fewer words than K: none), and
    of all hashes in ``always``."""
    n = len(codes) - K + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = sum((codes[k:n + k] + np.uint64(k + 1)) * _MIX[k % len(_MIX)] for k in range(K))
    h ^= h >> np.uint64(29)
    w = min(WINDOW, n)
    views = np.lib.stride_tricks.sliding_window_view(h, w)
    at = np.unique(np.argmin(views, axis=1) + np.arange(len(views)))
    if always is not None and len(always):
        at = np.union1d(at, np.flatnonzero(np.isin(h, always)))
    return at, h[at]


@dataclass
class Index:
    names: list[str]
    codes: list[np.ndarray]
    hashes: np.ndarray          # sorted, with a posting each
    template: np.ndarray
    position: np.ndarray
    need: list[int]             # hits around a diagonal that is aligned
    numbers: list[frozenset[int]]
    always: np.ndarray          # the hashes of templates too short for winnowing to promise a hit

    @classmethod
    def build(cls, templates: Mapping[str, str]) -> Index:
        names = sorted(templates)
        codes = [word_codes(templates[x].encode()) for x in names]
        found = [(h, t, p) for t, c in enumerate(codes) for p, h in zip(*winnow(c), strict=True)]
        found.sort()
        return cls(names, codes, np.array([x[0] for x in found], dtype=np.uint64),
                   np.array([x[1] for x in found], dtype=np.int64),
                   np.array([x[2] for x in found], dtype=np.int64),
                   [max(1, k // RARE) for k in np.bincount(
                       np.array([x[1] for x in found], dtype=np.int64), minlength=len(names))],
                   [numbers(templates[x].encode()) for x in names],
                   np.array(sorted({h for h, t, _ in found if len(codes[t]) < K + WINDOW - 1}),
                            dtype=np.uint64))

    def hits(self, codes: np.ndarray) -> np.ndarray:
        """Rows of (template, diagonal, document position)."""
        at, h = winnow(codes, self.always)
        lo, hi = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
        size = hi - lo
        if not size.any():
            return np.zeros((0, 3), np.int64)
        doc = np.repeat(at, size)
        k = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        rows = np.stack([self.template[k], doc - self.position[k], doc], 1)
        return rows[np.lexsort(rows.T[::-1])]


def align(template: np.ndarray, words: np.ndarray, diagonal: int, band: int = BAND
          ) -> tuple[int, int, int, int]:
    """Banded local alignment: matched template words, first and last matched document word,
    and words put in between.

    Match +1; a word replaced, left out or put in costs 1/2, and a score below 0 starts anew.
    """
    best = (0.0, 0, -1, -1, 0)
    width = 2 * band + 1
    none = (0.0, 0, -1, 0)                  # score, matches, begin, words put in
    row: list[tuple[float, int, int, int]] = [none] * (width + 1)
    first = max(0, diagonal - band)
    near = words[first:max(first, diagonal + band + len(template) + 1)].tolist()
    for i, t in enumerate(template.tolist()):
        new = [none] * (width + 1)
        for b in range(width):
            j = i + diagonal + b - band
            if 0 <= j < len(words):
                s, m, begin, more = row[b]
                if near[j - first] == t:
                    cell = (s + 1.0, m + 1, j if begin < 0 else begin, more)
                    if (cell[0], cell[1]) > best[:2]:
                        best = (cell[0], cell[1], cell[2], j, more)
                else:
                    cell = (s - 0.5, m, begin, more)
                s, m, begin, more = row[b + 1]
                if s - 0.5 > cell[0]:
                    cell = (s - 0.5, m, begin, more)
                s, m, begin, more = new[b - 1] if b else none
                if s - 0.5 > cell[0]:
                    cell = (s - 0.5, m, begin, more + 1)
                new[b] = cell if cell[0] > 0 else none
        row = new
    return best[1:]


def _common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by the matches of each word in turn."""
    if a == b:
        return len(a)
    places: dict[int, list[int]] = {}
    for k in range(len(a) - 1, -1, -1):
        places.setdefault(a[k], []).append(k)
    ends: list[int] = []
    for x in b:
        for k in places.get(x, ()):
            at = bisect_left(ends, k)
            ends[at:at + 1] = [k]
    return len(ends)


def _longest_chain(rows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The most hits (document, template position) that increase in both, from sorted hits."""
    ends: list[int] = []
    holder: list[int] = []
    back = [-1] * len(rows)
    for k, (_, p) in enumerate(rows):
        at = bisect_left(ends, p)
        back[k] = holder[at - 1] if at else -1
        ends[at:at + 1], holder[at:at + 1] = [p], [k]
    out, k = [], holder[-1]
    while k >= 0:
        out.append(rows[k])
        k = back[k]
    return out[::-1]


def _best_part(chain: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The part of a chain with the best local score: new words of a hit count 1, words that one
    side has more between two hits cost 1/2, and a score below 0 starts anew."""
    best, score, begin, part = 0.0, 0.0, 0, (0, 0)
    for k, (d, p) in enumerate(chain):
        if k:
            step, tstep = d - chain[k - 1][0], p - chain[k - 1][1]
            score += min(K, step, tstep) - abs(step - tstep) / 2
        if score <= 0:
            score, begin = float(K), k
        if score > best:
            best, part = score, (begin, k + 1)
    return chain[part[0]:part[1]]


def chained(template: np.ndarray, words: np.ndarray, rows: list[tuple[int, int]], need: int
            ) -> Iterator[tuple[int, int, int, int]]:
    """Alignments along chains of hits, over all diagonals: matched template words, first and last
    matched document word, words put in between. Between neighbouring hits of a chain, which bound
    the alignment on both sides, it is exact, however many words were put in or left out; at its
    ends it goes on while words are equal. Another chain is sought in the hits that are left."""
    t, w = template.tolist(), words.tolist()
    rows = sorted(set(rows), key=lambda x: (x[0], -x[1]))
    while len(rows) >= need:
        chain = _best_part(_longest_chain(rows))
        if len(chain) < need:
            return
        (a, p), matched, more = chain[0], 0, 0
        while a and p and w[a - 1] == t[p - 1]:
            a, p, matched = a - 1, p - 1, matched + 1
        for (d0, p0), (d1, p1) in zip(chain, chain[1:], strict=False):
            matched += _common_words(t[p0:p1], w[d0:d1])
            more += max(0, (d1 - d0) - (p1 - p0))
        b, p = chain[-1]
        while b < len(w) and p < len(t) and w[b] == t[p]:
            b, p, matched = b + 1, p + 1, matched + 1
        yield matched, a, b - 1, more
        rows = [x for x in rows if not a <= x[0] < b]


def _diagonals(rows: list[tuple[int, int]], need: int) -> list[int]:
    """The diagonals of the bands to align: hits within half a band, if enough of them."""
    out: list[list[int]] = []
    for diagonal in sorted(d - p for d, p in rows):
        if out and diagonal - out[-1][0] <= BAND // 2:
            out[-1][1] += 1               # inside the band of that diagonal
        else:
            out.append([diagonal, 1])
    return [d for d, n in out if n >= need]


def alignments(t: int, index: Index, codes: np.ndarray, rows: list[tuple[int, int]]
               ) -> Iterator[tuple[int, int, int, int]]:
    """Alignments of a template with a text: along diagonals for short ones, along chains of hits
    for those of more than ``SHORT`` words, both ways up to ``LONG``."""
    template, need = index.codes[t], index.need[t]
    if len(template) > SHORT:
        yield from chained(template, codes, rows, need)
    if len(template) <= LONG:
        for diagonal in _diagonals(rows, need):
            yield align(template, codes, diagonal)


def find_licenses(text: bytes, index: Index, min_coverage: float = MIN_COVERAGE
                  ) -> list[tuple[str, int, int, float]]:
    """(template, first byte, end byte, coverage) of the matches in one text, in order."""
    codes = word_codes(text)
    hits = index.hits(codes)
    if not len(hits):
        return []
    by_template: dict[int, list[tuple[int, int]]] = {}
    for t, diagonal, d in hits.tolist():
        by_template.setdefault(t, []).append((d, d - diagonal))
    found: dict[tuple[int, int, int], tuple[float, float]] = {}    # rank, coverage
    digits: frozenset[int] | None = None
    for t, rows in by_template.items():
        template = index.codes[t]
        for matched, a, b, more in alignments(t, index, codes, rows):
            coverage = matched / (len(template) + more)
            if coverage < min_coverage:
                continue
            digits = numbers(text) if digits is None else digits
            if same_license(template, codes[a:b + 1], index.numbers[t], digits):
                rank = matched - (len(template) - matched + more) / 2
                found[t, a, b] = max(found.get((t, a, b), (0.0, 0.0)), (rank, coverage))
    chosen: list[tuple[int, int, int]] = []
    for x in sorted(found, key=lambda x: (-found[x][0], -found[x][1], x[1], x[0])):
        if all(x[2] < y[1] or y[2] < x[1] for y in chosen):
            chosen.append(x)
    if not chosen:
        return []
    spans = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    return [(index.names[t].split("#")[0], spans[a][0], spans[b][1], found[t, a, b][1])
            for t, a, b in sorted(chosen, key=lambda x: x[1])]


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id",
         text_col: str = "text", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per document: id and ``matches``, an array of (template, start, end, coverage);
    positions are code points, end exclusive."""
    given = dict(templates)
    out = pa.list_(pa.struct([("template", pa.string()), ("start", pa.int64()),
                              ("end", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.build(given)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                rows.append([{"template": n, "start": len(text[:a].decode()),
                              "end": len(text[:b].decode()), "coverage": c}
                             for n, a, b, c in find_licenses(text, index, min_coverage)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, out)],
                                             names=[id_col, "matches"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary")
                        .alias(text_col))
            .mapInArrow(run, f"`{id_col}` {kind}, matches array<struct<template:string,"
                             "start:bigint,end:bigint,coverage:double>>"))


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest columns: number of matches, names, spans, best coverage (0 without a match)."""
    spans = F.transform("matches", lambda m: F.concat_ws(
        ":", m["template"], m["start"].cast("string"), m["end"].cast("string")))
    return scanned.select(
        id_col, F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.col("matches.template"))), ",")
        .alias("licenses"), F.array_join(spans, ",").alias("spans"),
        F.coalesce(F.array_max("matches.coverage"), F.lit(0.0)).alias("coverage"))
