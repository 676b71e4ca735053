"""Licence scan by conditional compression.

Each mandatory word of licences (`licen`, `copyright`, `warrant`, `redistribut`, `permission`, `subject to the terms`, `unencumbered`, in any case) makes
a candidate block with as many words before and after it as a place of the longest template can take, over any line breaks; blocks that meet are
one. Templates of up to 32, 64, 128, ... words are looked for apart, as what a short one saves would be lost in a long window. Candidates are read in overlapping
windows of four times the longest template of the size, each place lying whole in one of them. Each window is
compressed with zstandard, by itself and with each template as raw dictionary, under the same parameters; the part of a
template's own compressed size that it saves ranks the templates, and those that save `WON` of it are the winners. Winners, and no others, are confirmed by
wording: the words of the template are aligned with those of the window, from its rarest words there, and the template is found when every word stands there in the same order, apart
from at most `ALLOWED` of its words replaced, missing or put in; differences in words that tell licences apart (versions, names) refute it.

Defined results: null and empty texts have no licence; empty tables give empty ones; of templates that save alike the first one is confirmed first, which changes nothing
in the end, as of places that overlap the longest stands (of equally long ones that of the lesser start, end and name); a template found twice in a text counts once in `licenses`, each
occurrence in `spans`; texts of any length are read whole; repeated rows each get their row; other columns pass through
and those named like an output are replaced.

Scale: one pass without a shuffle; the templates are a fixed list.
"""

from __future__ import annotations

import bisect
import difflib
import re
from itertools import islice
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stoichion.llm.textbytes import map_texts

# Identifiers of licences in tags; names and wordings of licences and licence notices.
SPDX = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-3.0-only", "AGPL-3.0-only", "MPL-2.0", "ISC", "Zlib", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0"]
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("MIT", "under the terms of the MIT license"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    *((name, f"SPDX-License-Identifier: {name}") for name in SPDX),
]
#: Words whose change makes it another licence.
TELLING = re.compile(r"\d|^(mit|apache|gnu|general|lesser|affero|mozilla|cc|by|nc|sa|nd|cc0|bsd|isc|v|version|not|without|only|later|clause|zlib)$")
ALLOWED = 0.1
#: The part of its own compressed size that a template must save to be confirmed.
WON = 0.1
#: The same with and without a dictionary, or sizes say nothing.
_ZSTD = {"window_log": 17, "chain_log": 13, "hash_log": 13, "search_log": 3, "min_match": 4, "target_length": 8, "strategy": zstandard.STRATEGY_LAZY, "write_content_size": 0, "write_dict_id": 0}

_HINT = re.compile(r"licen[cs]|copyright|warrant|redistribut|permission|subject to the terms|unencumbered", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]
    bag: frozenset[str]
    data: bytes


def _templates(rows: list[tuple[str, str]]) -> list[Template]:
    own = [(name, tuple(w.lower() for w in _WORD.findall(text)), text) for name, text in rows]
    return [Template(name, words, frozenset(words), text.lower().encode()) for name, words, text in own if words]


class Scanner:
    """Finds templates in single texts; windows met before are taken from a bounded cache."""

    def __init__(self, rows: list[tuple[str, str]] | None = None) -> None:
        self.templates = _templates(TEMPLATES if rows is None else rows)
        #: Numbers of the templates of each size: up to 32 words, up to 64, up to 128, ...
        self.sizes_of: list[list[int]] = []
        of = lambda t: max(0, (len(t.words) - 1).bit_length() - 5)
        for size in sorted({of(t) for t in self.templates}):
            self.sizes_of.append([i for i, t in enumerate(self.templates) if of(t) == size])
        self.longest = [max(len(self.templates[i].words) for i in own) for own in self.sizes_of]
        self.plain = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(**_ZSTD))
        self.own = [self._compressor(t.data) for t in self.templates]
        self.sizes = [len(self.plain.compress(t.data)) for t in self.templates]
        self.known: dict[tuple[int, str], list[tuple[int, int, str]]] = {}

    @staticmethod
    def _compressor(data: bytes) -> zstandard.ZstdCompressor:
        prefix = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(dict_data=prefix, compression_params=zstandard.ZstdCompressionParameters(**_ZSTD))

    def ranked(self, window: str, size: int = 0) -> list[int]:
        """The winners of a size: templates that save enough of a window's compressed size, the greatest part of the template's own first."""
        data = window.lower().encode()
        alone = len(self.plain.compress(data))
        saved = {i: (alone - len(self.own[i].compress(data))) / self.sizes[i] for i in self.sizes_of[size]}
        return sorted((i for i, part in saved.items() if part >= WON), key=lambda i: (-saved[i], i))

    def confirmed(self, template: Template, words: list[str]) -> list[tuple[int, int]]:
        """First and last (exclusive) words of the places where the template stands, its wording near enough; of those that overlap, the nearest."""
        n, slack, found = len(template.words), int(ALLOWED * len(template.words)), []
        at: dict[str, list[int]] = {w: [] for w in template.bag}
        for i, w in enumerate(words):
            if w in at:
                at[w].append(i)
        # So many words of the template that one of them stands unchanged in any place that passes, those that are rarest here.
        rare = sorted(range(n), key=lambda p: (len(at[template.words[p]]), p))[: slack + 1 + sum(not at[w] for w in template.words)]
        starts = sorted({max(0, i - p) for p in rare for i in at[template.words[p]]})
        done = -1
        for start in starts:
            if start <= done:
                continue
            low = max(0, start - slack)
            part = words[low : start + n + 3 * slack]
            done = start + slack
            if sum(w in template.bag for w in part) < n - slack:
                continue
            ops = [x for x in difflib.SequenceMatcher(None, template.words, part, autojunk=False).get_opcodes() if x[0] != "equal"]
            first, end = 0, len(part)
            if ops and ops[0][2] == 0:  # words before the template
                first = ops.pop(0)[4]
            if ops and ops[-1][1] == n:  # words after it
                end = ops.pop()[3]
            changed = sum(max(x[2] - x[1], x[4] - x[3]) for x in ops)
            told = any(TELLING.search(w) for x in ops for w in (*template.words[x[1] : x[2]], *part[x[3] : x[4]]))
            if not told and changed <= slack:
                found.append((changed, low + first, low + end))
        kept: list[tuple[int, int]] = []
        for _, a, b in sorted(found):
            if all(b <= x or a >= y for x, y in kept):
                kept.append((a, b))
        return kept

    @staticmethod
    def _before(text: str, at: int, reach: int) -> int:
        """Where the words begin that a template with a word at this place can take before it."""
        size = 16 * (reach + 1)
        while True:
            start = max(0, at - size)
            words = [m.start() for m in _WORD.finditer(text, start, at)]
            if len(words) > reach:  # the first one may be cut
                return words[-reach]
            if not start:
                return 0
            size *= 2

    @staticmethod
    def _after(text: str, at: int, reach: int) -> int:
        """Where the words end that a template with a word at this place can take after it."""
        return max((m.end() for m in islice(_WORD.finditer(text, at), reach + 1)), default=at)

    def blocks(self, text: str, size: int = 0) -> list[tuple[int, str]]:
        """(offset, block) of the candidates for templates of a size: mandatory words with what a template may take on either side of them."""
        reach = self.longest[size] + max(1, int(ALLOWED * self.longest[size]))
        out: list[tuple[int, str]] = []
        start, end, last = 0, -1, 0
        for hit in _HINT.finditer(text):
            if 0 <= end <= hit.start():
                end = self._after(text, last, reach)
            if end <= hit.start():
                before = self._before(text, hit.start(), reach)
                if end < 0:
                    start = before
                elif end <= before:
                    out.append((start, text[start:end]))
                    start = before
                end = self._after(text, hit.start(), reach)
            last = hit.start()
        if end >= 0:
            out.append((start, text[start : self._after(text, last, reach)]))
        return out

    def window(self, window: str, size: int) -> list[tuple[int, int, str]]:
        found = self.known.get((size, window))
        if found is None:
            at = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(window)]
            words = [x[0] for x in at]
            found = []
            for i in self.ranked(window, size):
                found += [(at[a][1], at[b - 1][2], self.templates[i].name) for a, b in self.confirmed(self.templates[i], words)]
            if len(window) <= 4000:
                if len(self.known) > 5000:
                    self.known.clear()
                self.known[size, window] = found
        return found

    def block(self, block: str, size: int) -> list[tuple[int, int, str]]:
        """What stands in a block, by windows of words; a place in two windows may come twice."""
        found, at, step = [], [m.span() for m in _WORD.finditer(block)], 2 * self.longest[size]
        for i in range(0, max(1, len(at) - step), max(1, step)):
            part = at[i : i + 2 * step]
            if part:
                start = part[0][0]
                found += [(start + a, start + b, name) for a, b, name in self.window(block[start : part[-1][1]], size)]
        return found

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, name) in characters; where templates overlap, the longest stands."""
        found = [(at + a, at + b, name) for size in range(len(self.sizes_of)) for at, block in self.blocks(text or "", size) for a, b, name in self.block(block, size)]
        kept: list[tuple[int, int, str]] = []
        for x in sorted(found, key=lambda x: (x[0] - x[1], x)):
            i = bisect.bisect(kept, x)
            if (not i or kept[i - 1][1] <= x[0]) and (i == len(kept) or x[1] <= kept[i][0]):
                kept.insert(i, x)
        return kept


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string())]))
FIELDS = [
    T.StructField("licenses", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("license", T.StringType())]))),
]


def scan(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None, drop_text: bool = True) -> DataFrame:
    """docs with licenses (sorted names) and spans (characters, end exclusive) of the licences in its text."""

    def make():
        scanner = Scanner(templates)

        def work(texts: pa.Array, _: pa.RecordBatch) -> dict[str, pa.Array]:
            found = [scanner.spans(x) for x in texts.to_pylist()]
            return {
                "licenses": pa.array([sorted({x[2] for x in own}) for own in found], pa.list_(pa.string())),
                "spans": pa.array([[{"start": a, "end": b, "license": n} for a, b, n in own] for own in found], _SPAN),
            }

        return work

    return map_texts(docs, make, FIELDS, text, drop_text)
