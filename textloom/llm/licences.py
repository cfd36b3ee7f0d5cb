"""Licence scans by sentence rules.

A text is cut where sentences end (``. ! ? ;`` before white space, ``:`` before a line end) and at line ends; a sentence is a run of
lines without a sentence end inside. Normalised, that is in lower case with everything but letters and digits as one blank,
it is looked up among known licence sentences, so wrapped licence texts, lists and single lines all match; of the runs that
begin at a line the longest known one counts. The identifiers found, in order, are then matched against licence rules: each
is a sequence of identifiers, rules are tried in their order (the more specific first), and what one takes no later rule
gets. Known sentences that no rule takes are reported under the rule ``sentence``.

Defined results: a null or empty text has no licence; texts are scanned whole; repeated rows give the same rows each; a null
doc_id stays null; an empty table gives an empty result; other columns take no part. ``begin`` and ``end`` are character
places of the first and behind the last sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Identifier -> sentences that have it. ``#`` stands for any number such as 2 or 2.0, ``*`` for any one to eight words.
SENTENCES: dict[str, tuple[str, ...]] = {
    "copyright": ("Copyright (c) *", "Copyright © *", "Copyright *", "(c) Copyright *", "Copyright (c) * All rights reserved"),
    "all-rights": ("All rights reserved",),
    "spdx-mit": ("SPDX-License-Identifier: MIT",),
    "spdx-apache": ("SPDX-License-Identifier: Apache-2.0",),
    "spdx-bsd3": ("SPDX-License-Identifier: BSD-3-Clause",),
    "spdx-bsd2": ("SPDX-License-Identifier: BSD-2-Clause",),
    "spdx-gpl2": ("SPDX-License-Identifier: GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"),
    "spdx-gpl3": ("SPDX-License-Identifier: GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "spdx-mpl": ("SPDX-License-Identifier: MPL-2.0",),
    "spdx-isc": ("SPDX-License-Identifier: ISC",),
    "mit-name": ("Released under the MIT License", "Licensed under the MIT License", "MIT License", "The MIT License (MIT)", "This project is licensed under the MIT License", "Distributed under the MIT License", "This software is released under the MIT License"),
    "mit-grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "mit-warranty": ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",),
    "mit-liability": ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",),
    "apache-name": ("Licensed under the Apache License, Version #", "Licensed under the Apache License Version # (the \"License\")", "Licensed under the Apache License, Version # (the \"License\");", "Apache License Version #", "Released under the Apache License, Version #", "This project is licensed under the Apache License #"),
    "apache-comply": ("you may not use this file except in compliance with the License.",),
    "apache-obtain": ("You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at:"),
    "apache-asis": ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "apache-limits": ("See the License for the specific language governing permissions and limitations under the License.",),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "bsd-endorse": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "bsd-name": ("Released under the BSD License", "Licensed under the BSD License", "Licensed under the BSD #-Clause License", "BSD #-Clause License"),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "gpl-name": ("This work is licensed under the GNU General Public License, version #", "Licensed under the GNU General Public License, version #", "Licensed under the GNU GPL, version #", "Released under the GNU General Public License", "GNU General Public License version #"),
    "gpl-grant": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version # of the License, or (at your option) any later version.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version # of the License, or (at your option) any later version."),
    "gpl-free": ("This program is free software:", "This program is free software;"),
    "gpl-terms": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version # of the License, or (at your option) any later version.", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"),
    "gpl-later": ("either version # of the License, or (at your option) any later version.",),
    "gpl-hope": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",),
    "gpl-implied": ("without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",),
    "gpl-details": ("See the GNU General Public License for more details.",),
    "gpl-copy": ("You should have received a copy of the GNU General Public License along with this program.",),
    "lgpl-name": ("Licensed under the GNU Lesser General Public License, version #", "GNU Lesser General Public License version #"),
    "agpl-name": ("Licensed under the GNU Affero General Public License, version #", "GNU Affero General Public License version #"),
    "mpl-grant": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. #", "Licensed under the Mozilla Public License, version #", "This Source Code Form is subject to the terms of the Mozilla Public License, v."),
    "cc-by": ("Licensed under CC BY #", "This work is licensed under a Creative Commons Attribution # International License"),
    "cc-by-sa": ("Licensed under CC BY-SA #", "This work is licensed under a Creative Commons Attribution-ShareAlike # International License"),
    "cc-by-nc": ("Licensed under CC BY-NC #", "This work is licensed under a Creative Commons Attribution-NonCommercial # International License"),
    "cc-by-nd": ("Licensed under CC BY-ND #", "This work is licensed under a Creative Commons Attribution-NoDerivatives # International License"),
    "cc-by-nc-sa": ("Licensed under CC BY-NC-SA #", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike # International License"),
    "cc-by-nc-nd": ("Licensed under CC BY-NC-ND #", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives # International License"),
    "cc0": ("Licensed under CC0 #", "Released under CC0 #", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "public-domain": ("This work is in the public domain", "Released into the public domain", "Public domain"),
    "boost": ("Distributed under the Boost Software License, Version #",),
    "wtfpl": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",),
    "zlib-asis": ("This software is provided 'as-is', without any express or implied warranty.",),
    "zlib-grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
    "proprietary": ("This software is proprietary and confidential", "Unauthorized copying of this file, via any medium, is strictly prohibited"),
}


class Rule(NamedTuple):
    name: str
    licence: str
    sentences: tuple[str, ...]


#: In the order in which they are tried.
RULES: tuple[Rule, ...] = tuple(
    Rule(name, licence, tuple(ids.split()))
    for name, licence, ids in (
        ("mit-full", "MIT", "mit-grant mit-notice mit-warranty mit-liability"),
        ("mit-named-full", "MIT", "mit-name copyright mit-grant"),
        ("mit-grant", "MIT", "mit-grant mit-notice"),
        ("mit-only-grant", "MIT", "mit-grant"),
        ("apache-header", "Apache-2.0", "apache-name apache-comply apache-obtain apache-asis apache-limits"),
        ("apache-short", "Apache-2.0", "apache-name apache-comply apache-obtain"),
        ("bsd-3", "BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-endorse"),
        ("bsd-2", "BSD-2-Clause", "bsd-grant bsd-source bsd-binary"),
        ("isc", "ISC", "isc-grant"),
        ("gpl-header", "GPL", "gpl-grant gpl-hope gpl-implied gpl-details gpl-copy"),
        ("gpl-split", "GPL", "gpl-free gpl-terms gpl-later gpl-hope gpl-implied gpl-details gpl-copy"),
        ("gpl-split-3", "GPL", "gpl-free gpl-terms gpl-hope gpl-implied gpl-details gpl-copy"),
        ("gpl-grant", "GPL", "gpl-grant"),
        ("gpl-terms", "GPL", "gpl-free gpl-terms"),
        ("zlib", "Zlib", "zlib-asis zlib-grant"),
        ("unlicense", "Unlicense", "unlicense"),
        ("mpl", "MPL-2.0", "mpl-grant"),
        ("apache-name", "Apache-2.0", "apache-name"),
        ("mit-name", "MIT", "mit-name"),
        ("bsd-name", "BSD", "bsd-name"),
        ("agpl-name", "AGPL", "agpl-name"),
        ("lgpl-name", "LGPL", "lgpl-name"),
        ("gpl-name", "GPL", "gpl-name"),
        *((k, v, k) for k, v in {"spdx-mit": "MIT", "spdx-apache": "Apache-2.0", "spdx-bsd3": "BSD-3-Clause", "spdx-bsd2": "BSD-2-Clause", "spdx-gpl2": "GPL", "spdx-gpl3": "GPL", "spdx-mpl": "MPL-2.0", "spdx-isc": "ISC"}.items()),
        *((k, k.upper().replace("CC-", "CC-"), k) for k in ("cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nc", "cc-by-nd", "cc-by-sa", "cc-by", "cc0")),
        ("public-domain", "public domain", "public-domain"),
        ("boost", "BSL-1.0", "boost"),
        ("wtfpl", "WTFPL", "wtfpl"),
        ("proprietary", "proprietary", "proprietary"),
        ("reserved", "all rights reserved", "copyright all-rights"),
        ("all-rights", "all rights reserved", "all-rights"),
    )
)

_WORD = re.compile(r"[^\W_]+")
_BOUND = re.compile(r"[.!?;]+(?=\s|$)|:(?=[^\S\n]*(?:\n|$))|\n")
_NUMBER = re.compile(r"\d+(?: \d+)*")


def normalise(sentence: str) -> str:
    return " ".join(_WORD.findall(sentence.lower()))


class Known:
    """The known sentences, by their normal form; those with wildcards as expressions under their first words."""

    def __init__(self, sentences: dict[str, tuple[str, ...]]):
        self.plain: dict[str, str] = {}
        self.open: dict[str, list[tuple[re.Pattern, str]]] = {}
        longest, words = 0, set()
        for name, forms in sentences.items():
            for form in forms:
                parts = re.split(r"([#*])", form.lower())
                pattern, begin = "", normalise(parts[0])
                for p in parts:
                    pattern = " ".join(filter(None, (pattern, {"#": r"\d+(?: \d+)*", "*": r"\S+(?: \S+){0,7}"}.get(p) or re.escape(normalise(p)))))
                longest = max(longest, len(normalise(form)) + 200 * form.count("*") + 20 * form.count("#"))
                words.add(begin.split()[0])
                if len(parts) == 1:
                    self.plain[begin] = name
                else:
                    self.open.setdefault(begin.split()[0], []).append((re.compile(pattern), name))
        #: No known sentence has more characters than this, once normalised, nor begins with another word.
        self.longest, self.begins = longest, frozenset(words)
        self.any_begin = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(map(re.escape, words), key=len, reverse=True)) + r")(?![^\W_])")

    def lookup(self, normal: str) -> str | None:
        if (name := self.plain.get(normal)) is not None:
            return name
        for pattern, name in self.open.get(normal.partition(" ")[0], ()):
            if pattern.fullmatch(normal):
                return name
        return None

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """Identifier, begin and end of each known sentence."""
        low = text.lower()
        if len(low) != len(text):  # places must be those of the text
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        if not self.any_begin.search(low):
            return []
        pieces: list[tuple[int, int, bool]] = []
        at = 0
        for m in _BOUND.finditer(low):
            pieces.append((at, m.start(), m.group() != "\n"))
            at = m.end()
        pieces.append((at, len(low), True))
        out, k = [], 0
        while k < len(pieces):
            first = _WORD.search(low, pieces[k][0], pieces[k][1])
            took = 0
            if first and first.group() in self.begins:
                parts, size, j = [], 0, k
                while j < len(pieces):
                    begin, end, sentence_end = pieces[j]
                    if end - begin > 8 * self.longest:
                        break
                    normal = normalise(low[begin:end])
                    size += len(normal) + 1
                    if size > self.longest + 1:
                        break
                    if normal:
                        parts.append(normal)
                    if name := self.lookup(" ".join(parts)):
                        took = j - k + 1
                        best = (name, first.start(), end)
                    if sentence_end:
                        break
                    j += 1
            if took:
                out.append(best)
            k += took or 1
        return out


def match_rules(found: list[tuple[str, int, int]], rules: tuple[Rule, ...]) -> list[tuple[str, str, int, int, int]]:
    """Licence, rule, begin, end and number of sentences of each match, in order of the text."""
    names = [n for n, _, _ in found]
    free = [True] * len(found)
    have, out = set(names), []
    for rule in rules:
        if not have.issuperset(rule.sentences):
            continue
        n = len(rule.sentences)
        for k in range(len(names) - n + 1):
            if tuple(names[k : k + n]) == rule.sentences and all(free[k : k + n]):
                free[k : k + n] = [False] * n
                out.append((rule.licence, rule.name, found[k][1], found[k + n - 1][2], n))
    out += [(name, "sentence", begin, end, 1) for (name, begin, end), f in zip(found, free) if f]
    return sorted(out, key=lambda x: (x[2], x[3], x[1]))


MATCHES = "doc_id long, licence string, rule string, begin int, end int, sentences int"


def scan(docs: DataFrame, sentences: dict[str, tuple[str, ...]] | None = None, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """A row for each licence found in each document."""
    sentences, rules = SENTENCES if sentences is None else sentences, RULES if rules is None else rules

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(sentences)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if text and (found := known.find(text)):
                    rows += [(doc, *m) for m in match_rules(found, rules)]
            columns = zip(*rows) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "licence", "rule", "begin", "end", "sentences"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scanned, MATCHES)
