"""Licence scans by sentence rules.

A text is cut into sentences at line ends and at full stops, question and exclamation marks,
semicolons and colons before white space. A normalised sentence (lower case, letters and digits
only, single spaces) that is one of the known licence sentences, or ends with one, stands for that
sentence's identifier; all others stand for nothing. Pieces of one paragraph that only a line end parts
are also read as one, so sentences that are wrapped over lines are known; the longest such sentence
that ends with a piece counts. A sentence that only ends with a known one doesn't count if one of the
last NEAR words before that negates it. A line's SPDX-License-Identifier is one sentence, whose identifiers are
the licences of its expression, if that can be read. Enumerators that begin a sentence (1.) or a line (a.) aren't sentences. Licence rules are ordered sequences of identifiers: the
first rule in the list whose sequence occurs, at consecutive sentences of the text, claims these
sentences, then the next rule is tried on what is left.

Defined results: null and empty texts hold no licence; repeated rows give repeated rows; a text in
which one rule matches several times has one row for it with the number of matches; sentence numbers
count from 0 over the non-empty pieces, so one that is wrapped over lines has a number for each; empty
tables give empty results; texts of any length are read whole, one at a time; of rules that could claim
a sentence the first in the list does, ties don't occur; columns besides doc_id and text aren't read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

#: Sentences of public licences and of notices that name them, by identifier.
SENTENCES: dict[str, list[str]] = {
    "mit-notice": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "This software is released under the MIT License."],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "as-is-software": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "apache-notice": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\")", "This project is licensed under the Apache License, Version 2.0."],
    "apache-compliance": ["you may not use this file except in compliance with the License."],
    "apache-obtain": ["You may obtain a copy of the License at"],
    "apache-as-is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd-notice": ["Licensed under the BSD 3-Clause License."],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "This program is licensed under the GNU General Public License, version 3."],
    "gpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl2-notice": ["Licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU General Public License, version 2."],
    "lgpl-notice": ["Licensed under the GNU Lesser General Public License, version 3."],
    "mpl-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-nc-notice": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-notice": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-notice": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0-notice": ["Licensed under CC0 1.0."],
    "lgpl-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "gpl2-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "agpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-title": ["GNU GENERAL PUBLIC LICENSE"],
    "lgpl-title": ["GNU LESSER GENERAL PUBLIC LICENSE"],
    "agpl-title": ["GNU AFFERO GENERAL PUBLIC LICENSE"],
    "gnu-version-2": ["Version 2, June 1991"],
    "gnu-version-2.1": ["Version 2.1, February 1999"],
    "gnu-version-3": ["Version 3, 29 June 2007"],
    "gnu-version-3-affero": ["Version 3, 19 November 2007"],
    "gpl3-preamble": ["The GNU General Public License is a free, copyleft license for software and other kinds of works."],
    "agpl3-preamble": ["The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."],
    "lgpl3-preamble": ["This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."],
    "apache-title": ["Apache License"],
    "apache-version": ["Version 2.0, January 2004"],
    "apache-grant": ["Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."],
    "mpl-title": ["Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"],
    "mpl-obtain": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-liability": ["In no event will the authors be held liable for any damages arising from the use of this software."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "epl2-title": ["Eclipse Public License - v 2.0"],
    "epl2-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "bsl-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"],
    "bsl-notice": ["Distributed under the Boost Software License, Version 1.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: In this order: the licence and the sentence identifiers that follow one another in it.
RULES: list[tuple[str, str, list[str]]] = [
    ("mit-text", "MIT", ["mit-grant", "mit-condition", "as-is-software"]),
    ("mit-text-part", "MIT", ["mit-grant", "mit-condition"]),
    ("bsd-3-text", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("bsd-2-text", "BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("apache-header", "Apache-2.0", ["apache-notice", "apache-compliance", "apache-obtain"]),
    ("apache-header-part", "Apache-2.0", ["apache-notice", "apache-compliance"]),
    ("apache-notice", "Apache-2.0", ["apache-notice"]),
    ("mit-notice", "MIT", ["mit-notice"]),
    ("bsd-notice", "BSD-3-Clause", ["bsd-notice"]),
    ("gpl3-later", "GPL-3.0-or-later", ["gpl3-later"]),
    ("gpl3-notice", "GPL-3.0-only", ["gpl3-notice"]),
    ("gpl2-notice", "GPL-2.0-only", ["gpl2-notice"]),
    ("lgpl3-notice", "LGPL-3.0-only", ["lgpl-notice"]),
    ("mpl-notice", "MPL-2.0", ["mpl-notice"]),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("cc-by-notice", "CC-BY-4.0", ["cc-by-notice"]),
    ("cc0-notice", "CC0-1.0", ["cc0-notice"]),
    ("unlicense", "Unlicense", ["unlicense"]),
    ("gpl3-text", "GPL-3.0-only", ["gpl-title", "gnu-version-3"]),
    ("gpl3-preamble", "GPL-3.0-only", ["gpl3-preamble"]),
    ("gpl2-text", "GPL-2.0-only", ["gpl-title", "gnu-version-2"]),
    ("gpl2-later", "GPL-2.0-or-later", ["gpl2-later"]),
    ("lgpl3-text", "LGPL-3.0-only", ["lgpl-title", "gnu-version-3"]),
    ("lgpl3-preamble", "LGPL-3.0-only", ["lgpl3-preamble"]),
    ("lgpl21-text", "LGPL-2.1-only", ["lgpl-title", "gnu-version-2.1"]),
    ("lgpl21-later", "LGPL-2.1-or-later", ["lgpl-later"]),
    ("agpl3-text", "AGPL-3.0-only", ["agpl-title", "gnu-version-3-affero"]),
    ("agpl3-preamble", "AGPL-3.0-only", ["agpl3-preamble"]),
    ("agpl3-later", "AGPL-3.0-or-later", ["agpl3-later"]),
    ("apache-text", "Apache-2.0", ["apache-title", "apache-version"]),
    ("apache-grant", "Apache-2.0", ["apache-grant"]),
    ("mpl-text", "MPL-2.0", ["mpl-title"]),
    ("mpl-obtain", "MPL-2.0", ["mpl-obtain"]),
    ("isc-text", "ISC", ["isc-grant"]),
    ("0bsd-text", "0BSD", ["0bsd-grant"]),
    ("zlib-text", "Zlib", ["zlib-as-is", "zlib-liability", "zlib-grant"]),
    ("epl2-text", "EPL-2.0", ["epl2-title"]),
    ("epl2-notice", "EPL-2.0", ["epl2-notice"]),
    ("bsl-text", "BSL-1.0", ["bsl-grant"]),
    ("bsl-notice", "BSL-1.0", ["bsl-notice"]),
]

_CUT = re.compile(r"\n+|(?<=[.!?;:])\s+")
_ENUMERATOR = re.compile(r"[\W_]*(?:\d{1,3}|([a-z]|[ivx]{1,5}))[.:]", re.IGNORECASE)
_NOT_WORD = re.compile(r"[^0-9a-z]+")
#: So many words before a known sentence are looked at for these, or for a contracted "not".
NEAR = 4
NEGATIONS = frozenset("not no never neither nor without cannot".split())
#: A licence expression after its tag, to the end of the line or of what closes a comment.
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
_SPDX_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.:+-]*)")
SPDX_RULE = "spdx"


def expression(text: str) -> list[str]:
    """The licences that a licence expression names, in order, each once; none if it can't be read. A
    licence WITH an exception is one. What follows the expression on its line must not be words."""
    tokens, at = [], 0
    while m := _SPDX_TOKEN.match(text, at):
        tokens.append(m[1])
        at = m.end()
    if re.match(r"[ \t]*\w", text[at:]):
        return []
    found: list[str] = []
    depth, wants = 0, True
    for i, t in enumerate(tokens):
        word = t.upper()
        if wants:
            if t == "(":
                depth += 1
            elif t == ")" or word in ("AND", "OR", "WITH"):
                return []
            else:
                found.append(t)
                wants = False
        elif t == ")" and depth:
            depth -= 1
        elif word in ("AND", "OR"):
            wants = True
        elif word == "WITH" and i + 1 < len(tokens) and tokens[i - 1] not in "()":
            found[-1] += f" WITH {tokens[i + 1]}"
            tokens[i + 1] = ""
        elif t:
            return []
    if wants or depth or {f.upper() for f in found} & {"NONE", "NOASSERTION"}:
        return []
    return list(dict.fromkeys(found))


def _negated(before: str) -> bool:
    """Whether normalised words right before a known sentence say that it doesn't hold."""
    words = before.split()[-NEAR:]
    return any(w in NEGATIONS or w == "t" and i and words[i - 1].endswith("n") for i, w in enumerate(words))


def normalised(sentence: str) -> str:
    return _NOT_WORD.sub(" ", sentence.lower()).strip()


class Scanner:
    def __init__(self, sentences: dict[str, list[str]] = SENTENCES, rules: list[tuple[str, str, list[str]]] = RULES):
        self.known: dict[str, list[str]] = {}
        for name, texts in sentences.items():
            for text in texts:
                parts = [n for p in _CUT.split(text) if (n := normalised(p))]
                for i, part in enumerate(parts):
                    # a known text of several sentences is known by all of them, in order
                    self.known.setdefault(part, []).append(name if len(parts) == 1 else f"{name}/{i + 1}")
        self.sequences = {name: [tuple(x) for x in self._expanded(ids, sentences)] for name, _, ids in rules}
        self.licence = {name: licence for name, licence, _ in rules}
        self.longest = max(len(k) for k in self.known)
        # the last two words of each known sentence: what others end with is looked up by them
        self.by_end: dict[str, list[str]] = {}
        for k in self.known:
            self.by_end.setdefault(" ".join(k.split()[-2:]), []).append(k)

    def _expanded(self, ids: list[str], sentences: dict[str, list[str]]):
        """All sequences of sentence identifiers that a rule's identifiers stand for."""
        out: list[list[str]] = [[]]
        for name in ids:
            counts = {len([p for p in _CUT.split(t) if normalised(p)]) for t in sentences[name]}
            steps = [[name] if n == 1 else [f"{name}/{i + 1}" for i in range(n)] for n in sorted(counts)]
            out = [o + s for o in out for s in steps]
        return out

    def _pieces(self, text: str):
        """Normalised, for each piece that isn't empty, whether it goes on in the line after its
        neighbour's, and where it begins."""
        at, joined, begins = 0, False, True
        for cut in [*_CUT.finditer(text), None]:
            raw = text[at : cut.start() if cut else len(text)]
            n = normalised(raw)
            m = None if joined else _ENUMERATOR.fullmatch(raw.strip())
            if n and (not m or m[1] and not begins):
                yield n, joined, at
            if cut:
                joined = bool(n) and cut[0] == "\n" and raw.rstrip()[-1] not in ".!?;:"
                at, begins = cut.end(), "\n" in cut[0]

    def _longest(self, text: str, most: int) -> str | None:
        """The longest known sentence of at most so many characters that a normalised text is or ends with."""
        ends = self.by_end.get(" ".join(text.rsplit(" ", 2)[-2:]))
        if not ends:
            return None
        return max((k for k in ends if len(k) <= most and (k == text or text.endswith(" " + k) and not _negated(text[: -len(k)]))), key=len, default=None)

    def identifiers(self, text: str | None) -> list[tuple[int, int, frozenset]]:
        """First and last number and identifiers of each known sentence of a text; those of one first
        number from the longest to the shortest. Those of licence expressions are tuples."""
        out: list[tuple[int, int, frozenset]] = []
        before: list[str] = []  # what the sentence holds, piece by piece
        tagged = [(m.start(), m.end(), expression(m[1])) for m in _SPDX.finditer(text)] if text and "spdx" in text.lower() else []
        place = 0
        for number, (n, joined, begin) in enumerate(self._pieces(text or "")):
            while place < len(tagged) and tagged[place][1] <= begin:
                place += 1
            if place < len(tagged) and begin + len(n) > tagged[place][0]:
                # pieces of a tag's line are one sentence; they end what stands before
                start, _, names = tagged[place]
                if names and out and out[-1][2] == frozenset([(start, *names)]):
                    out[-1] = (out[-1][0], number, out[-1][2])
                elif names:
                    out.append((number, number, frozenset([(start, *names)])))
                before = [""]
                continue
            if not joined:
                before = []
            before.append(n)
            # what the lines before say decides whether it's negated
            best = self._longest(" ".join(before[-NEAR - 1 :]), len(n))
            if best:
                out.append((number, number, frozenset(self.known[best])))
            if len(before) > 1:
                # as many pieces as the longest known sentence can have
                k, size = len(before) - 1, len(n)
                if " ".join((before[-2] + " " + n).rsplit(" ", 2)[-2:]) in self.by_end:
                    while k > 0 and size <= self.longest:
                        k -= 1
                        size += len(before[k]) + 1
                    long, size = self._longest(" ".join(before[k:]), self.longest), len(n)
                    pieces = 1
                    while long and size < len(long):
                        pieces += 1
                        size += len(before[-pieces]) + 1
                    if long and pieces > 1:
                        out.append((number - pieces + 1, number, frozenset(self.known[long])))
        return sorted(out, key=lambda x: (x[0], -x[1]))

    def scan(self, text: str | None) -> list[tuple[str, str, int, int]]:
        """Rule, licence, first sentence number and count of matches, by first sentence. Expressions
        come before all rules: what they name is said, not recognised."""
        at: dict[int, list[tuple[int, frozenset]]] = {}
        for first, last, names in self.identifiers(text):
            at.setdefault(first, []).append((last, names))
        if not at:
            return []
        found: dict[tuple[str, str], list[int]] = {}
        taken: set[int] = set()
        for first in sorted(at):
            for last, names in at[first]:
                for name in names:
                    if isinstance(name, tuple):
                        taken.update(range(first, last + 1))
                        for licence in name[1:]:
                            found.setdefault((SPDX_RULE, licence), []).append(first)

        def end(start: int, sequence: tuple) -> int | None:
            """The last number of the sequence from a sentence on, if it's there and free."""
            for last, names in at.get(start, ()):
                if sequence[0] in names and taken.isdisjoint(range(start, last + 1)):
                    if (got := end(last + 1, sequence[1:]) if len(sequence) > 1 else last) is not None:
                        return got
            return None

        for rule, sequences in self.sequences.items():
            for sequence in sequences:
                for start in sorted(at):
                    if (last := end(start, sequence)) is not None:
                        taken.update(range(start, last + 1))
                        found.setdefault((rule, self.licence[rule]), []).append(start)
        return sorted(((*r, min(s), len(s)) for r, s in found.items()), key=lambda x: (x[2], x[0], x[1]))


_scanner: list[Scanner] = []


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, rule, license, first_sentence, n_matches of every licence that a whole text shows."""

    def run(batches):
        if not _scanner:
            _scanner.append(Scanner())
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for row in _scanner[0].scan(text):
                    at.append(i)
                    rows.append(row)
            cols = [batch.column("doc_id").take(pa.array(at, pa.int64()))]
            cols += [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "rule", "license", "first_sentence", "n_matches"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, rule string, license string, first_sentence long, n_matches long")
