"""Operator 8, licence scans with a generalised suffix automaton.

All licence templates' words go into one suffix automaton. A file is streamed through it: at each word the automaton knows
the longest stretch that ends there and occurs in some template (the matching statistics). Maximal stretches of LEAST words or
more are chained per template, in order in file and template, and a template whose words are covered enough gives its label.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import common

# The phrases that count wherever they stand, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Public notices and characteristic passages of well-known licences.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl-3": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "gpl-2": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "bsd-3": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nd": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc-by-nc-sa": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "cc-by-nc-nd": ["This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "cc0": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."],
    "agpl-3": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ],
    "bsd-2": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ],
    "epl-2": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "ofl": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "eupl": ["Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL"],
    "wtfpl": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
}

#: Words of the shortest stretch that counts, the share of a template's words that gives its label, and the most words of
#: the file between two stretches of one chain; the share of a chain's words that another label's chain must have to beat it.
LEAST, COVER, GAP, SAME = 3, 0.8, 12, 0.8
#: What parts words: A-Z become a-z, other ASCII than 0-9 and a-z becomes a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton over templates' word numbers; ends: the templates and places in them where a state's stretches end."""

    def __init__(self, templates: list[list[int]]):
        self.next, self.link, self.length, self.own = [{}], [-1], [0], [[]]
        for k, t in enumerate(templates):
            last = 0
            for at, c in enumerate(t):
                last = self._add(last, c)
                self.own[last].append((k, at + 1))
        self.ends = Ends(self)

    def _state(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.own.append([])
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        r = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = r
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = r
            p = self.link[p]
        return r

    def _add(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def stretches(self, ids: list[int], at: int) -> Iterator[tuple[int, int, int]]:
        """(end in file, length, state) of each maximal stretch of LEAST words or more; ids start at word `at` of the file."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        for i, c in enumerate(ids):
            if c in nxt[state]:
                state, n = nxt[state][c], n + 1
                continue
            if n >= LEAST:
                yield at + i, n, state
            while state and c not in nxt[state]:
                state = link[state]
            n = length[state]
            if c in nxt[state]:
                state, n = nxt[state][c], n + 1
            else:
                state = n = 0
        if n >= LEAST:
            yield at + len(ids), n, state


class Ends(dict):
    """A state's ends are its own and those of all states that link to it. They are gathered for the states that files reach, and as
    many as MOST are kept, so that the automaton stays linear in its templates."""

    MOST = 1_000_000

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.below: list[list[int]] = [[] for _ in automaton.link]
        for s, up in enumerate(automaton.link):
            if up > 0:
                self.below[up].append(s)
        self.own, self.n = automaton.own, 0

    def __missing__(self, state: int) -> list[tuple[int, int]]:
        out, todo = [], [state]
        while todo:
            s = todo.pop()
            out += self.own[s]
            todo += self.below[s]
        if self.n + len(out) > self.MOST:
            self.clear()
            self.n = 0
        self[state], self.n = out, self.n + len(out)
        return out


class Scanner:
    def __init__(self, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None):
        self.own = [(label, words(t)) for label, ts in (TEMPLATES if templates is None else templates).items() for t in ts]
        self.number: dict[bytes, int] = {}
        for _, t in self.own:
            for w in t:
                self.number.setdefault(w, len(self.number) + 1)
        self.automaton = Automaton([[self.number[w] for w in t] for _, t in self.own])
        self.phrases = [(words(p), label) for p, label in (PHRASES if phrases is None else phrases).items()]

    def base(self, ws: list[bytes]) -> list[tuple[int, str]]:
        """(start word, label) of every place where a phrase's words stand consecutively."""
        out = []
        for p, label in self.phrases:
            at = -1
            rare = max(range(len(p)), key=lambda k: len(p[k]))
            while True:
                try:
                    at = ws.index(p[rare], at + 1)
                except ValueError:
                    break
                if at >= rare and ws[at - rare : at - rare + len(p)] == p:
                    out.append((at - rare, label))
        return sorted(out)

    def spans(self, ws: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, start word, end word, share of the template covered) of every chain that covers COVER of a template; of chains of
        two labels over the same words, only the one that covers more words."""
        ids = list(map(self.number.get, ws))
        by: dict[int, list[tuple[int, int, int]]] = {}
        at, n = 0, len(ids)
        while at < n:  # runs of words that templates have; what is shorter than LEAST can't hold a stretch
            if ids[at] is None:
                at += 1
                continue
            end = at
            while end < n and ids[end] is not None:
                end += 1
            if end - at >= LEAST:
                for e, length, state in self.automaton.stretches(ids[at:end], at):
                    for k, t_end in self.automaton.ends[state]:
                        by.setdefault(k, []).append((e - length, t_end - length, length))
            at = end
        out = []
        for k, found in by.items():
            label, t = self.own[k]
            best: list[tuple[int, int]] = []  # words covered by the best chain up to each stretch; where that chain starts
            found.sort()
            for i, (f, p, length) in enumerate(found):
                cover, start, j = length, f, i - 1
                while j >= 0 and f - found[j][0] <= GAP + len(t):
                    f2, p2, l2 = found[j]
                    if f2 + l2 <= f <= f2 + l2 + GAP and p2 + l2 <= p and best[j][0] + length > cover:
                        cover, start = best[j][0] + length, best[j][1]
                    j -= 1
                best.append((cover, start))
            spans: list[list] = []
            for (f, _, length), (cover, start) in zip(found, best, strict=True):
                if cover >= COVER * len(t):
                    if spans and start < spans[-1][1]:
                        spans[-1] = [min(start, spans[-1][0]), max(f + length, spans[-1][1]), max(cover, spans[-1][2])]
                    else:
                        spans.append([start, f + length, cover])
            out += [(label, s, e, min(1.0, c / len(t)), c) for s, e, c in spans]
        out.sort(key=lambda x: (x[1], x[2], x[0]))
        beaten = set()
        for i, (label, s, e, _, c) in enumerate(out):
            for j in range(i + 1, len(out)):
                label2, s2, e2, _, c2 = out[j]
                if s2 >= e:
                    break
                if label2 != label and c2 != c:
                    less = i if c < c2 else j
                    if min(e, e2) - s2 >= SAME * (out[less][2] - out[less][1]):
                        beaten.add(less)
        return [x[:4] for k, x in enumerate(out) if k not in beaten]


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label:start:end in words, comma-joined).

    A row per input row. score is 1 where a phrase stands, else the largest share of a template that is covered, else 0. Null
    and empty texts have no words and no labels. Texts of any length are streamed whole. Other columns are ignored.
    """
    common.ship(docs.sparkSession)

    def make():
        scanner = Scanner(templates)

        def work(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words(text)
                base, spans = scanner.base(ws), scanner.spans(ws)
                own = {x[1] for x in base}
                score = 1.0 if base else max((s[3] for s in spans), default=0.0)
                rows.append((doc, len(ws), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)), ",".join(sorted(own | {s[0] for s in spans})), score, ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)))
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in SCANNED.split(", ")])

        return work

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return common.per_document(picked, make, SCANNED, ["doc_id", "text"])


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(common.table(spark, sf_dir, "documents"))


