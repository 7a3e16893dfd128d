"""Licence scans by patience alignment against templates.

Words that occur once in the text and once in the template anchor the alignment; the longest increasing subsequence of the anchors'
places keeps their order; the gaps between anchors are aligned in the same way, and what remains at their rims word by word. Coverage is
the share of the template's words that are aligned.

A copy may lack words up to the coverage, but no word that names a licence or its version, and may have foreign words between its own: up to
FOREIGN for each word of the template, so that the words of a long text do not add up to a notice. A text is looked at only if it has
enough of a template's distinct words to reach the coverage at all, which misses nothing. Copies are sought around each place of a pivot,
a word that the template has once: between the pivot's neighbouring places first, then further and further, as far as a copy can reach; with more
pivots than words that a copy may lack, one of them is in every copy. Where copies of several templates overlap, that with the best coverage counts, then the longer, then the first by name.

Defined results: null, empty and wordless texts have no licence; of several copies the best by coverage, then length of the template,
then name names the text; repeated rows are scanned alike; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm._common import id_type, map_slices, texts_of
from studylake.llm.decontaminate import words_of

#: Share of a template's words that must be aligned; foreign words inside a copy for each word of the template.
COVERAGE, FOREIGN = 0.8, 4
#: Words that name licences (fixed values); these and numbers must be aligned wherever a template has them.
NAMING = frozenset(b"mit apache gpl gnu lesser affero mozilla mpl bsd isc eclipse cc0 creative commons cc by nc sa attribution sharealike noncommercial neither unencumbered misrepresented library".split())

#: Template texts (fixed values): public notices, by SPDX identifier and form.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT/notice": "Released under the MIT License",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-4.0/short": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0",
}


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by piles."""
    tops: list[int] = []
    places: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before.append(places[pile - 1] if pile else -1)
        tops[pile : pile + 1] = [v]
        places[pile : pile + 1] = [i]
    out = []
    at = places[-1] if places else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Aligned places of two word sequences, by patience."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            pairs.append((k, m))
        if i == k or j == m:
            continue
        ours, theirs = Counter(a[i:k]), Counter(b[j:m])
        place = {w: at for at, w in enumerate(b[j:m], j) if theirs[w] == 1}
        anchors = [(at, place[w]) for at, w in enumerate(a[i:k], i) if ours[w] == 1 and w in place]
        kept = [anchors[n] for n in increasing([y for _, y in anchors])]
        for x, y in kept:
            todo.append((i, x, j, y))
            pairs.append((x, y))
            i, j = x + 1, y + 1
        if kept:
            todo.append((i, k, j, m))
    return sorted(pairs)


class Template:
    def __init__(self, name: str, text: str):
        self.name = name
        self.words = words_of(text.encode())
        self.distinct = frozenset(self.words)
        self.naming = frozenset(w for w in self.distinct if w in NAMING or w.isdigit())
        self.once = {w: self.words.index(w) for w, n in Counter(self.words).items() if n == 1}

    def find(self, words: list[bytes], places: dict[bytes, list[int]], coverage: float) -> list[tuple[float, int, int]]:
        """Coverage, first and last word of each copy of the template in the text that reaches the coverage; they do not overlap.

        places: where each word stands. Around a place of a pivot the region between the pivot's neighbouring places is aligned first, for copies that
        follow one another; then, as long as no copy is found, the regions that reach over one, two, … neighbours on both sides, on the left and on
        the right alone, up to all that a copy can reach, for copies whose foreign words are words of the template.
        """
        size = len(self.words)
        lacking = int(size * (1 - coverage) + 1e-9)
        if not all(w in places for w in self.naming) or sum(w not in places for w in self.distinct) > lacking:
            return []
        reach = size * (1 + FOREIGN)
        found, taken = [], _Apart()
        for pivot in sorted((w for w in self.once if w in places), key=lambda w: (len(places[w]), w))[: lacking + 1]:
            at = places[pivot]
            for n, i in enumerate(at):
                if taken.holds(i, i):
                    continue
                low, high = max(i - reach, 0), min(i + reach, len(words))
                left = [low if x < 0 else max(low, at[x] + 1) for x in range(n - 1, bisect_left(at, low) - 2, -1)]
                right = [high if x >= len(at) else min(high, at[x]) for x in range(n + 1, bisect_left(at, high) + 1)]
                left, right = left or [low], right or [high]
                if left[-1] != low:
                    left.append(low)
                if right[-1] != high:
                    right.append(high)
                steps = max(len(left), len(right))
                tries = [(left[min(k, len(left) - 1)], right[min(k, len(right) - 1)]) for k in range(steps)]
                tries += [(x, right[0]) for x in left[1:]] + [(left[0], x) for x in right[1:]]
                for first, last in dict.fromkeys(tries):
                    if copy := self.copy(words, first, i, last, coverage):
                        found.append(copy)
                        taken.add(*copy[1:])
                        break
        return kept_apart(found, lambda f: (-f[0], f[1]), lambda f: f[1:])

    def copy(self, words: list[bytes], first: int, pivot: int, last: int, coverage: float) -> tuple[float, int, int] | None:
        """The copy around a place: aligned words left and right of the pivot, less those at the rims until it is no longer than a copy can be."""
        place = self.once[words[pivot]]
        before = [(i, first + j) for i, j in align(self.words[:place][::-1], words[first:pivot][::-1])]
        pairs = [(place - 1 - i, pivot - 1 - (j - first)) for i, j in before][::-1] + [(place, pivot)]
        pairs += [(place + 1 + i, pivot + 1 + j) for i, j in align(self.words[place + 1 :], words[pivot + 1 : last])]
        low, high = 0, len(pairs) - 1
        while pairs[high][1] - pairs[low][1] + 1 - (high - low + 1) > FOREIGN * len(self.words):
            # the rim with the wider gap to its neighbour goes
            if pairs[low + 1][1] - pairs[low][1] >= pairs[high][1] - pairs[high - 1][1]:
                low += 1
            else:
                high -= 1
        own = pairs[low : high + 1]
        named = self.naming <= {self.words[i] for i, _ in own}
        return (len(own) / len(self.words), own[0][1], own[-1][1]) if named and len(own) >= coverage * len(self.words) - 1e-9 else None


class _Apart:
    """Spans of words that do not overlap, by their starts."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, first: int, last: int) -> bool:
        """Whether a span meets one of these."""
        at = bisect_right(self.starts, last)
        return at > 0 and self.ends[at - 1] >= first

    def add(self, first: int, last: int) -> None:
        """Add a span; those that it meets are joined with it."""
        low, high = bisect_left(self.ends, first), bisect_right(self.starts, last)
        first, last = min([first, *self.starts[low:high]]), max([last, *self.ends[low:high]])
        self.starts[low:high], self.ends[low:high] = [first], [last]


def kept_apart(found: list, order, span) -> list:
    """The best by the order, then the next that does not overlap it, and so on; in the order of their places."""
    out, taken = [], _Apart()
    for f in sorted(found, key=order):
        if not taken.holds(*span(f)):
            taken.add(*span(f))
            out.append(f)
    return sorted(out, key=span)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """id_col, license (the best match, null without), coverage, n_matches, matches (array of name, coverage, first and last word)."""
    best_first = lambda x: (-x[1][0], -len(x[0].words), x[0].name, x[1][1])
    made = [Template(n, t) for n, t in (templates or TEMPLATES).items()]
    sought = frozenset(w for t in made for w in t.distinct)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        best, share, found = [], [], []
        for text in texts_of(part.column(1)):
            words = words_of(text)
            places: dict[bytes, list[int]] = {}
            for i, w in enumerate(words):
                if w in sought:
                    places.setdefault(w, []).append(i)
            all_ = kept_apart([(t, f) for t in made for f in t.find(words, places, coverage)], best_first, lambda x: x[1][1:])
            top = min(all_, key=best_first, default=None)
            best.append(top and top[0].name)
            share.append(round(top[1][0], 6) if top else 0.0)
            found.append([{"name": t.name, "coverage": round(f[0], 6), "first": f[1], "last": f[2]} for t, f in all_])
        kind = pa.list_(pa.struct([("name", pa.string()), ("coverage", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.string()), pa.array(share, pa.float64()), pa.array([len(f) for f in found], pa.int64()), pa.array(found, kind)], names=["id", "license", "coverage", "n_matches", "matches"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = map_slices(rows, 1, work, f"id {id_type(df, id_col)}, license string, coverage double, n_matches long, matches array<struct<name:string,coverage:double,first:int,last:int>>")
    return out.withColumnRenamed("id", id_col)
