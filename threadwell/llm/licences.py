"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame

from threadwell.llm.common import text_batches

#: Wordings of public licences and of the notices that name them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
_WORD = re.compile(r"[^\W_]+")


def bigrams(words: list[str]) -> Counter:
    """Word bigrams with their counts; a single word counts as one."""
    return Counter(zip(words, words[1:], strict=False)) if len(words) > 1 else Counter([tuple(words)] if words else [])


def dice(a: Counter, b: Counter) -> float:
    """2 * common / (size + size) of two bags of bigrams."""
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Matcher:
    """The best template for each stretch of words.

    A window of m bigrams and a template of n have Dice of 2 min(m, n) / (m + n) at most, so for the threshold t, m
    lies between n t / (2 - t) and n (2 - t) / t. A best window begins and ends with a bigram of its template: without
    one that is not, its Dice is higher. So for each template only its own bigrams' places are looked at, and ends are
    tried in order while the common part is counted on.
    """

    def __init__(self, templates: Mapping[str, tuple[str, ...]], threshold: float):
        self.threshold, self.share = threshold, threshold / (2 - threshold)
        self.templates = sorted(((bag.total(), name, bag) for name, texts in templates.items() for text in texts if (bag := bigrams(_WORD.findall(text.lower())))), key=lambda x: x[:2])
        self.holders: dict[tuple, list[int]] = {}
        for k, (_, _, bag) in enumerate(self.templates):
            for g in bag:
                self.holders.setdefault(g, []).append(k)

    def _windows(self, grams: list[tuple], k: int, places: list[int]) -> list[tuple[float, str, int, int]]:
        """(Dice, licence, first bigram, end) of the windows on template k that reach the threshold, over its places."""
        n, name, bag = self.templates[k]
        most, need = n / self.share + 1e-9, n * self.share - 1e-9
        out = []
        for i, a in enumerate(places):
            if i + need > len(places):  # fewer places are left than a window must hold
                break
            if places[min(i + max(int(need), 1), len(places)) - 1] - a + 1 > most:
                continue
            seen: Counter = Counter()
            common, best = 0, None
            for b in places[i:]:
                m = b - a + 1
                if m > most:
                    break
                g = grams[b]
                seen[g] += 1
                common += seen[g] <= bag[g]
                score = 2 * common / (m + n)
                if score >= self.threshold and (best is None or score >= best[0]):
                    best = (score, name, a, b + 1)
            if best:
                out.append(best)
        return out

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, Dice, first line, lines) of the non-overlapping best windows."""
        words: list[str] = []
        line_of: list[int] = []
        for i, line in enumerate(text.lower().split("\n")):
            own = _WORD.findall(line)
            words += own
            line_of += [i] * len(own)
        grams = list(zip(words, words[1:], strict=False))
        places: dict[int, list[int]] = {}
        for at, g in enumerate(grams):
            for k in self.holders.get(g, ()):
                places.setdefault(k, []).append(at)
        found = [w for k, own in places.items() if len(own) >= self.templates[k][0] * self.share - 1e-9 for w in self._windows(grams, k, own)]
        out: list[tuple[str, float, int, int]] = []
        taken: list[tuple[int, int]] = []
        for score, name, a, b in sorted(found, key=lambda x: (-x[0], x[2] - x[3], x[2], x[1])):
            if all(b < x or a > y for x, y in taken):  # a window of bigrams a to b has the words a to b
                taken.append((a, b))
                out.append((name, score, line_of[a], line_of[b] - line_of[a] + 1))
        return sorted(out, key=lambda x: x[2])


def scan(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, licence, dice, line_start, n_lines: one row for each place where a document holds a licence text.

    A place is a run of words, within lines or over several, whose bigrams reach the threshold with those of a
    template; of overlapping places the one with the highest Dice stays, then the longer, the earlier, the first by
    name. Lower-cased words of letters and digits count; line ends do not part bigrams. Null and empty texts give no
    rows, repeated rows give theirs again, an empty table gives none. Text shared with no template costs one
    tokenisation; no shuffle.
    """
    text_batches(docs.sparkSession)
    fixed = {k: tuple(v) for k, v in templates.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(fixed, threshold)
        for batch in batches:
            rows = [(i.as_py(), *x) for i, text in zip(batch.column(0), batch.column(1), strict=True) if (value := text.as_py()) for x in matcher.scan(value)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "licence", "dice", "line_start", "n_lines"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, licence string, dice double, line_start int, n_lines int")
