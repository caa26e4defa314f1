"""License scan by conditional compression.

A candidate block is a run of cue words and the words around them: on either side as many as the longest
template with its error budget has, whatever lines and paragraphs they stand in. Each template is a raw zstandard dictionary: the
bytes that a block saves when compressed with it rank the templates. Every template that saves
more than chance could, best first, is confirmed by its wording: its words are aligned with the
closest run of the block's words, and it wins if at most ``DIFFERENT`` of its words differ and none
of the words that tell licenses apart; the differing words are reported. Words that tell a template
apart come from comparing the templates: of two that one text could both match, those that only one
of them has. The words before and after a hit are searched again until no run is close enough, so
every notice of a license is reported. Of finds that overlap, the one with the fewest differing words
stays, then the longest; templates that fit one run equally well are all reported.

Defined cases: null or empty text has no blocks; blocks that overlap report a notice once; equal
templates under two names are both reported; a null template is ignored; repeated rows are
answered one by one; extra columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.decontaminate import best_match

#: Share of a template's words that may differ.
DIFFERENT = 0.1
#: Share of a template's own compressed size that a block must save to be compared by wording.
SAVED = 0.3
LEVEL = 12
CUES = ("licen", "copyright", "permission", "warrant", "redistribut", "public domain")
FOUND = (
    "array<struct<license:string,begin:int,stop:int,plain:int,conditional:int,saved:int,"
    "n_different:int,missing:array<string>,added:array<string>>>"
)

# What the BSD licenses share.
_BSD_BOTH = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
    "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution."
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED."
)
# The notices that the licenses themselves ask for, and common one-line forms.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS "
        "OF ANY KIND, either express or implied.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "LGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version.",
    ),
    (
        "LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version.",
    ),
    (
        "AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version.",
    ),
    (
        "BSD-2-Clause",
        f"{_BSD_BOTH} {_BSD_END}",
    ),
    (
        "BSD-3-Clause",
        f"{_BSD_BOTH} Neither the name of the copyright holder nor the names of its contributors may be used to "
        f"endorse or promote products derived from this software without specific prior written permission. {_BSD_END}",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    (
        "CC-BY-NC-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    (
        "CC-BY-NC-ND-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
]

_CUE = re.compile("|".join(CUES))
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words(text: str) -> list[tuple[str, int, int]]:
    """(lower-case word, begin, stop) without punctuation; 2.0 and BY-NC are words."""
    return [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def blocks(text: str, most: int) -> Iterator[tuple[int, int]]:
    """(begin, stop) of the candidate blocks; ``most`` is the number of words a block needs."""
    lower = text.lower()
    if len(lower) != len(text) or not any(cue in lower for cue in CUES):  # lower() may lengthen a text
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        if not any(cue in lower for cue in CUES):
            return
    spans = [m.span() for m in _WORD.finditer(text)]
    starts = [begin for begin, _ in spans]
    at = sorted({bisect_right(starts, m.start()) - 1 for m in _CUE.finditer(lower)} - {-1})
    i = 0
    while i < len(at):
        j = bisect_right(at, at[i] + most) - 1  # cues close together share a block
        yield spans[max(0, at[i] - most)][0], spans[min(len(spans), at[j] + most + 1) - 1][1]
        i = j + 1


def telling_words(templates: list[tuple[str, list[str], int]]) -> list[tuple[set[str], set[str]]]:
    """Per template (name, words, budget): the words it needs, and those that other licenses have instead.

    Only templates near enough for one text to be within the budgets of both are compared.
    """
    out: list[tuple[set[str], set[str]]] = [(set(), set()) for _ in templates]
    for i, (name, own, budget) in enumerate(templates):
        for other_name, other, other_budget in templates:
            if name == other_name or abs(len(own) - len(other)) > budget + other_budget:
                continue
            pairs = difflib.SequenceMatcher(None, own, other, autojunk=False).get_opcodes()
            missing = [w for kind, a, b, _, _ in pairs if kind != "equal" for w in own[a:b]]
            added = [w for kind, _, _, a, b in pairs if kind != "equal" for w in other[a:b]]
            if max(len(missing), len(added)) <= budget + other_budget:
                out[i][0].update(set(missing) - set(other))
                out[i][1].update(set(added) - set(own))
    return out


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], different: float = DIFFERENT) -> None:
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.templates = []
        for name, text in templates:
            own = [w for w, _, _ in words(text)]
            if own:
                data = text.encode()
                by = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                press = zstandard.ZstdCompressor(level=LEVEL, dict_data=by, write_content_size=False)
                least = SAVED * (len(self.plain.compress(data)) - len(press.compress(data)))
                self.templates.append((name, own, press, least, int(different * len(own))))
        self.telling = telling_words([(name, own, budget) for name, own, _, _, budget in self.templates])
        self.most = max((len(own) + budget for _, own, _, _, budget in self.templates), default=0)

    def ranked(self, block: bytes) -> list[tuple[int, int, int]]:
        """(bytes saved, compressed size, template number), best first, of those that save enough."""
        size = len(self.plain.compress(block))
        out = []
        for i, (_, _, press, least, _) in enumerate(self.templates):
            conditional = len(press.compress(block))
            if size - conditional >= least:
                out.append((size - conditional, conditional, i))
        return sorted(out, key=lambda x: (-x[0], x[2]))

    def confirm(self, own: list[str], there: list[str], budget: int) -> tuple[int, int, list[str], list[str]] | None:
        """Words [begin, stop) of the closest run, and the template's missing and the run's added words."""
        code = {w: chr(0xE000 + i) for i, w in enumerate(dict.fromkeys(own))}
        run = "".join(code.get(w, "\0") for w in there)
        match = best_match("".join(code[w] for w in own), run, budget)
        if not match:
            return None
        stop = match[1]
        back = best_match("".join(code[w] for w in reversed(own)), run[max(0, stop - len(own) - budget) : stop][::-1], budget)
        begin = stop - back[1] if back else stop - len(own)
        pairs = difflib.SequenceMatcher(None, own, there[begin:stop], autojunk=False).get_opcodes()
        missing = [w for kind, a, b, _, _ in pairs if kind != "equal" for w in own[a:b]]
        added = [w for kind, _, _, a, b in pairs if kind != "equal" for w in there[begin + a : begin + b]]
        return begin, stop, missing, added

    def every(self, own: list[str], there: list[str], budget: int) -> Iterator[tuple[int, int, list[str], list[str]]]:
        """All runs within the budget that do not overlap: the closest, then those on both sides of it."""
        rest = [(0, len(there))]
        while rest:
            lo, hi = rest.pop()
            found = self.confirm(own, there[lo:hi], budget) if hi - lo >= len(own) - budget else None
            if found and found[0] < found[1]:
                a, b = lo + found[0], lo + found[1]
                yield a, b, *found[2:]
                rest += [(lo, a), (b, hi)]

    def scan(self, text: str) -> list[dict]:
        found = []
        for begin, stop in blocks(text, self.most):
            block = text[begin:stop]
            data, there = block.encode(), words(block)
            plain = [w for w, _, _ in there]
            for saved, conditional, number in self.ranked(data):
                name, own, _, _, budget = self.templates[number]
                needed, foreign = self.telling[number]
                for a, b, missing, added in self.every(own, plain, budget):
                    if needed.intersection(missing) or foreign.intersection(added):
                        continue  # another license, or another version of this one
                    row = {
                        "license": name, "begin": begin + there[a][1], "stop": begin + there[b - 1][2],
                        "plain": saved + conditional, "conditional": conditional, "saved": saved,
                        "n_different": max(len(missing), len(added)), "missing": missing, "added": added,
                    }
                    found.append((row["n_different"], a - b, row["begin"], number, row))
        return self.closest(found)

    @staticmethod
    def closest(found: list[tuple[int, int, int, int, dict]]) -> list[dict]:
        """Of overlapping finds (differing words, minus length, begin, template, row) the first in order.

        Finds of other licenses on the same words with as few differences stay beside it. Kept
        finds do not overlap otherwise, so the nearest on either side decides.
        """
        spans: list[tuple[int, int]] = []
        rows: dict[tuple[int, int], list[dict]] = {}
        for n_different, _, begin, _, row in sorted(found, key=lambda x: x[:4]):
            span = (begin, row["stop"])
            if span in rows:
                kept = rows[span]
                if kept[0]["n_different"] == n_different and all(r["license"] != row["license"] for r in kept):
                    kept.append(row)
                continue
            at = bisect_right(spans, span)
            if (at == 0 or spans[at - 1][1] <= begin) and (at == len(spans) or row["stop"] <= spans[at][0]):
                insort(spans, span)
                rows[span] = [row]
        return [row for span in spans for row in rows[span]]


def find(docs: DataFrame, templates: list[tuple[str, str]] | None = None, different: float = DIFFERENT) -> DataFrame:
    """``docs`` with ``licenses``: the notices found, by place in the text.

    The templates are a parameter held by every task; they do not grow with the documents.
    """
    known = [(n, t) for n, t in (TEMPLATES if templates is None else templates) if t is not None]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(known, different)
        for texts in batches:
            yield pd.Series([scanner.scan(t) if isinstance(t, str) else [] for t in texts])

    return docs.drop("licenses").withColumn("licenses", F.pandas_udf(run, FOUND)(F.col("text").cast("string")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, licenses (distinct names), n_notices, saved, n_different, begins and stops."""
    return find(docs.select("doc_id", "text")).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.array_sort(F.array_distinct("licenses.license")).alias("licenses"),
        F.size("licenses").cast("long").alias("n_notices"),
        F.col("licenses.begin").alias("begins"),
        F.col("licenses.stop").alias("stops"),
        F.col("licenses.saved").alias("saved"),
        F.col("licenses.n_different").alias("n_different"),
    )
