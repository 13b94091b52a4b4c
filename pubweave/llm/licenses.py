"""Licence scan: passages of a text against licence templates.

Texts and templates are normalised to words of letters and digits in lower case.  A
passage and a template are compared by the Dice coefficient of their sets of word
bigrams, 2 * shared / (own + other); repeated bigrams count once.  A coefficient of t bounds the
different bigrams of a passage to between t / (2 - t) and (2 - t) / t times the template's, so only windows and
templates within these bounds are compared, around the places where bigrams of
templates stand.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pubweave.llm.common import small_batches, whole_text
from pubweave.llm.shingles import chunks, mix, utf8, word_hashes

SIMILARITY = 75

# Texts of licences and of the notices that stand for them.
NOTICES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files (the \"Software\"), to deal in the"
        " Software without restriction, including without limitation the rights to use, copy,"
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,"
        " and to permit persons to whom the Software is furnished to do so, subject to the"
        " following conditions: The above copyright notice and this permission notice shall be"
        " included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this"
        " file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed"
        " to in writing, software distributed under the License is distributed on an \"AS IS\""
        " BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the"
        " License for the specific language governing permissions and limitations under the"
        " License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version. This program is"
        " distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even"
        " the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"
        " GNU General Public License for more details.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Released under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License as published by the Free Software Foundation; either"
        " version 2 of the License, or (at your option) any later version. This program is"
        " distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even"
        " the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"
        " GNU General Public License for more details.",
        "This program is free software; you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License version 2 as published by the Free Software"
        " Foundation. This program is distributed in the hope that it will be useful, but WITHOUT"
        " ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A"
        " PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Released under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU Affero General Public License as published by the Free Software Foundation,"
        " either version 3 of the License, or (at your option) any later version. This program is"
        " distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even"
        " the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"
        " GNU Affero General Public License for more details.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "Released under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU Lesser General Public License as published by the Free Software Foundation,"
        " either version 3 of the License, or (at your option) any later version. This program is"
        " distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even"
        " the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"
        " GNU Lesser General Public License for more details.",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms"
        " of the GNU Lesser General Public License as published by the Free Software Foundation;"
        " either version 2.1 of the License, or (at your option) any later version. This library"
        " is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without"
        " even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See"
        " the GNU Lesser General Public License for more details.",
        "This program is free software; you can redistribute it and/or modify it under the terms"
        " of the GNU Lesser General Public License as published by the Free Software Foundation;"
        " either version 2.1 of the License, or (at your option) any later version. This program"
        " is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without"
        " even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See"
        " the GNU Lesser General Public License for more details.",
    ],
    "LGPL-2.0": [
        "This library is free software; you can redistribute it and/or modify it under the terms"
        " of the GNU Library General Public License as published by the Free Software Foundation;"
        " either version 2 of the License, or (at your option) any later version. This library"
        " is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without"
        " even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See"
        " the GNU Library General Public License for more details.",
        "This program is free software; you can redistribute it and/or modify it under the terms"
        " of the GNU Library General Public License as published by the Free Software Foundation;"
        " either version 2 of the License, or (at your option) any later version. This program"
        " is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without"
        " even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See"
        " the GNU Library General Public License for more details.",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
        " If a copy of the MPL was not distributed with this file, You can obtain one at"
        " http://mozilla.org/MPL/2.0/.",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met: 1. Redistributions of source"
        " code must retain the above copyright notice, this list of conditions and the following"
        " disclaimer. 2. Redistributions in binary form must reproduce the above copyright"
        " notice, this list of conditions and the following disclaimer in the documentation"
        " and/or other materials provided with the distribution.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met: 1. Redistributions of source"
        " code must retain the above copyright notice, this list of conditions and the following"
        " disclaimer. 2. Redistributions in binary form must reproduce the above copyright"
        " notice, this list of conditions and the following disclaimer in the documentation"
        " and/or other materials provided with the distribution. 3. Neither the name of the"
        " copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies.",
    ],
    "EPL-2.0": [
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the"
        " Eclipse Public License 2.0 which is available at"
        " https://www.eclipse.org/legal/epl-2.0/",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file"
        " LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event"
        " will the authors be held liable for any damages arising from the use of this software."
        " Permission is granted to anyone to use this software for any purpose, including"
        " commercial applications, and to alter it and redistribute it freely, subject to the"
        " following restrictions:",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International"
        " License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0"
        " International License.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free"
        " to copy, modify, publish, use, compile, sell, or distribute this software, either in"
        " source code form or as a compiled binary, for any purpose, commercial or"
        " non-commercial, and by any means.",
    ],
}
SPELLINGS = {"licence": "license", "licenced": "licensed", "licences": "licenses"}

_LEFT, _RIGHT = mix(np.arange(901, 903, dtype=np.uint64))


def _hash_words(texts: list[str]) -> list[np.ndarray]:
    column = pa.array(texts, pa.string())
    data, offsets = utf8(column)
    words, _, _, before = word_hashes(data, offsets, letters_only=True)
    return [words[a:b] for a, b in zip(before[:-1], before[1:])]


def _respelled(words: np.ndarray) -> np.ndarray:
    for (old,), (new,) in zip(_hash_words(list(SPELLINGS)), _hash_words([*SPELLINGS.values()])):
        words = np.where(words == old, new, words)
    return words


def bigrams(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * _LEFT + words[1:] * _RIGHT)


class Templates:
    """Bigram sets of all templates, and a table that tells whether a hash is in any."""

    def __init__(self, notices: Mapping[str, list[str]], similarity: int):
        self.similarity = similarity
        self.names, self.sets = [], []
        for name, texts in notices.items():
            for words in _hash_words(texts):
                found = set(bigrams(_respelled(words)).tolist())
                if found:
                    self.names.append(name)
                    self.sets.append(found)
        of: dict[int, list[int]] = {}
        for number, found in enumerate(self.sets):
            for gram in found:
                of.setdefault(gram, []).append(number)
        self.of = of
        self.table = np.zeros(1 << 20, bool)
        self.table[[gram >> 44 for gram in of]] = True

    def best_windows(self, grams: np.ndarray) -> list[tuple[float, int, int, int]]:
        """(coefficient, template, first, last bigram), the best of what overlaps."""
        places: dict[int, list[int]] = {}
        for at in np.flatnonzero(self.table[(grams >> np.uint64(44)).astype(np.int64)]).tolist():
            for number in self.of.get(int(grams[at]), ()):
                places.setdefault(number, []).append(at)
        before = after = None
        # The least last bigram of windows that are alike goes with them.
        found: list[tuple[tuple, int, list[int]]] = []
        for number, hits in places.items():
            if len(hits) < len(self.sets[number]) * self.similarity / (200 - self.similarity):
                continue
            if before is None:
                before, after = neighbours(grams)
            for score, first, least, last in self._alike(number, hits, before, after):
                found.append(((-score, first - last, first, number), least, hits))
        heapq.heapify(found)
        # The best first; a window that overlaps a better one is no find of its own.
        chosen: list[tuple[int, int, float, int]] = []
        while found:
            (score, length, first, number), least, hits = heapq.heappop(found)
            at = bisect_right(chosen, (first, len(grams)))
            if at and chosen[at - 1][1] >= first:
                continue
            if at < len(chosen) and chosen[at][0] <= first - length:
                # Its equals that end before the better window are still to come.
                last = hits[bisect_left(hits, chosen[at][0]) - 1]
                if last >= least:
                    heapq.heappush(found, ((score, first - last, first, number), least, hits))
                continue
            chosen.insert(at, (first, first - length, -score, number))
        return [(score, number, first, last) for first, last, score, number in chosen]

    def _alike(
        self, number: int, hits: list[int], before: list[int], after: list[int]
    ) -> Iterator[tuple[float, int, int, int]]:
        """(coefficient, first, least last, greatest last bigram) of windows that begin and
        end with a bigram of the template and have the same set of bigrams."""
        size, t = len(self.sets[number]), self.similarity / 100
        least, most = size * t / (2 - t), int(size * (2 - t) / t)
        inside, n = set(hits), len(before)
        # Where different bigrams of a window that begins at ``at`` stand first, up to
        # one more than a window may have; those up to ``front`` have been looked at.
        news: list[int] = []
        at, front = hits[0], hits[0] - 1
        for first in hits:
            if first > front:
                news, front = [], first - 1
            else:
                for gone in range(at, first):
                    if news and news[0] == gone:
                        del news[0]
                    if after[gone] <= front:
                        insort(news, after[gone])
            at = first
            while len(news) <= most and front < n - 1:
                front += 1
                if before[front] < first:
                    news.append(front)
            shared = 0
            for own, place in enumerate(news[:most], 1):
                shared += place in inside
                score = 2 * shared / (own + size)
                if own < least or 100 * score < self.similarity:
                    continue
                end = news[own] if own < len(news) else n
                last = hits[bisect_left(hits, end) - 1]
                if last >= place:
                    yield score, first, place, last


def neighbours(grams: np.ndarray) -> tuple[list[int], list[int]]:
    """Where the same bigram stands before and after every place; -1 and n for none."""
    n = len(grams)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    before, after = np.full(n, -1), np.full(n, n)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before.tolist(), after.tolist()


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    notices: Mapping[str, list[str]] = NOTICES,
    similarity: int = SIMILARITY,
) -> DataFrame:
    """doc_id and ``found`` of every document: license, dice, first_word and last_word
    of every passage that is like a template.

    Of passages that overlap the most similar one counts; ties go to the longer, then
    the first one.  Null and empty texts, and texts without a match, have an empty
    array.  Templates of a single word have no bigram and never match.  Repeated
    rows and null ids are kept; no rows give no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    templates = {name: list(texts) for name, texts in notices.items()}
    kind = pa.list_(pa.struct([
        ("license", pa.string()), ("dice", pa.float64()),
        ("first_word", pa.int64()), ("last_word", pa.int64()),
    ]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, similarity)
        for batch in batches:
            data, offsets = utf8(batch["text"])
            found: list[list[dict]] = []
            for first, last in chunks(offsets):
                words, _, _, before = word_hashes(
                    data, offsets[first : last + 1], letters_only=True
                )
                words = _respelled(words)
                for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
                    found.append([
                        {"license": known.names[number], "dice": score,
                         "first_word": start, "last_word": end + 1}
                        for score, number, start, end in known.best_windows(
                            bigrams(words[a:b])
                        )
                    ])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(found, kind)], ["doc_id", "found"]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    id_kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"doc_id {id_kind}, found array<struct<license:string,dice:double,"
        "first_word:bigint,last_word:bigint>>",
    )
