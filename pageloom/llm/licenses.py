"""Licence notices in text, by a trained paragraph classifier.

A paragraph ends at an empty line or one of marks alone. Within it, neighbouring lines that mostly hold
word pairs of known notices form one unit, however many they are; any other line with an anchor word is a unit
of its own. The words of a unit, alone and in runs of two and three, are the features of a sparse multinomial
logistic regression over licence families and *none*. Its probabilities are calibrated on held-out paragraphs.
A unit that is likely to be a notice but has no family over the threshold is of *unknown* licence. A
prediction counts as confirmed only if the unit shares enough word pairs with one of the family's
templates, and, where it has several lines, more with that family than with any other, so that the version and
the first word of the name decide; otherwise it too is unknown.

The regression is trained on the driver from the templates below, varied by a seeded rule. Scoring
is array expressions inside the row: nothing is shuffled and no Python runs on executors.
"""

from __future__ import annotations

import functools
import json
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NGRAMS = 3
SEEN = 3  # times that a feature is seen in training at least
NOTICE = 0.2  # a notice has at most this probability of being none
LEAST_SHARED = 0.5
LEAST_TOLD = 0.8  # part of its word pairs that a family of the text must know to have told a unit
SEED = 11
MARK = "\u0001"  # between the number of a line and the line
NONE, UNKNOWN = "none", "unknown"

# The public wording of licence notices, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
        "in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license",
        "Licensed under the Apache License",
    ),
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT license",
        "This project is licensed under the terms of the MIT license",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction',
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
        "Licensed under the GPL v3",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, or "
        "(at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "Licensed under the GPL v2",
    ),
    "LGPL": (
        "licensed under the GNU Lesser General Public License, version 2.1",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL-3.0": (
        "licensed under the GNU Affero General Public License, version 3",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Released under the BSD License",
        "Licensed under the 3-Clause BSD License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": (
        "Licensed under the ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "EPL-2.0": (
        "Licensed under the Eclipse Public License 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public "
        "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC0": (
        "Dedicated to the public domain under CC0 1.0 Universal",
        "To the extent possible under law, the author has waived all copyright and related rights under CC0",
        "This is free and unencumbered software released into the public domain",
    ),
    "proprietary": (
        "All rights reserved",
        "Copyright 2020 Example Inc. All rights reserved",
        "All rights reserved. No part of this publication may be reproduced without prior written permission",
        "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited",
    ),
}
# The public wording that follows a notice, by family. It confirms no family by itself.
FURTHER: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-3.0": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
        "for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>.",
    ),
    "GPL-2.0": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
        "for more details.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to "
        "the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>.",
    ),
    "LGPL": (
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public "
        "License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, "
        "write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    ),
    "AGPL-3.0": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public "
        "License for more details.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, "
        "see <https://www.gnu.org/licenses/>.",
    ),
    "BSD": (
        "Copyright (c) 2020, The Authors. All rights reserved.",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "MPL-2.0": (
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "ISC": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
}
# Notices of no family above, from which the threshold of the unknown class is learnt.
OTHERS = (
    "Licensed under the zlib license",
    "Released under the Do What The Fuck You Want To Public License",
    "This file is covered by the PostgreSQL License",
    "Distributed under the Boost Software License, Version 1.0",
    "Licensed under the European Union Public Licence",
    "Available under the Open Data Commons Open Database License",
    "Licensed under the SIL Open Font License, Version 1.1",
)
# Anchor words in sentences that are no notices.
PLAIN = (
    "her driving license expired in march and the office was closed",
    "the license plate of the car was covered with mud",
    "he asked for permission to leave the table",
    "the warranty covers repairs for two years",
    "the apache helicopter landed near the village",
    "a public hearing on the liquor licence was held on monday",
    "she studied at mit and later worked in a laboratory",
    "copyright law was discussed at length by the committee",
    "the domain of the function is the set of real numbers",
    "creative writing is taught in the common room",
    "the commons voted on the general budget",
    "confidential sources told the paper about the plan",
    "they reserved all rooms of the hotel",
    "the rights of workers were defended in the hall",
    "please see the file on this page for details of the project and the data",
    "this work was done by a team for the project under the new rules",
    "the source of the river is free for all persons and may be used with care",
    "in this section the version of the software is described in general terms",
    "the terms of the contract were changed without notice",
    "copyright 2019 jane roe",
    "copyright c 2021 the project authors and contributors",
    "copyright c 2015 2018 example inc",
    "copyright 2020",
    "copyright c 2019",
)
# A notice holds one of these; the short ones are words of some language in lower case.
ANCHORS = (
    "licen[sc]e", "licen[sc]ed", "licen[sc]es", "licen[sc]ing", "copyright", "spdx", "apache", "gpl", "lgpl",
    "agpl", "bsd", "mpl", "gnu", "mozilla", "creative", "cc0", "permission", "redistribution", "redistribute",
    "proprietary", "rights", "unencumbered", "domain",
)
# "2.1" is one word, so that versions differ.
WORD = r"[0-9]+(?:\.[0-9]+)+|[a-z0-9]+"
NEGATED = (
    r"(?i:\b(?:not|never|neither|no longer)\s+(?:been\s+|being\s+|currently\s+)?"
    r"(?:licen[sc]ed|released|available|distributed|covered)\s+(?:under|by)\b)"
)
# What stands before the first name of a list of licences, and what parts the names.
HEAD = (
    r"(?i:^.*?\b(?:licen[sc]ed|released|available|distributed)\s+under(?:\s+(?:the|a|either|both|of|terms))*(?=\s)"
    r"|^.*?\blicense-identifier:)"
)
BETWEEN = r"(?i:\s*(?:\s(?:and/or|and|or)\s(?:\s*(?:the|under|a)\s)*|/)\s*)"
LIST = rf"(?:{HEAD}).*?(?:{BETWEEN})"
# The first letter is looked at first, which rules out most places at once.
GATE = (
    rf"(?=[{''.join(sorted({c for a in ANCHORS for c in a[0] + a[0].upper()}))}])(?<![A-Za-z0-9])"
    rf"(?:(?i:{'|'.join(ANCHORS)})|MIT|CC)(?![A-Za-z0-9])"
)


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    grams: np.ndarray  # the hash of each feature
    weights: np.ndarray  # (features, families)
    bias: np.ndarray
    threshold: float


def tokens(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def ngrams(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in range(1, NGRAMS + 1) for i in range(len(words) - n + 1)]


def hashed(ngram: str) -> int:
    """As Spark's ``xxhash64``."""
    return int(np.uint64(xxhash.xxh64_intdigest(ngram.encode(), 42)).astype(np.int64))


def varied(texts: tuple[str, ...], times: int, rng: random.Random) -> list[str]:
    """Each text with words lost or repeated, and with other words around it."""
    around = "see file project code this for details copy of the data page author team 2021 by".split()
    made = list(texts)
    for text in texts:
        for _ in range(times):
            words = [w for w in text.split() if rng.random() > 0.06]
            before = [rng.choice(around) for _ in range(rng.randint(0, 4))]
            after = [rng.choice(around) for _ in range(rng.randint(0, 4))]
            made.append(" ".join([*before, *words, *after]))
    return made


def _rows(texts: list[str], place: dict[int, int]) -> np.ndarray:
    x = np.zeros((len(texts), len(place)), np.float32)
    for i, text in enumerate(texts):
        x[i, [place[h] for h in map(hashed, ngrams(tokens(text))) if h in place]] = 1.0
    return x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def labelled(times: int, seed: int) -> list[tuple[str, str]]:
    """Varied paragraphs and their classes; those of ``OTHERS`` are unknown."""
    rng = random.Random(seed)
    classes = {**TEMPLATES, NONE: PLAIN, UNKNOWN: OTHERS}
    return [(text, name) for name, texts in classes.items() for text in varied(texts, times, rng)]


def train(times: int = 12, rounds: int = 300, seed: int = SEED) -> Model:
    """Regression on known classes; temperature and threshold from paragraphs it has not seen."""
    families = (NONE, *TEMPLATES)
    known = [(t, c) for t, c in labelled(times, seed) if c != UNKNOWN]
    counts = Counter(h for t, _ in known for h in {hashed(g) for g in ngrams(tokens(t))})
    place = {h: i for i, h in enumerate(sorted(h for h, n in counts.items() if n >= SEEN))}
    x = _rows([t for t, _ in known], place)
    y = np.array([families.index(c) for _, c in known])
    target = np.eye(len(families), dtype=np.float32)[y]
    weights, bias = np.zeros((len(place), len(families)), np.float32), np.zeros(len(families), np.float32)
    for _ in range(rounds):
        error = (_softmax(x @ weights + bias) - target) / len(y)
        weights -= 2.0 * (x.T @ error + 1e-4 * weights)
        bias -= 0.5 * error.sum(axis=0)

    held = labelled(max(2, times // 3), seed + 1)
    z = _rows([t for t, _ in held], place) @ weights + bias
    truth = np.array([families.index(c) if c != UNKNOWN else -1 for _, c in held])
    seen = truth >= 0

    def loss(heat: float) -> float:
        p = _softmax(z[seen] / heat)
        return float(-np.log(p[np.arange(len(p)), truth[seen]] + 1e-12).mean())

    heat = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    p = _softmax(z / heat)
    best, sure = p.argmax(axis=1), p.max(axis=1)
    right = best == truth
    # the threshold that is right most often, unknown notices included
    marks = np.linspace(0.3, 0.95, 27)
    score = [np.where(sure >= m, right, ~seen).mean() for m in marks]
    threshold = float(marks[int(np.argmax(score))])
    return Model(families, np.array(list(place)), weights / heat, bias / heat, threshold)


def _constant(values: np.ndarray) -> Column:
    whole = values.dtype.kind == "i"
    text = ",".join(str(v) if whole else f"{v:.6g}" for v in values.ravel().tolist())
    # folded into one constant
    return F.split(F.lit(text), ",").cast("array<long>" if whole else "array<double>")


def _pairs_of(words: list[str]) -> list[str]:
    return sorted({" ".join(p) for p in zip(words, words[1:])})


def classify(words: Column, model: Model) -> Column:
    """Struct of ``family``, ``probability`` and ``none``, the probability of no notice at all, for
    an array of lower-case words."""
    size = len(model.families)
    weights, bias, grams = (_constant(v) for v in (model.weights, model.bias, model.grams))

    def runs(n: int) -> Column:
        last = F.size(words) - n
        each = F.transform(
            F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, n), " "))
        )
        return F.when(last < 0, F.array().cast("array<long>")).otherwise(each)

    known = F.array_intersect(F.concat(*[runs(n) for n in range(1, NGRAMS + 1)]), grams)
    places = F.transform(known, lambda g: F.array_position(grams, g).cast("int") - 1)

    def scored(at: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(size - 1)),
            lambda c: F.get(bias, c)
            + F.aggregate(at, F.lit(0.0), lambda s, p: s + F.get(weights, p * size + c)),
        )

    def best(z: Column) -> Column:
        top = F.array_max(z)
        total = F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v - top))
        name = F.element_at(F.array(*map(F.lit, model.families)), F.array_position(z, top).cast("int"))
        return F.struct(
            name.alias("family"),
            (F.lit(1.0) / total).alias("probability"),
            (F.exp(F.get(z, F.lit(0)) - top) / total).alias("none"),
        )

    return F.transform(F.transform(F.array(places), scored), best)[0]


def shared(words: Column, family: Column) -> Column:
    """Struct of ``part``, the largest part of a template of ``family``, or of the paragraph, that
    the other holds, and ``both``, the most word pairs that they share."""
    known = json.dumps(
        {name: [_pairs_of(tokens(t)) for t in texts] for name, texts in TEMPLATES.items()}
    )
    templates = F.from_json(F.lit(known), "map<string,array<array<string>>>")
    pairs = F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))),
            lambda i: F.array_join(F.slice(words, i, 2), " "),
        )
    )

    def compared(template: Column, own: Column) -> Column:
        both = F.size(F.array_intersect(template, own))
        return F.struct((both / F.least(F.size(template), F.size(own))).alias("part"), both.alias("both"))

    found = F.transform(
        F.array(pairs),
        lambda own: F.transform(F.element_at(templates, family), lambda t: compared(t, own)),
    )
    return F.transform(
        found,
        lambda f: F.struct(
            F.coalesce(F.array_max(F.transform(f, lambda x: x["part"])), F.lit(0.0)).alias("part"),
            F.coalesce(F.array_max(F.transform(f, lambda x: x["both"])), F.lit(0)).alias("both"),
        ),
    )[0]


@functools.cache
def known_pairs() -> dict[str, list[int]]:
    """Hashes of the word pairs in the wording of each family; the whole of *unknown* is of ``OTHERS``."""
    texts = {f: (*t, *FURTHER.get(f, ())) for f, t in TEMPLATES.items()} | {UNKNOWN: OTHERS}
    return {f: sorted({hashed(p) for t in ts for p in _pairs_of(tokens(t))}) for f, ts in texts.items()}


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def _pair_hashes(words: Column) -> Column:
    each = F.transform(
        F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, 2), " "))
    )
    return F.when(F.size(words) < 2, F.array().cast("array<long>")).otherwise(each)


def _numbered(line: Column, text: Column) -> Column:
    return F.concat(line.cast("string"), F.lit(MARK), text)


def _lines(unit: Column) -> Column:
    return F.transform(
        F.split(unit, "\n"),
        lambda t: F.struct(
            F.substring_index(t, MARK, 1).cast("int").alias("line"),
            F.regexp_replace(t, f"^[0-9]+{MARK}", "").alias("text"),
        ),
    )


def _blocks(lines: Column) -> Column:
    """Runs of numbered lines that no empty one parts, with an anchor word in them."""
    parts = F.transform(F.split(F.array_join(lines, "\n"), "\n{2,}"), lambda x: F.btrim(x, F.lit("\n")))
    return F.filter(parts, lambda x: x.rlike(GATE))


def _plain(text: Column) -> Column:
    """A line without the word that marks a comment."""
    return F.regexp_replace(text, r"(?i)^\s*(?:dnl|rem)\s", "")


def units(paragraph: Column) -> Column:
    """The units of a paragraph of numbered lines: runs of lines of which half the words or more lie in word pairs
    of known notices, pairs over a line's end included, and each other line with an anchor word."""
    everything = _constant(np.array(sorted({h for hs in known_pairs().values() for h in hs}), np.int64))

    def line_words(l: Column) -> Column:
        return F.struct(l["line"], l["text"], _words(_plain(l["text"])).alias("words"))

    def covered(l: Column, before: Column, after: Column, known: Column) -> Column:
        nothing = F.array().cast("array<string>")
        # the neighbours' nearest words
        left = F.when(F.size(before) > 0, F.slice(before, -1, 1)).otherwise(nothing)
        right = F.when(F.size(after) > 0, F.slice(after, 1, 1)).otherwise(nothing)
        n, off = F.size(l["words"]), F.size(left)

        def half(flags: Column) -> Column:
            at = F.filter(
                F.sequence(F.lit(0), n - 1),
                lambda w: F.coalesce(F.get(flags, off + w - 1), F.lit(False))
                | F.coalesce(F.get(flags, off + w), F.lit(False)),
            )
            return 2 * F.size(at) >= n

        flags = F.transform(_pair_hashes(F.concat(left, l["words"], right)), lambda h: F.array_contains(known, h))
        return F.when(n == 0, F.lit(False)).otherwise(_let(flags, half))

    def runs(ls: Column) -> Column:
        whole = F.flatten(F.transform(ls, lambda l: l["words"]))

        def marked(known: Column) -> Column:
            def mark(l: Column, i: Column) -> Column:
                own = _numbered(l["line"], l["text"])
                alone = F.when(l["text"].rlike(GATE), F.concat(F.lit("\n"), own, F.lit("\n"))).otherwise("")
                inside = covered(l, F.get(ls, i - 1)["words"], F.get(ls, i + 1)["words"], known)
                return F.when(inside, own).otherwise(alone)

            return _blocks(F.transform(ls, mark))

        return _let(F.array_intersect(_let(whole, _pair_hashes), everything), marked)

    several = _let(F.transform(_lines(paragraph), line_words), runs)
    return F.when(F.contains(paragraph, F.lit("\n")), several).otherwise(F.array(paragraph))


def judge(text: Column, model: Model, least_shared: float, rivals: bool) -> Column:
    """Struct of ``family``, ``probability``, ``shared``, ``both``, ``sure`` and ``pairs`` (hashes) for a text.
    With ``rivals`` no other family may know as many of its pairs."""
    families = F.from_json(F.lit(json.dumps(known_pairs())), "map<string,array<long>>")

    def compared(x: Column) -> Column:
        family = x["best"]["family"]
        nothing = F.struct(F.lit(0.0).alias("part"), F.lit(0).alias("both"))
        hits = F.transform(F.map_values(families), lambda ps: F.size(F.array_intersect(x["pairs"], ps)))
        own = F.size(F.array_intersect(x["pairs"], F.element_at(families, family)))
        alone = _let(F.array(own), lambda o: F.size(F.filter(hits, lambda h: h >= o[0])) == 1)
        told_apart = F.when(family == NONE, F.lit(False)).otherwise(alone) if rivals else F.lit(True)
        return F.struct(
            x["best"].alias("best"),
            x["pairs"].alias("pairs"),
            told_apart.alias("apart"),
            F.when(family == NONE, nothing).otherwise(shared(x["words"], family)).alias("s"),
        )

    def checked(x: Column) -> Column:
        family, p, part = x["best"]["family"], x["best"]["probability"], x["s"]["part"]
        meant = ~text.rlike(NEGATED)
        likely = (family != NONE) & (p >= model.threshold) & (part >= least_shared)
        sure = likely & x["apart"] & meant
        none = ~meant | (~likely & (x["best"]["none"] > NOTICE))
        return F.struct(
            F.when(sure, family).when(none, F.lit(NONE)).otherwise(F.lit(UNKNOWN)).alias("family"),
            F.round(p, 6).alias("probability"),
            F.round(part, 6).alias("shared"),
            x["s"]["both"].alias("both"),
            sure.alias("sure"),
            x["pairs"].alias("pairs"),
        )

    def start(words: Column) -> Column:
        return F.struct(
            words.alias("words"),
            classify(words, model).alias("best"),
            F.array_distinct(_pair_hashes(words)).alias("pairs"),
        )

    return _let(_let(_let(_words(text), start), compared), checked)


def listed(text: Column, model: Model, least_shared: float) -> Column:
    """Judgements of the parts of a list such as "under the MIT license or the Apache License", each read with
    what stands before the list; empty unless two parts are surely of different families."""

    def parts(head: Column) -> Column:
        names = F.split(F.substring(text, F.length(head) + F.lit(1), F.length(text)), BETWEEN)

        def statement(name: Column) -> Column:
            name = F.regexp_replace(F.btrim(name, F.lit(" \t()[]\"',.;*")), r"(?i)^(?:(?:the|either|a)\s+)+", "")
            of_license = F.when(name.rlike("(?i)licen[sc]e"), F.lit("")).otherwise(F.lit(" license"))
            return F.when(head.rlike(":$"), F.concat(head, F.lit(" "), name)).otherwise(
                F.concat(F.regexp_replace(head, r"(?i)\bunder\b.*$", "under the "), name, of_license)
            )

        found = F.transform(names, lambda name: judge(statement(name), model, least_shared, rivals=False))
        return F.filter(found, lambda x: x["sure"])

    none = F.array().cast(
        "array<struct<family:string,probability:double,shared:double,both:int,sure:boolean,pairs:array<long>>>"
    )
    found = _let(F.regexp_extract(text, HEAD, 0), parts)
    several = _let(
        found,
        lambda xs: F.when(
            F.size(F.array_distinct(F.transform(xs, lambda x: x["family"]))) > 1, xs
        ).otherwise(none),
    )
    return F.when(text.rlike(LIST) & ~text.rlike(NEGATED), several).otherwise(none)


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    model: Model | None = None,
    least_shared: float = LEAST_SHARED,
) -> DataFrame:
    """``(key, licenses, n_notices, notices)`` for each row of ``docs``.

    ``notices`` are structs ``(line, family, probability, shared)`` of the units that the classifier takes for a
    licence notice, by their first line, counted from 0; ``family`` is ``unknown`` where none reaches the
    model's threshold, or no template of the family shares ``least_shared`` of its word pairs. A unit of several
    lines is one notice if it is sure and shares more with a template than any of its lines does; a line
    in it stays a notice beside it only if it says what that family's wording does not. Otherwise its lines
    are judged one by one. Names in a list ("MIT or Apache") are notices each. A unit whose pairs another family of
    the same text knows all of, as the paragraphs after the first one of a header, belongs to that notice.
    What a text says it is *not* licensed under is no notice. ``licenses`` are the distinct families in order.
    Lines are those between line feeds, of any length; paragraphs have any number of lines. A null or empty text has
    no notices. Rows are judged one by one: repeated rows and null keys come out as they are put in, an empty table
    gives an empty result, and other columns are left out.
    """
    model = model or train()
    families = F.from_json(F.lit(json.dumps(known_pairs())), "map<string,array<long>>")
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.transform(
        F.split(value, "\n"), lambda t, i: F.when(t.rlike(r"[\p{L}\p{N}]"), _numbered(i, t)).otherwise("")
    )
    paragraphs = F.when(value.rlike(GATE), _blocks(lines)).otherwise(F.array().cast("array<string>"))
    found = docs.select(F.col(key).alias("key"), paragraphs.alias("paragraphs"))
    found = found.select("key", F.flatten(F.transform("paragraphs", units)).alias("units"))

    def judged(ls: Column) -> Column:
        whole = F.array_join(F.transform(ls, lambda l: _plain(l["text"])), " ")
        bare = F.regexp_replace(whole, r"\s[#*/;%!-]+\s", " ")  # comment marks
        gated = F.filter(ls, lambda l: l["text"].rlike(GATE))
        alone = F.transform(
            gated,
            lambda l: F.struct(
                l["line"].alias("line"),
                judge(l["text"], model, least_shared, rivals=False).alias("j"),
            ),
        )
        several = F.size(ls) > 1
        return F.struct(
            ls[0]["line"].alias("first"),
            alone.alias("alone"),
            F.when(several, judge(bare, model, least_shared, rivals=True)).alias("whole"),
            _let(bare, lambda t: listed(t, model, least_shared)).alias("listed"),
        )

    found = found.select("key", F.transform("units", lambda u: _let(_lines(u), judged)).alias("units"))

    def notice(line: Column, j: Column) -> Column:
        return F.struct(
            line.alias("line"),
            *(j[n].alias(n) for n in ("family", "probability", "shared")),
            j["sure"].alias("sure"),
            j["pairs"].alias("pairs"),
        )

    def decided(u: Column) -> Column:
        """The notices of a unit, and whether it is one notice of several lines."""
        whole, lone = u["whole"], F.filter(u["alone"], lambda x: x["j"]["family"] != NONE)
        same = F.filter(lone, lambda x: x["j"]["sure"] & (x["j"]["family"] == whole["family"]))
        most = F.coalesce(F.array_max(F.transform(same, lambda x: x["j"]["both"])), F.lit(0))
        strong = F.coalesce(whole["sure"] & (whole["both"] > most), F.lit(False))
        of_whole = F.element_at(families, whole["family"])

        def differs(x: Column) -> Column:
            own = F.array_intersect(x["j"]["pairs"], F.element_at(families, x["j"]["family"]))
            return x["j"]["sure"] & (F.size(F.array_except(own, of_whole)) > 0)

        beside = F.filter(lone, lambda x: differs(x) & (x["j"]["family"] != whole["family"]))

        def with_whole(others: Column) -> Column:
            named = F.transform(others, lambda x: x["line"])
            free = F.filter(
                F.transform(u["alone"], lambda x: x["line"]), lambda n: ~F.array_contains(named, n)
            )
            first = F.when(F.array_contains(named, u["first"]), F.coalesce(free[0], u["first"])).otherwise(u["first"])
            return F.array_sort(
                F.concat(F.array(notice(first, whole)), F.transform(others, lambda x: notice(x["line"], x["j"])))
            )

        each = F.transform(lone, lambda x: notice(x["line"], x["j"]))
        # of unknown lines that are one unknown unit, the unit
        unsure = F.coalesce(whole["family"] == UNKNOWN, F.lit(False))
        joined = F.concat(F.filter(each, lambda n: n["sure"]), F.array(notice(u["first"], whole)))
        return (
            F.when(F.size(u["listed"]) > 1, F.transform(u["listed"], lambda j: notice(u["first"], j)))
            .when(strong, _let(beside, with_whole))
            .when(unsure & F.forall(each, lambda n: ~n["sure"]), joined)
            .otherwise(each)
        )

    found = found.select(
        "key",
        F.transform(
            "units", lambda u: F.struct(decided(u).alias("notices"), u["whole"]["pairs"].alias("pairs"))
        ).alias("units"),
    )
    sure = F.flatten(F.transform("units", lambda u: F.filter(u["notices"], lambda n: n["sure"])))

    def told(family: Column, pairs: Column, names: Column) -> Column:
        """Whether another of the families knows all that a notice has of its own family's wording."""

        def knows(other: Column) -> Column:
            """All of a doubtful notice; of a sure one what makes it one, as its holder's name may be anyone's."""
            theirs = F.element_at(families, other)
            most = F.size(F.array_intersect(pairs, theirs)) >= LEAST_TOLD * F.size(pairs)
            return (other != family) & ((family != UNKNOWN) | most)

        def says_more(other: Column) -> Column:
            own = F.array_intersect(pairs, F.element_at(families, family))
            return F.size(F.array_except(own, F.element_at(families, other))) > 0

        return (F.size(pairs) > 0) & F.exists(names, lambda other: knows(other) & ~says_more(other))

    def names_of(notices: Column) -> Column:
        return F.array_distinct(F.transform(notices, lambda n: n["family"]))

    # only a notice that no other tells may tell others, so that two alike do not both go
    own_word = F.filter("sure", lambda n: ~told(n["family"], n["pairs"], F.col("names")))
    found = (
        found.select("key", "units", sure.alias("sure"))
        .select("key", "units", "sure", names_of(F.col("sure")).alias("names"))
        .select("key", "units", names_of(own_word).alias("names"))
    )

    def left(u: Column) -> Column:
        gone = F.coalesce(told(F.lit(UNKNOWN), u["pairs"], F.col("names")), F.lit(False))
        doubtful = F.forall(u["notices"], lambda n: ~n["sure"])
        kept = F.filter(u["notices"], lambda n: ~told(n["family"], n["pairs"], F.col("names")))
        return F.when(gone & doubtful, F.filter(kept, lambda n: F.lit(False))).otherwise(kept)

    kept = F.flatten(F.transform("units", left))
    notices = F.transform(
        kept, lambda n: F.struct(*(n[c].alias(c) for c in ("line", "family", "probability", "shared")))
    )
    return found.select("key", F.array_sort(notices).alias("notices")).select(
        F.col("key").alias(key),
        F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["family"]))).alias("licenses"),
        F.size("notices").cast("long").alias("n_notices"),
        "notices",
    )
