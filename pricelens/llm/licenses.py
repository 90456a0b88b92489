"""Licence scan: a trained classifier of paragraphs, confirmed against templates.

A text is split at blank lines into paragraphs, and a paragraph is read as a whole, line by line, and over neighbouring lines, since
notices are wrapped, several may follow each other without a blank line, and one may stand in the midst of prose: a window is a
paragraph, a line, or a line with up to ``WRAPPED - 1`` more behind it. All windows are read as sets of words and word pairs; a multinomial
logistic regression with an L1 penalty, trained on the driver from the notices below, gives each licence family and ``unknown`` a
probability, with one temperature fitted on notices left out of training. Every family that is likelier than ``unknown`` is asked for a
template that confirms it, so that a line that offers two licences shows both. A template confirms if the window holds most of its word
pairs and most of its marks, the pairs that no other family's templates hold. A short name is held whole, and it, like a notice of one
line that holds one, must be used to license: it is half of the window's words, or the window holds a word of ``GRANTS`` or ``under`` right before the name. All of the scan is
built from array expressions within a row: no shuffle, and no Python on the executors.
"""

from __future__ import annotations

import json
import math
import random
import re
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, unused

#: Usual short notices of each family; a, b, c mark years and holders.
NOTICES = {
    "apache": ["Licensed under the Apache License, Version 2.0.", "This file is licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "you may not use this file except in compliance with the License"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "bsd": ["Released under the BSD 3-Clause License", "Licensed under the 2-clause BSD license", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-or-later", "you can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "lgpl": ["licensed under the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-only", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl": ["licensed under the GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0-only", "under the terms of the GNU Affero General Public License"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License", "Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "licensed under a Creative Commons Attribution NonCommercial 4.0 License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "licensed under a Creative Commons Attribution ShareAlike 4.0 License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "public-domain": ["This work is released into the public domain", "dedicated to the public domain under the CC0 license", "SPDX-License-Identifier: CC0-1.0", "This is free and unencumbered software released into the public domain"],
    "isc": ["Released under the ISC License.", "Licensed under the ISC license", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "zlib": ["Released under the zlib License.", "Licensed under the zlib/libpng license", "SPDX-License-Identifier: Zlib"],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "epl": ["Licensed under the Eclipse Public License", "made available under the terms of the Eclipse Public License", "SPDX-License-Identifier: EPL-2.0"],
    "artistic": ["Licensed under the Artistic License 2.0", "SPDX-License-Identifier: Artistic-2.0"],
    "eupl": ["Licensed under the EUPL, Version 1.2", "Licensed under the European Union Public Licence", "SPDX-License-Identifier: EUPL-1.2"],
    "proprietary": ["All rights reserved.", "Copyright 2020 Example Ltd. All rights reserved", "proprietary and confidential, unauthorized copying is prohibited under copyright"],
}
#: Paragraphs of licence texts and of the headers that they ask for.
PARAGRAPHS = {
    "apache": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
    ],
    "mit": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)',
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "cc-by": ["This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"],
    "cc-by-nc": ["This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"],
    "cc-by-sa": ["This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"],
    "public-domain": [
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software',
    ],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "artistic": ["The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package"],
    "eupl": ["Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL; You may not use this work except in compliance with the Licence."],
    "proprietary": ["This software is the confidential and proprietary information of the company. You shall not disclose such confidential information and shall use it only in accordance with the terms of the license agreement."],
}
#: Titles and usual short names of each family. Like all notices of few word pairs they must be held whole.
TITLES = {
    "apache": ["Apache License", "Apache 2.0", "Apache-licensed", "ASL 2.0"],
    "mit": ["MIT License", "The MIT License (MIT)", "MIT-licensed", "license: MIT", "licensed under MIT", "released under MIT", "MIT OR Apache", "2.0 OR MIT"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-2-Clause", "BSD-3-Clause", "BSD-licensed", "license: BSD", "licensed under BSD", "released under BSD"],
    "gpl": ["GNU General Public License", "GPL v3", "GPL v2", "GNU GPL", "GPLv3", "GPLv2", "GPL-3.0", "GPL-2.0"],
    "lgpl": ["GNU Lesser General Public License", "LGPL v3", "LGPL v2.1", "GNU LGPL", "LGPLv3", "LGPLv2", "LGPL-3.0", "LGPL-2.1"],
    "agpl": ["GNU Affero General Public License", "AGPL v3", "GNU AGPL", "AGPLv3", "AGPL-3.0"],
    "mpl": ["Mozilla Public License", "MPL 2.0", "MPLv2"],
    "cc-by": ["CC BY 4.0", "CC BY 3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC 3.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC BY-SA 3.0"],
    "public-domain": ["CC0 1.0", "The Unlicense"],
    "isc": ["ISC License", "ISC-licensed", "license: ISC"],
    "zlib": ["zlib License", "zlib/libpng License"],
    "boost": ["Boost Software License", "BSL-1.0"],
    "epl": ["Eclipse Public License", "EPL 2.0", "EPL 1.0", "EPLv2"],
    "artistic": ["Artistic License", "Artistic 2.0"],
    "eupl": ["European Union Public Licence", "EUPL 1.2", "EUPL v1.2"],
    "proprietary": [],
}
#: Words and word pairs that show that a short name near them licenses something.
GRANTS = ("licensed", "relicensed", "spdx", "under the", "terms of", "governed by", "covered by", "subject to", "same terms")
#: Sentences with words of licences that license nothing.
OTHERS = [
    "his driving licence was taken away", "the license plate of the car", "permission denied", "she asked for permission to leave", "a licensed plumber came by", "the copyright dispute went to court", "under warranty for two years",
    "human rights are reserved for nobody", "the right to vote", "licence fee for television", "a fishing license costs ten", "this license is about nothing in particular", "see the license file", "public library in the domain of the city",
    "the copyright office is closed", "the licensing committee met", "copyright infringement notice", "the version 2.0 was released", "the apache helicopter", "mit professors say", "bsd conference", "a creative use of commons",
]
#: Sentences that name a licence ({}) and license nothing.
MENTIONS = ["the history of the {} fills a long book", "nobody in the room had read the {} to its end", "they argued over the {} for years", "what the {} says about patents is not clear to most people", "we removed all {} code from the tree"]
ANCHORS = ("licen", "copyright", "rights reserved", "permission", "redistribut", "public domain", "spdx", "unauthorized copying")
UNKNOWN = "unknown"
#: Least probability of a family against unknown, and least share of a notice's word pairs, and of its marks, that a window must hold.
LIKELY, CONFIRMED = 0.5, 0.6
#: A notice of at most so many word pairs must be held whole.
WHOLE = 3
#: Most neighbouring lines that are read together, besides the whole paragraph.
WRAPPED = 3


def words_of(paragraph: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", paragraph.lower().replace("licence", "license")) if w]


def notices_of(family: str) -> list[str]:
    return [*NOTICES[family], *PARAGRAPHS[family], *TITLES[family]]


def grams_of(words: list[str]) -> list[str]:
    return sorted({*words, *map(" ".join, zip(words, words[1:]))})


@dataclass(frozen=True)
class Template:
    pairs: list[str]  # its word pairs; of one word that word
    marks: list[str]  # those that no other family's templates hold
    named: bool  # a short name
    naming: bool  # a short name or a notice that holds one
    size: int  # number of the different words of the name
    under: str  # "under" and the first of them


def templates() -> dict[str, list[Template]]:
    """The templates of each family; one without marks shows nothing of its own and is left out."""
    pairs_of = lambda words: sorted({" ".join(x) for x in zip(words, words[1:])}) or words
    held = {f: {p for n in notices_of(f) for p in pairs_of(words_of(n))} for f in NOTICES}
    shared = {p for f, ps in held.items() for p in ps if any(p in other for g, other in held.items() if g != f)}
    found: dict[str, list[Template]] = {}
    for f in NOTICES:
        names = sorted(map(words_of, TITLES[f]), key=len)
        for n in notices_of(f):
            words = words_of(n)
            pairs = pairs_of(words)
            inside = [name for name in names if set(pairs_of(name)) <= set(pairs)]
            name = words if n in TITLES[f] or not inside else inside[-1]
            naming = n not in PARAGRAPHS[f] and inside != []
            if marks := [p for p in pairs if p not in shared]:
                found.setdefault(f, []).append(Template(pairs, marks, n in TITLES[f], naming, len(set(name)), f"under {name[0]}"))
    return found


def least(template: Template, items: list[str]) -> int:
    """So many of a template's ``items`` a window must hold."""
    whole = template.named or len(template.pairs) <= WHOLE
    return len(items) if whole else math.ceil(len(items) * CONFIRMED - 1e-9)


def _signal() -> str:
    """A pattern that finds something in all that any template can confirm: of each template so many marks that a paragraph without them holds too few."""
    chosen: set[str] = set()
    for t in (x for family in templates().values() for x in family):
        chosen.update(sorted(t.marks, key=lambda p: (-len(p), p))[: len(t.marks) - least(t, t.marks) + 1])
    first = {c: sorted(p[1:].replace(" ", "[^a-z0-9]+") for p in chosen if p[0] == c) for c in {p[0] for p in chosen}}
    pattern = "(?i)(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(first.items())) + ")(?![a-z0-9])"
    return pattern.replace("icense", "icen[cs]e")


@dataclass
class Model:
    families: list[str]  # the last is unknown
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float


def _examples(seed: int) -> list[tuple[tuple[str, ...], list[str]]]:
    """(families, words): notices whole, with a word less at either end or more around them, two short names together, and for unknown the other sentences, those that only name a licence, and notices with their words shuffled."""
    rng, found = random.Random(seed), []
    filler = "code here by the authors file project a of and in to for it work 2019 2024".split()
    around = lambda: rng.sample(filler, rng.randint(0, 4))
    for family in NOTICES:
        for notice in notices_of(family):
            words = words_of(notice)
            found += [((family,), words), ((family,), words[1:] if len(words) > 4 else words)]
            found += [((family,), around() + words + around()) for _ in range(4)]
            found += [((UNKNOWN,), rng.sample(filler, 3) + rng.sample(words, max(1, len(words) // 2))) for _ in range(2)]
        for name in TITLES[family]:
            found += [((family,), words_of(f"{begin} {name}")) for begin in ("licensed under the", "you may use it under the", "available under")]
            found += [((UNKNOWN,), words_of(mention.format(name))) for mention in MENTIONS]
    named = [f for f in NOTICES if TITLES[f]]
    for one, other in (rng.sample(named, 2) for _ in range(6 * len(named))):
        found.append(((one, other), words_of(f"{rng.choice(['licensed under', 'under either of', ''])} {rng.choice(TITLES[one])} or {rng.choice(TITLES[other])}")))
    for sentence in OTHERS * 3:
        found.append(((UNKNOWN,), around() + words_of(sentence)))
    rng.shuffle(found)
    return found


def train(seed: int = 1, epochs: int = 30, rate: float = 0.3, l1: float = 2e-4) -> Model:
    """Stochastic proximal gradient over the examples; every fifth calibrates the temperature. An example of two families is half of each."""
    families = [*NOTICES, UNKNOWN]
    number = {f: k for k, f in enumerate(families)}
    examples = []
    for shown, words in _examples(seed):
        target = np.zeros(len(families))
        target[[number[f] for f in shown]] = 1 / len(shown)
        examples.append((target, grams_of(words)))
    taught, kept = [x for i, x in enumerate(examples) if i % 5], [x for i, x in enumerate(examples) if i % 5 == 0]
    place = {g: i for i, g in enumerate(sorted({g for _, grams in taught for g in grams}))}
    read = lambda part: [(target, np.array([place[g] for g in grams if g in place], np.int64)) for target, grams in part]
    weights, bias = np.zeros((len(place), len(families))), np.zeros(len(families))

    def chances(z: np.ndarray, t: float = 1.0) -> np.ndarray:
        e = np.exp((z - z.max()) / t)
        return e / e.sum()

    lessons = read(taught)
    for epoch in range(epochs):
        pace = rate / (1 + 0.2 * epoch)
        for target, at in lessons:
            error = chances(weights[at].sum(0) + bias) - target
            step = pace / math.sqrt(len(at))
            moved = weights[at] - step * error
            weights[at] = np.sign(moved) * np.maximum(np.abs(moved) - pace * l1, 0.0)
            bias -= 0.1 * step * error
    scored = [(target, weights[at].sum(0) + bias) for target, at in read(kept)]
    grid = [0.25 * 1.1**i for i in range(30)]
    temperature = min(grid, key=lambda t: -sum(target @ np.log(np.maximum(chances(z, t), 1e-9)) for target, z in scored))
    return Model(families, {g: weights[i].tolist() for g, i in place.items() if weights[i].any()}, bias.tolist(), temperature)


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _grams(paragraph: Column) -> Column:
    """Distinct words and word pairs of a paragraph."""
    words = F.filter(F.split(F.replace(F.lower(paragraph), F.lit("licence"), F.lit("license")), "[^a-z0-9]+"), lambda w: w != "")
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.concat(words, F.coalesce(pairs, F.array().cast("array<string>"))))


def find_licenses(df: DataFrame, text: str = "text", into: str = "licenses", model: Model | None = None) -> DataFrame:
    """``df`` with ``into``: an array of (nr, paragraph, family, chance), one for each licence found, and for each other line with an anchor.

    nr counts lines from 0, and is the first one's where a notice is wrapped over lines; a line that offers several licences gives
    each of them. chance is the family's probability against unknown, and of unknown that against all. family is ``unknown`` where no licence was
    confirmed. Null and empty texts have none. Every row is kept.
    """
    model = model or train()
    k = len(model.families)
    weights, bias = _literal({g: [w / model.temperature for w in r] for g, r in model.weights.items()}, "map<string,array<double>>"), _literal([b / model.temperature for b in model.bias], "array<double>")
    known = _literal(sorted(model.weights), "array<string>")
    lines_, blank_, judged_, sure_ = unused(df, "lines", "blank", "judged", "sure")
    of_family = [[{**asdict(t), "least": least(t, t.pairs), "marked": least(t, t.marks)} for t in templates().get(f, [])] for f in model.families[:-1]]
    notices = _literal(of_family, "array<array<struct<pairs:array<string>,marks:array<string>,named:boolean,naming:boolean,size:int,under:string,least:int,marked:int>>>")
    families, grants = _literal(model.families, "array<string>"), F.array(*map(F.lit, GRANTS))
    anchor, signal = "(?i)" + "|".join(ANCHORS), _signal()
    body = text_of(text)

    def classified(grams: Column) -> Column:
        z = F.aggregate(F.array_intersect(grams, known), bias, lambda acc, g: F.zip_with(acc, F.try_element_at(weights, g), lambda a, b: a + b))
        return F.transform(z, lambda x: F.exp(F.least(F.greatest(x, F.lit(-300.0)), F.lit(300.0))))

    def judged(p: Column) -> Column:
        """What a window shows: each family that is likely and confirmed, or else unknown."""
        e, grams = p["e"], p["grams"]
        n_words = F.size(F.filter(grams, lambda g: ~F.contains(g, F.lit(" "))))
        licensing = lambda t: (t["size"] * 2 >= n_words) | F.arrays_overlap(grams, grants) | F.array_contains(grams, t["under"])
        holds = lambda t: (F.size(F.array_intersect(t["marks"], grams)) >= t["marked"]) & (F.size(F.array_intersect(t["pairs"], grams)) >= t["least"]) & (~t["naming"] | licensing(t))
        against = lambda f: F.try_element_at(e, f) / (F.try_element_at(e, f) + F.try_element_at(e, F.lit(k)))
        place = lambda family, chance: F.struct(*(p[c].alias(c) for c in ("nr", "span", "paragraph")), family.alias("family"), chance.alias("chance"))
        shown = F.filter(F.sequence(F.lit(1), F.lit(k - 1)), lambda f: (against(f) >= LIKELY) & F.exists(F.try_element_at(notices, f), holds))
        unknown = place(F.lit(UNKNOWN), F.try_element_at(e, F.lit(k)) / F.aggregate(e, F.lit(0.0), lambda a, x: a + x))
        return F.when(F.size(shown) > 0, F.transform(shown, lambda f: place(F.try_element_at(families, f), against(f)))).otherwise(F.array(unknown))

    lines, some = F.col(lines_), body.rlike(anchor) | body.rlike(signal)

    def window(i: Column, span: int) -> Column:
        held = F.slice(lines, i + 1, span)
        whole = (F.size(held) == span) & ~F.array_contains(F.slice(blank_, i + 1, span), True) if span > 1 else F.lit(True)
        return F.struct(i.alias("nr"), F.lit(span).alias("span"), F.when(whole, F.array_join(held, "\n")).alias("paragraph"))

    def paragraph(i: Column) -> Column:
        """All lines from one that begins a paragraph to the next blank one, if they are more than the other windows hold."""
        end = F.array_position(F.slice(blank_, i + 1, F.size(lines)), True).cast("int")
        begins = ~F.try_element_at(F.col(blank_), i + 1) & ((i == 0) | F.try_element_at(F.col(blank_), F.greatest(i, F.lit(1))))
        span = F.when(begins, F.when(end > 0, end - 1).otherwise(F.size(lines) - i)).otherwise(0)
        return F.transform(F.array(span), lambda n: F.struct(i.alias("nr"), n.alias("span"), F.when(n > WRAPPED, F.array_join(F.slice(lines, i + 1, n), "\n")).alias("paragraph")))[0]

    windows = F.flatten(F.transform(lines, lambda _, i: F.array(*(window(i, span) for span in range(1, WRAPPED + 1)), paragraph(i))))
    windows = F.filter(windows, lambda p: p["paragraph"].rlike(signal) | ((p["span"] == 1) & p["paragraph"].rlike(anchor)))
    read = F.transform(windows, lambda p: F.struct(*(p[c].alias(c) for c in ("nr", "span", "paragraph")), _grams(p["paragraph"]).alias("grams")))
    weighed = F.transform(read, lambda p: F.struct(*(p[c].alias(c) for c in ("nr", "span", "paragraph", "grams")), classified(p["grams"]).alias("e")))
    judgements = F.col(judged_)
    meet = lambda a, b: (a["nr"] < b["nr"] + b["span"]) & (b["nr"] < a["nr"] + a["span"])
    sure = lambda p: p["family"] != UNKNOWN

    def chosen(judgements: Column) -> Column:
        """Licences by the fewest lines that show them, and of those of one family that overlap the first."""
        rank = F.array_sort(F.filter(judgements, sure), lambda a, b: F.when(a["span"] != b["span"], a["span"] - b["span"]).otherwise(a["nr"] - b["nr"]))
        none = F.filter(rank, lambda _: F.lit(False))
        return F.aggregate(rank, none, lambda acc, p: F.when(F.exists(acc, lambda q: meet(p, q) & (p["family"] == q["family"])), acc).otherwise(F.concat(acc, F.array(p))))

    # Besides, a line with an anchor that no licence takes.
    other = F.filter(judgements, lambda p: ~sure(p) & (p["span"] == 1) & p["paragraph"].rlike(anchor) & ~F.exists(sure_, lambda q: meet(p, q)))
    found = F.array_sort(F.transform(F.concat(F.col(sure_), other), lambda p: F.struct(*(p[c].alias(c) for c in ("nr", "paragraph", "family", "chance")))))
    nothing = F.array().cast("array<struct<nr:int,paragraph:string,family:string,chance:double>>")
    split = df.withColumn(lines_, F.when(some, F.split(body, "\n"))).withColumn(blank_, F.transform(lines, lambda x: F.trim(F.translate(x, "\r\t", "  ")) == ""))
    judged_all = split.withColumn(judged_, F.flatten(F.transform(weighed, judged))).withColumn(sure_, chosen(judgements))
    return judged_all.withColumn(into, F.coalesce(found, nothing)).drop(lines_, blank_, judged_, sure_)


def license_report(df: DataFrame, text: str = "text", doc_id: str = "doc_id", model: Model | None = None) -> DataFrame:
    """One row per input row: doc_id, licenses (families found, sorted, comma-joined), n_found, n_unknown (paragraphs with an anchor that license nothing known).

    A null or empty text has none. Every row is kept, also one that repeats an id; texts are read whole, and an empty table gives an empty result.
    """
    found = find_licenses(df.select(F.col(f"`{doc_id}`").alias(doc_id), F.col(f"`{text}`").alias(text)), text, "__found", model)
    known = F.filter("__found", lambda p: p["family"] != UNKNOWN)
    return found.select(
        F.col(doc_id).alias("doc_id"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(known, lambda p: p["family"]))), ",").alias("licenses"),
        F.size(known).cast("long").alias("n_found"),
        (F.size("__found") - F.size(known)).cast("long").alias("n_unknown"),
    )
