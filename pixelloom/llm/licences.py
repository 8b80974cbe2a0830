"""Licence scans by a trained paragraph classifier. DataFrame functions only over the corpus.

Logistic regressions on sparse word n-grams, one that a paragraph states a licence and one for each family, are fitted to the
templates below, to changed copies and to pairs of them, against other prose. Their weights are a small table. Documents are
cut into paragraphs, hard-wrapped lines joined, and into words in Spark; their n-grams are met with that table in one pass.
A paragraph may state several families. A family counts if its calibrated probability is high enough and enough of one of
its templates stands in the paragraph or in one of its lines; licence-like paragraphs beyond that are of the class unknown.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.common import written

#: Short and long statements of licence families.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License, see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "SPDX-License-Identifier: MIT",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Unless required by applicable law or agreed to in writing, Licensor provides the Work on an AS IS BASIS, and each Contributor provides its Contributions on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GNU GPL, version 3.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Released under the GNU Affero General Public License, version 3 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "Licensed under the GNU AGPL, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Released under the GNU Lesser General Public License, version 3 or later.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Licensed under the GNU LGPL, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS",
        "SPDX-License-Identifier: ISC",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "Released under CC0 1.0 Universal.",
    ],
}
#: Prose that isn't a licence, in licences' own words, and statements of licences that are none of these.
OTHER = [
    "The version of the story that the author told was free of any charge.",
    "The driver lost his license after the accident and had to walk to work.",
    "See the file for details of the work that was released in the spring.",
    "The software was released last year and the following list of changes was published.",
    "A copy of the letter was included in the book under a different title.",
    "The terms of the agreement were not met and the parties were notified in writing.",
    "The general public was permitted to use the library without limitation.",
    "He was granted permission to publish the source of the notice in any form.",
    "The conditions in the kitchen of the restaurant were better than expected.",
    "It is a work of art that is subject to interpretation by the public.",
    "The committee received written comments in accordance with the rules of the house.",
    "Sales of the product in this region are limited to the spring and summer.",
    "For more details about the event, see the list that was published on the page.",
    "You can use the files in any order and modify the names if you want to.",
    "The warranty on the car covers the engine and the parts for two years.",
    "Under the new law the court may require notice of any claim for damages.",
    "The foundation was free to publish the book in the form that the author chose.",
    "Copyright was the subject of a long debate in the eighteenth century.",
    "The commons was open to all people of the village for any purpose.",
    "She read the software manual, made a copy of one page and left the library.",
]
UNKNOWN = [
    "Licensed under the Sample Corporate License, version 7.",
    "This work is licensed under the terms of a separate agreement.",
    "All rights reserved. No part of this work may be reproduced without written permission.",
    "Released under a proprietary license; contact the author for terms.",
    "Use of this product is governed by the end user license agreement.",
    "Licensed to the customer under the Enterprise License.",
    "Distribution of this document is permitted only with the written consent of the copyright holder.",
    "This file is subject to the terms and conditions defined in a license that is part of the source code package.",
    "Use, reproduction and distribution are permitted under the terms of the Community License Agreement.",
    "Copyright by the author. All rights reserved.",
    "Licensed under the Custom Research License for non-production use.",
    "By downloading the software you accept the terms of this license agreement.",
]
#: The first is that a paragraph states a licence at all.
CLASSES = ["licence", *TEMPLATES]
STOP = frozenset("a an and any as at be by can from for if in is it may not of on or that the this to was were with you".split())
#: Changed copies of each text, pairs of texts, parts into which texts are dealt for calibration, and steps of the fit.
COPIES, PAIRS, FOLDS, STEPS, RATE, PENALTY = 10, 300, 3, 150, 2.0, 2e-4
#: A family is accepted from this calibrated probability on, and from this share of a template on, its n-grams weighed by rarity.
PROBABILITY, SHARE = 0.5, 0.6

#: Words are runs of ASCII letters; digits and signs part them.
_word = re.compile(r"[a-z]+").findall


def grams(text: str) -> list[str]:
    """Single words and pairs of words in a row, but not those of common words alone."""
    words = _word(text.lower())
    return [w for w in words if w not in STOP] + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a not in STOP or b not in STOP]


def changed(text: str, rng: random.Random) -> str:
    """A copy with some words left out or put in, and sometimes only a part of it."""
    words = text.split()
    if len(words) > 12 and rng.random() < 0.3:
        n = rng.randrange(8, len(words))
        at = rng.randrange(len(words) - n + 1)
        words = words[at : at + n]
    words = [w for w in words if rng.random() > 0.05] or words
    return " ".join(x for w in words for x in ([w, rng.choice(OTHER).split()[0]] if rng.random() < 0.03 else [w]))


def examples(sources: list[tuple[str, str]], rng: random.Random) -> list[tuple[set[str], str]]:
    """Texts with the classes they state: the given ones, changed copies, and pairs of them, some with prose between."""
    marks = lambda c: set() if c == "other" else {"licence"} if c == "unknown" else {"licence", c}
    rows = [(marks(c), t if k == 0 else changed(t, rng)) for c, t in sources for k in range(COPIES)]
    for _ in range(PAIRS):
        (c, t), (d, u) = rng.choice(sources), rng.choice(sources)
        rows.append((marks(c) | marks(d), f"{t} {rng.choice(OTHER)} {u}" if rng.random() < 0.5 else f"{t} {u}"))
    return rows


def features(texts: list[str], place: dict[str, int]) -> np.ndarray:
    """Known n-grams of each text, each text of length one."""
    x = np.zeros((len(texts), len(place)))
    for i, t in enumerate(texts):
        found = [place[g] for g in set(grams(t)) if g in place]
        x[i, found] = 1 / max(1.0, len(found)) ** 0.5
    return x


def fitted(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and constants of one logistic regression a class; both sides of each weigh the same."""
    weight = np.where(y > 0, 0.5 / np.maximum(1, y.sum(axis=0)), 0.5 / np.maximum(1, (1 - y).sum(axis=0)))
    w, b, vw, vb = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1]), 0.0, 0.0
    for _ in range(STEPS):
        slope = weight * (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y)
        vw = 0.9 * vw - RATE * (x.T @ slope + PENALTY * w)
        vb = 0.9 * vb - RATE * slope.sum(axis=0)
        w, b = w + vw, b + vb
    return w, b


@functools.lru_cache(maxsize=1)
def model() -> tuple[dict[str, list[float]], list[float], list[tuple[float, float]]]:
    """Weights per n-gram and class, constants, and per class the scale and shift that calibrate its probabilities.

    Calibration is on texts that the fit hasn't seen, nor copies of them: the sources are dealt into folds, each scored by a
    fit to the others. About 1,300 short texts are fitted on the driver; their number is fixed by the lists above and
    ``COPIES`` and ``PAIRS``.
    """
    sources = [(c, t) for c, texts in {"other": OTHER, "unknown": UNKNOWN, **TEMPLATES}.items() for t in texts]
    place = {g: i for i, g in enumerate(sorted({g for _, t in sources for g in grams(t)}))}

    def table(some: list[tuple[str, str]], seed: int) -> tuple[np.ndarray, np.ndarray]:
        rows = examples(some, random.Random(seed))
        return features([t for _, t in rows], place), np.array([[float(c in marks) for c in CLASSES] for marks, _ in rows])

    unseen = []
    for fold in range(FOLDS):
        w, b = fitted(*table([s for i, s in enumerate(sources) if i % FOLDS != fold], fold))
        x, y = table([s for i, s in enumerate(sources) if i % FOLDS == fold], FOLDS + fold)
        unseen.append((x @ w + b, y))
    z, y = (np.concatenate([u[i] for u in unseen]) for i in range(2))
    calibration = []
    for k in range(len(CLASSES)):
        loss = lambda a, c, k=k: float(np.logaddexp(0, np.where(y[:, k] > 0, -1, 1) * (a * z[:, k] + c)).mean() + 1e-3 * (a * a + c * c))
        calibration.append(min(((a, c) for a in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0) for c in (-2.0, -1.4, -1.0, -0.7, -0.5, -0.3, 0.0, 0.3)), key=lambda p: loss(*p)))
    w, b = fitted(*table(sources, 2 * FOLDS))
    return {g: [round(float(v), 6) for v in w[i]] for g, i in place.items()}, [float(v) for v in b], calibration


def gram_key(g: Column) -> Column:
    """An n-gram's key: the hash of a word, or of the hashes of a pair's words."""
    first, second = F.xxhash64(F.split_part(g, F.lit(" "), F.lit(1))), F.xxhash64(F.split_part(g, F.lit(" "), F.lit(2)))
    return F.when(F.contains(g, F.lit(" ")), F.xxhash64(first, second)).otherwise(first)


@functools.lru_cache(maxsize=1)
def templates() -> list[tuple[str, dict[str, float]]]:
    """Family and n-grams of each template, each n-gram with its part of the template: the more, the fewer classes have it."""
    texts = {"other": OTHER, "unknown": UNKNOWN, **TEMPLATES}
    classes = Counter(g for some in texts.values() for g in {g for t in some for g in grams(t)})
    rarity = {g: math.log((len(texts) + 1) / n) for g, n in classes.items()}
    sets = [(family, set(grams(t))) for family, some in TEMPLATES.items() for t in some]
    return [(family, {g: rarity[g] / sum(rarity[x] for x in found) for g in sorted(found)}) for family, found in sets]


def tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(gram, w) and (gram, template, family, part): a few thousand rows, fixed by the templates."""
    weights, _, _ = model()
    scored = spark.createDataFrame([(g, w) for g, w in weights.items()], "g string, w array<double>")
    pieces = [(g, k, family, part) for k, (family, parts) in enumerate(templates()) for g, part in parts.items()]
    kept = spark.createDataFrame(pieces, "g string, template int, family string, part double")
    keyed = lambda t: t.withColumn("gram", gram_key(F.col("g"))).drop("g")
    return keyed(scored), keyed(kept)


def held(expression: Column, name: str) -> Column:
    """A computed array as a row's own value, so that functions over its elements don't compute it anew for each."""
    return F.explode(F.array(expression)).alias(name)


def known_grams(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(row, paragraph, line, gram): the distinct n-grams of the table in each paragraph and each of its lines, of every whole text.

    Paragraphs are parted by blank lines, and their lines joined, so that a pair of words may stand across a line's end.
    ``line`` is -1 for the whole paragraph.
    """
    blocks = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.posexplode(F.split(F.lower("text"), r"\n[ \t\r\f\x0B]*\n")).alias("paragraph", "said"))
    hashed = F.transform(F.split("said", "\n"), lambda line, i: F.transform(F.regexp_extract_all(line, F.lit("([a-z]+)"), F.lit(1)), lambda w: F.struct(F.xxhash64(w).alias("h"), i.alias("i"))))
    words = blocks.select("row", "paragraph", held(F.flatten(hashed), "words"))
    n = F.greatest(F.size("words") - 1, F.lit(0))
    single = F.transform("words", lambda w: F.struct(w["h"].alias("gram"), w["i"].alias("line")))
    pair = F.zip_with(F.slice("words", 1, n), F.slice("words", 2, n), lambda a, b: F.struct(F.xxhash64(a["h"], b["h"]).alias("gram"), F.when(a["i"] == b["i"], a["i"]).alias("line")))
    each = words.select("row", "paragraph", F.explode(F.concat(single, pair)).alias("g")).select("row", "paragraph", "g.gram", "g.line")
    # The table is fixed by the templates above: a few thousand keys at any size of corpus.
    met = each.join(F.broadcast(known.select("gram")), "gram")
    return met.select("row", "paragraph", F.explode(F.array(F.lit(-1), "line")).alias("line"), "gram").where("line is not null").distinct()


def paragraphs(docs: DataFrame) -> DataFrame:
    """(row, paragraph, families, probability) of the paragraphs that state a licence; families is empty where none is confirmed.

    ``probability`` is that the paragraph, or the one of its lines that looks most like one, states a licence at all.
    """
    spark = docs.sparkSession
    scored, kept = tables(spark)
    _, constants, calibration = model()
    unit = ["row", "paragraph", "line"]
    found = written(known_grams(docs, scored), "grams")
    sums = found.join(F.broadcast(scored), "gram").groupBy(*unit).agg(*(F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(len(CLASSES))), F.count("*").alias("known")).where("known >= 2")
    p = [1 / (1 + F.exp(-(a * (F.col(f"z{i}") / F.sqrt("known") + constants[i]) + c))) for i, (a, c) in enumerate(calibration)]
    likely = sums.select(*unit, p[0].alias("probability"), F.array(*(F.when(x >= PROBABILITY, F.lit(c)) for c, x in zip(CLASSES[1:], p[1:], strict=True))).alias("likely"))
    shares = found.join(F.broadcast(kept), "gram").groupBy(*unit, "family", "template").agg(F.sum("part").alias("share")).where(F.col("share") >= SHARE)
    confirmed = shares.groupBy(*unit).agg(F.collect_set("family").alias("confirmed"))
    told = likely.join(confirmed, unit, "left").select("row", "paragraph", "probability", F.array_intersect("likely", F.coalesce("confirmed", F.array().cast("array<string>"))).alias("families"))
    each = told.groupBy("row", "paragraph").agg(F.max("probability").alias("probability"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))).alias("families"))
    return each.where((F.size("families") > 0) | (F.col("probability") >= PROBABILITY))


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, families (sorted, without unknown ones), n_licence and n_unknown paragraphs.

    Null and empty texts have none. Repeated rows and null doc_ids stay, and have the same counts each; further columns are
    ignored; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    sure = F.size("families") > 0
    each = paragraphs(docs).groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))).alias("found"), F.count(F.when(sure, 1)).alias("sure"), F.count(F.when(~sure, 1)).alias("unsure"))
    out = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row")).join(each, "row", "left")
    return out.select("doc_id", F.array_join(F.coalesce("found", F.array().cast("array<string>")), ",").alias("families"), F.coalesce("sure", F.lit(0)).cast("long").alias("n_licence"), F.coalesce("unsure", F.lit(0)).cast("long").alias("n_unknown"))
