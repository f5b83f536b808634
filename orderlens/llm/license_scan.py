"""Licence notices by a trained paragraph classifier, confirmed against templates.

1. A paragraph is a block of lines: marks of comments at the start of a line go, and
   a line goes on in the next one if that begins in lower case, or if the line has
   over WRAP characters and ends in no full stop, colon or the like. So a notice
   wrapped by an editor is one paragraph. Empty lines count as paragraphs.
2. Features are the words and word pairs of the templates below that hold at
   least one content word. A paragraph's features are the set of these it holds.
3. Multinomial logistic regression over the families and an unknown class. Siblings
   (versions, lesser and Affero forms, the Creative Commons terms) are families of
   their own. A family learns from its templates, their cuttings and thinned copies
   that still hold the marks of the family; the unknown class from other licences,
   from mixed words and from paragraphs of the corpus that are like no template:
   of the SAMPLE distinct ones with a content word and smallest hash. Half of
   the corpus sample and copies held out fit a temperature, so the probability of the
   unknown class is calibrated on real text.
4. A paragraph is reported if a family is likelier than unknown and reaches
   MIN_PROBABILITY. `similarity` is the largest, over the family's templates, of the
   share of the paragraph's word pairs that the template holds and, for templates of
   at least LONG pairs, of the share of the template's pairs that the paragraph holds.
   It is `confirmed` if a template reaches MIN_SIMILARITY and the paragraph holds
   exactly the distinguishing marks (names and versions) of that template.

Every text is scored, by DataFrame expressions; a paragraph without content word has no
feature, scores the bias alone, which is unknown, and need not be scored. Only the
features of the bounded sample reach the driver.

Cases: null and empty texts and empty paragraphs have no notice. Repeated rows are
reported each. A null doc_id is reported as null. An empty table gives no rows.
Extra columns are ignored. A text of any length is one row until it is split.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_PROBABILITY = 0.5
MIN_SIMILARITY = 0.6
LONG = 8
WRAP = 40
SAMPLE = 2_000
UNLIKE = 0.3
UNKNOWN = "unknown"

# Well-known notices of licence families.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "This project is licensed under the Apache 2.0 license."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("apache-1.1", "The Apache Software License, Version 1.1"),
    ("mit", "Released under the MIT License."),
    ("mit", "The MIT License (MIT)"),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("isc", "Released under the ISC License."),
    ("isc", "Licensed under the ISC license."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl", "This work is licensed under the GNU General Public License."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "Licensed under the GPL-2.0."),
    ("gpl-2.0", "Released under the GPLv2 license."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "Licensed under the GPL-3.0."),
    ("gpl-3.0", "Released under the GPLv3 license."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd-2-clause", "Licensed under the BSD 2-Clause License."),
    ("bsd-3-clause", "Licensed under the BSD 3-Clause License."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]
# Texts of no family above that share its words.
OTHERS = [
    "Licensed under the Eclipse Public License, version 2.0.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the European Union Public License, version 1.2.",
    "This software is provided as is, without any express or implied warranty.",
    "All rights reserved. No part of this work may be copied without written permission.",
    "The license fee is due each year and covers all versions of the software.",
    "Copyright by the author. Use of this file is subject to the terms of service.",
    "The public library is free for any person.",
]
# Words too common to be a feature by themselves.
COMMON = (
    "a all an and any are as at be by can do either for found from has have i if in including is it its later may met not of on one"
    " or should that the their this to under use used was we were will with without you your"
).split()
# Words and word pairs that tell a licence from its siblings.
MARKS = (
    ["1.0", "1.1", "1.2", "2.0", "2.1", "3.0", "4.0", "version 1", "version 2", "version 3", "2 clause", "3 clause"]
    + "affero agpl apache boost bsd cc cc0 eclipse european gnu gpl gplv2 gplv3 isc lesser lgpl mit mozilla mpl".split()
    + "nc nd noncommercial noderivatives noderivs sa sharealike".split()
)

_WORD = re.compile("[a-z0-9.]*[a-z0-9]")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _pairs(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def _content(words: list[str]) -> set[str]:
    return {w for w in words if w not in COMMON and not w.replace(".", "").isdigit()}


def _marks(words: list[str]) -> set[str]:
    return {*words, *_pairs(words)} & set(MARKS)


@dataclass(frozen=True)
class LicenseModel:
    families: list[str]  # the last is UNKNOWN
    features: list[str]
    weights: np.ndarray  # feature x family, divided by the temperature
    bias: np.ndarray


def _vocabulary() -> tuple[list[str], list[str]]:
    """Content words of the templates, and the features: words and word pairs that hold one."""
    texts = [_words(t) for _, t in TEMPLATES]
    content = sorted(set().union(*map(_content, texts)))
    held = set(content)
    return content, sorted({g for words in texts for g in (*words, *_pairs(words)) if held & set(g.split(" "))})


def _copies(rng: np.random.Generator, families: list[str], vocabulary: list[str]) -> list[tuple[int, list[str]]]:
    """Templates, cuttings and thinned copies by family; other licences and mixed words for the unknown class."""
    unknown = families.index(UNKNOWN)
    out: list[tuple[int, list[str]]] = [(unknown, [])]
    for family, text in [*TEMPLATES, *((UNKNOWN, text) for text in OTHERS)]:
        words, label = _words(text), families.index(family)
        out.append((label, words))
        for _ in range(12):
            size = int(rng.integers(min(len(words), max(4, len(words) // 2)), len(words) + 1))
            at = int(rng.integers(0, len(words) - size + 1))
            for copy in (words[at : at + size], [w for w in words if rng.random() > 0.15]):
                # A copy that lost a name or version may be one of a sibling.
                if label == unknown or _marks(copy) == _marks(words):
                    out.append((label, copy))
    for _ in range(20 * len(TEMPLATES)):
        out.append((unknown, list(rng.choice(vocabulary, int(rng.integers(1, 5))))))
    for word in vocabulary:
        out.extend([(unknown, [word]), (unknown, ["the", word]), (unknown, ["a", word, "of"])])
    return out


def _table(copies: list[tuple[int, list[str]]], sample: list[list[str]], unknown: int, place: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of copies (words) and of a corpus sample (features)."""
    held = [{*words, *_pairs(words)} for _, words in copies] + [set(grams) for grams in sample]
    x = np.zeros((len(held), len(place)), dtype=np.float32)
    for row, grams in enumerate(held):
        x[row, [place[g] for g in grams if g in place]] = 1
    return x, np.array([label for label, _ in copies] + [unknown] * len(sample))


def _softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_licenses(sample: list[list[str]] = ()) -> LicenseModel:
    """Fit on the templates and on `sample`: for each paragraph of no licence, the features it holds."""
    families = [*dict.fromkeys(f for f, _ in TEMPLATES), UNKNOWN]
    unknown = len(families) - 1
    content, grams = _vocabulary()
    place = {g: k for k, g in enumerate(grams)}
    x, y = _table(_copies(np.random.default_rng(1), families, content), sample[::2], unknown, place)
    w, b = np.zeros((len(grams), len(families)), np.float32), np.zeros(len(families), np.float32)
    truth = np.eye(len(families), dtype=np.float32)[y]
    for _ in range(400):
        off = (_softmax(x @ w + b) - truth) / len(y)
        w -= 4.0 * (x.T @ off + 1e-4 * w)
        b -= 4.0 * off.sum(axis=0)
    x, y = _table(_copies(np.random.default_rng(2), families, content), sample[1::2], unknown, place)
    score = x @ w + b
    loss = lambda t: -np.log(_softmax(score / t)[np.arange(len(y)), y] + 1e-12).mean()
    t = min((k / 20 for k in range(5, 61)), key=loss)
    return LicenseModel(families, grams, w / t, b / t)


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _numbers(values: np.ndarray) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def paragraphs(text: Column) -> Column:
    """Paragraphs of a text: lines without marks of comments, wrapped ones joined by a space."""
    lines = F.regexp_replace(text, "\r\n?", "\n")
    lines = F.regexp_replace(lines, r"(?m)^[ \t]*(?:#+|//+|/?\*+/?|--+|;+|<!--+)[ \t]*|[ \t]+$", "")
    # The line feed stands first: what is before it is looked at only there, not at every letter.
    wrapped = r"\n(?:(?<=[^\n]{%d}[^.!?:\n]\n)(?=[^\n])|(?<=[^.!?:\n]\n)(?=[ \t]*[a-z(]))" % WRAP
    return F.split(F.regexp_replace(lines, wrapped, " "), "\n")


def _once(rows: DataFrame, *columns: Column) -> DataFrame:
    """`rows` with new columns that a later condition reads as they are, where a plain column would be computed again for it."""
    return rows.select("*", F.inline(F.array(F.struct(*columns))))


def _scored_paragraphs(docs: DataFrame) -> DataFrame:
    """Paragraphs that hold a content word, with words, pairs and the features they hold."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9.]*[a-z0-9])"), F.lit(1))
    pairs = lambda c: F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.size(c)), lambda a, b: F.concat(a, F.lit(" "), b))
    content, features = _vocabulary()
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = told.select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("paragraph", "text"))
    lines = _once(lines, words("text").alias("words")).where(F.exists("words", lambda w: w.isin(content)))
    lines = _once(lines, pairs(F.col("words")).alias("pairs"))
    return _once(lines, F.array_distinct(F.filter(F.concat("words", "pairs"), lambda g: g.isin(features))).alias("held"))


def _templates() -> Column:
    """Family, word pairs and marks of each template."""
    told = [(f, _words(t)) for f, t in TEMPLATES]
    return F.array(*(
        F.struct(F.lit(f).alias("f"), _texts(sorted(set(_pairs(w)))).alias("p"), _texts(sorted(_marks(w))).alias("m")) for f, w in told
    ))


def _likeness(pairs: Column, template: Column) -> Column:
    shared = F.size(F.array_intersect(pairs, template["p"]))
    of_template = F.when(F.size(template["p"]) >= LONG, shared / F.size(template["p"])).otherwise(F.lit(0.0))
    return F.when(F.size(pairs) > 0, F.greatest(shared / F.size(pairs), of_template)).otherwise(F.lit(0.0))


def corpus_sample(docs: DataFrame) -> list[list[str]]:
    """Features held by those of the SAMPLE distinct paragraphs of smallest hash that are like no template.

    Paragraphs are told apart and chosen by the hash of their text, so the sample is
    the same for any partitioning. They are compared with the templates after the
    choice. Texts stay in Spark; one list holds at most all features.
    """
    lines = _scored_paragraphs(docs).where(F.size("held") > 0)
    chosen = lines.select(F.xxhash64("text").alias("h"), F.array_sort("held").alias("held"), "pairs")
    chosen = chosen.dropDuplicates(["h"]).orderBy("h").limit(SAMPLE)
    pairs = F.array_distinct("pairs")
    like = F.array_max(F.transform(_templates(), lambda t: _likeness(pairs, t)))
    return [r["held"] for r in chosen.where(like < UNLIKE).select("h", "held").orderBy("h").collect()]


def licence_notices(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """A row for each notice: doc_id, paragraph (from 0), text, family, probability, similarity, confirmed.

    Without a model, one is fitted on the templates and on a sample of `docs`.
    """
    model = model or fit_licenses(corpus_sample(docs))
    found = _scored_paragraphs(docs)
    weight = F.create_map(*(x for g, row in zip(model.features, model.weights) for x in (F.lit(g), _numbers(row))))
    scores = F.aggregate("held", _numbers(model.bias), lambda s, g: F.zip_with(s, weight[g], lambda a, b: a + b))
    found = _once(found, scores.alias("scores"))
    found = _once(found, F.array_max("scores").alias("top"))
    chance = F.lit(1.0) / F.aggregate("scores", F.lit(0.0), lambda t, v: t + F.exp(v - F.col("top")))
    family = F.element_at(_texts(model.families), F.array_position("scores", F.col("top")).cast("int"))
    found = _once(found, family.alias("family"), chance.alias("probability"))
    found = found.where((F.col("family") != UNKNOWN) & (F.col("probability") >= MIN_PROBABILITY))

    marks = F.array_intersect(F.concat("words", "pairs"), _texts(MARKS))
    same = lambda t: (F.size(F.array_except(marks, t["m"])) == 0) & (F.size(F.array_except(t["m"], marks)) == 0)
    own = F.filter(_templates(), lambda t: t["f"] == F.col("family"))
    pairs = F.array_distinct("pairs")
    met = F.transform(own, lambda t: F.struct(_likeness(pairs, t).alias("s"), same(t).alias("same")))
    found = found.withColumn("met", met)
    return found.select(
        "doc_id", "paragraph", "text", "family", "probability",
        F.array_max(F.transform("met", lambda t: t["s"])).alias("similarity"),
        F.exists("met", lambda t: t["same"] & (t["s"] >= MIN_SIMILARITY)).alias("confirmed"),
    )
