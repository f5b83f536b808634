"""Licence notices: siblings, wrapped notices, real prose, scores against a plain numpy copy."""

import numpy as np
import pytest

from orderlens.llm import license_scan as scan

SF = "/root/testdata/sf0.001"

NOTICES = [
    ("GNU GENERAL PUBLIC LICENSE, Version 2", "gpl-2.0"),
    ("This file is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.", "gpl-2.0"),
    ("This file is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License.", "agpl-3.0"),
    ("This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "lgpl-2.1"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa-4.0"),
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa-4.0"),
    ("Licensed under CC BY 4.0.", "cc-by-4.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
    ("Licensed under the Apache License, Version 1.1.", "apache-1.1"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("Released under the ISC License.", "isc"),
    ("Released under the MIT License.", "mit"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
]
STRANGERS = [
    "Licensed under the Eclipse Public License, version 1.0.",
    "Licensed under the Apache License, Version 9.9.",
    "My driving license is new and the public likes it.",
    "The software version was free.",
    "A work of art by the foundation.",
]
WRAPPED = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 */
int main() { return 0; }"""


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sample = scan.corpus_sample(docs)
    assert len(sample) <= scan.SAMPLE and sample == scan.corpus_sample(docs.repartition(7))
    return scan.fit_licenses(sample)


def notices(spark, texts, model):
    rows = [(k, t, "x", 1.0) for k, t in enumerate(texts)]
    return scan.licence_notices(spark.createDataFrame(rows, "doc_id long, text string, family string, scores double"), model).collect()


def test_siblings_are_told_apart_and_confirmed_only_by_their_marks(spark, model):
    got = {r.doc_id: (r.family, r.confirmed) for r in notices(spark, [t for t, _ in NOTICES], model)}
    assert {k: v[0] for k, v in got.items()} == {k: f for k, (_, f) in enumerate(NOTICES)}
    assert all(v[1] for k, v in got.items() if k > 0)
    assert not [r for r in notices(spark, STRANGERS, model) if r.confirmed]


def test_wrapped_and_commented_notice_is_one_licence(spark, model):
    got = notices(spark, [WRAPPED, WRAPPED.replace("\n", "\r\n")], model)
    assert {(r.doc_id, r.family, r.confirmed) for r in got} == {(0, "apache-2.0", True), (1, "apache-2.0", True)}
    assert sum(r.doc_id == 0 for r in got) == sum(r.doc_id == 1 for r in got) <= 3
    assert any("Version 2.0" in r.text and "compliance" in r.text for r in got)


def test_probabilities_equal_a_plain_copy_of_the_model(spark, model):
    place = {g: k for k, g in enumerate(model.features)}
    texts = [t for t, _ in NOTICES] + STRANGERS
    got = {r.doc_id: r for r in notices(spark, texts, model)}
    for k, text in enumerate(texts):
        words = scan._words(text)
        held = [place[g] for g in {*words, *scan._pairs(words)} if g in place]
        score = model.weights[held].astype(float).sum(axis=0) + model.bias.astype(float)
        chance = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        best = int(chance.argmax())
        reported = model.families[best] != scan.UNKNOWN and chance[best] >= scan.MIN_PROBABILITY
        assert (k in got) == reported, text
        if reported:
            assert got[k].family == model.families[best] and got[k].probability == pytest.approx(chance[best], abs=1e-5)


def test_long_texts_repeated_rows_and_nulls(spark, model):
    long = "some plain words here. \n" * 40_000 + "Released under the MIT License."
    got = notices(spark, [long, "Released under the MIT License.", "Released under the MIT License.", None, "", "\n\n"], model)
    assert sorted((r.doc_id, r.paragraph, r.family) for r in got) == [(0, 40_000, "mit"), (1, 0, "mit"), (2, 0, "mit")]


def test_every_planted_line_is_found_and_prose_left_alone(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lines = docs.selectExpr("doc_id", "explode(split(text, '\n')) l").where("lower(l) rlike 'licensed? under|license[.]'")
    want = {(r.doc_id, r.l) for r in lines.collect()}
    got = {(r.doc_id, r.text) for r in scan.licence_notices(docs, model).where("confirmed").collect()}
    assert got == want


def test_lines_are_joined_as_before(spark):
    long = "a" * 40
    texts = {
        f"{long}b\nNext": [f"{long}b Next"],
        f"{long}.\nNext": [f"{long}.", "Next"],
        "short\nNext": ["short", "Next"],
        "short\n  next": ["short   next"],
        "short.\nnext": ["short.", "next"],
        f"{long}b\n\nNext": [f"{long}b", "", "Next"],
        f"one\ntwo\n(three)\n{long}b\nFour": [f"one two (three) {long}b Four"],
        "\nnext\n": ["", "next", ""],
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scan.paragraphs(scan.F.col("t")).alias("p")).collect()
    assert {r.t: r.p for r in rows} == texts


def test_words_and_scores_are_computed_once(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    plan = scan.licence_notices(docs, scan.fit_licenses())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("zip_with(lambda") <= 1
