"""Every stage on awkward rows: nulls, empty and long texts, repeated rows, clashing columns, an empty table."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from orderlens.llm import line_dedup

rng = random.Random(8)
WORDS = [f"term{k}" for k in range(300)]
say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
ITEM, BLOCK, PLAIN = say(20), "\n".join(say(12) for _ in range(3)), say(80)
ROWS = [
    (1, PLAIN, "en"),
    (2, PLAIN, "en"),  # an exact copy
    (2, PLAIN, "en"),  # a repeated row
    (3, BLOCK + "\n" + say(30), "en"),
    (4, say(30) + "\n" + BLOCK + "\nends so", None),
    (5, None, "en"),
    (6, "", "en"),
    (7, say(40) + " " + ITEM + " " + say(40), "en"),
    (8, "yes no", "en"),
    (9, say(60_000), "en"),
    (None, say(30), "en"),
] + [(100 + k, say(30) + (" vile nasty" if k % 2 else ""), "en") for k in range(200)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rejected string, severity int, n_lines string, grade string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(100 + k, k % 2) for k in range(200)] + [(None, 1), (5, None)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, "yes no"), (3, None), (4, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, "s", len(t) if t else None, "mine", 7, "mine", "mine") for i, t, g in ROWS], SCHEMA)


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_a_stage_keeps_columns_and_clean_rows(spark, docs, folder, name):
    out = STAGES[name](spark, docs, folder)
    assert out.schema.simpleString() == docs.schema.simpleString()
    rows = out.collect()
    assert all((r.rejected, r.severity, r.n_lines, r.grade) == ("mine", 7, "mine", "mine") for r in rows)
    gone = {
        "toxicity": {100 + k for k in range(1, 200, 2)},
        "line dedup": {2},
        "near dedup": {2},
        "decontamination": {7},
    }[name]
    kept = {r.doc_id for r in rows}
    clean = {i for i, *_ in ROWS} - gone
    assert clean <= kept and not gone & kept
    if name == "line dedup":
        by_id = {r.doc_id: r for r in rows}
        assert BLOCK.split("\n")[1] in by_id[3].text and BLOCK.split("\n")[1] not in by_id[4].text and "ends so" in by_id[4].text
        assert by_id[4].n_chars == len(by_id[4].text)
    assert STAGES[name](spark, docs.where("false"), folder).count() == 0


def test_packing_stage_places_every_document(spark, docs, folder):
    out = STAGES["packing"](spark, docs, folder).collect()
    assert sorted(str(r.doc_id) for r in out if r.piece == 0) == sorted(str(i) for i, *_ in ROWS)
    assert STAGES["packing"](spark, docs.where("false"), folder).count() == 0


def test_very_long_copies_take_one_pass(spark):
    text = "\n".join(f"line {k} of a text in which no line comes twice" for k in range(200_000))
    frame = spark.createDataFrame([(1, text), (2, text + "\nthe end")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.lines_removed) for r in line_dedup.deduplicated_lines(frame).collect()}
    assert got == {1: (text, 0), 2: ("the end", 200_000)}
