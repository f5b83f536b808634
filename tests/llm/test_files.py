"""Intermediate tables of few rows go to few files, whatever the number of shuffle partitions."""

from pathlib import Path

import pytest

from orderlens.llm.graph import components
from orderlens.llm.store import FILE_ROWS, saved, shared_folder


@pytest.fixture
def many_partitions(spark):
    keys = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _tables(spark, name):
    folder = Path(shared_folder(spark).removeprefix("file://").removeprefix("file:"))
    return {p: len(list(p.glob("part-*"))) for p in folder.glob(f"{name}-*")}


def test_rounds_of_components_write_a_file_each(spark, many_partitions):
    before = _tables(spark, "links")
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (102, 102)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    new = {p: n for p, n in _tables(spark, "links").items() if p not in before}
    assert new and set(new.values()) == {1}


def test_components_of_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert components(spark.createDataFrame([(5, 5)], "a long, b long")).collect() == []


def test_saved_table_has_files_for_its_rows(spark):
    rows = spark.range(0, 2 * FILE_ROWS, numPartitions=16)
    assert saved(rows, "few", 2 * FILE_ROWS).count() == 2 * FILE_ROWS
    assert set(_tables(spark, "few").values()) == {3}
