import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderlens.functions.frames import planned_input_bytes
from orderlens.operators.quantiles import (
    describe_numeric,
    exact_quantiles,
    order_statistics,
    quantile_row,
    winsorize,
)
from orderlens.operators.rfm import qcut_score, qcut_scores

PROBS = [0.0, 0.05, 0.2, 0.5, 0.77, 0.95, 1.0]


def longs(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x bigint")


def samples():
    rng = random.Random(7)
    big = 2**53
    return {
        "one": [42],
        "two": [5, 9],
        "constant": [3] * 50,
        "around_zero": [rng.randint(-3, 3) for _ in range(400)],
        "symmetric": [rng.randint(-10**12, 10**12) for _ in range(2000)],
        "extremes": [-big, big, 0, 1, -1] + [rng.randint(0, 100) for _ in range(300)],
        "nested_outliers": [10**k for k in range(16)] * 3 + list(range(500)),
        "dense_large": [big - i for i in range(3000)],
        "one_value_holds_a_third": [77] * 700 + [rng.randint(0, 10**9) for _ in range(1400)],
        "powers": [s * 2**k + d for k in range(53) for d in (-1, 0, 1) for s in (1, -1)],
    }


@pytest.mark.parametrize("name", sorted(samples()))
def test_counting_search_is_exact(spark, name):
    values = samples()[name]
    df = longs(spark, values + [None])
    got = {
        (r["prob"]): r
        for r in order_statistics(df, {"x": F.col("x")}, PROBS, descend=True).collect()
    }
    ordered = sorted(values)
    for p in PROBS:
        position = (len(ordered) - 1) * p
        assert got[p]["n"] == len(ordered)
        assert got[p]["lo"] == ordered[int(np.floor(position))]
        assert got[p]["hi"] == ordered[int(np.ceil(position))]


def test_both_methods_and_numpy_agree(spark):
    rng = random.Random(3)
    values = [rng.randint(-10**6, 10**6) for _ in range(1234)]
    df = longs(spark, values)
    columns = {"x": (F.col("x"), 100.0)}
    suffixes = {f"p{i}": p for i, p in enumerate(PROBS)}
    slow, fast = (quantile_row(df, columns, suffixes, descend=d).first() for d in (True, False))
    for suffix, p in suffixes.items():
        want = np.quantile(np.array(values) / 100.0, p)
        assert slow[f"x_{suffix}"] == fast[f"x_{suffix}"] == pytest.approx(want, abs=1e-6)
    assert slow["x_n"] == fast["x_n"] == 1234
    assert slow["x_mean"] == pytest.approx(fast["x_mean"])


def test_several_columns_at_once_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 10), (3, 20), (None, 30)], "a int, b int")
    long = exact_quantiles(df, {"a": (F.col("a"), 1), "b": (F.col("b"), 1)}, [0.5], descend=True)
    assert {(r["dim"], r["value"], r["n"]) for r in long.collect()} == {("a", 2.0, 3), ("b", 20.0, 3)}


@pytest.mark.parametrize("descend", [True, False])
def test_empty_input_gives_one_row_of_nulls(spark, descend):
    row = quantile_row(longs(spark, []), {"x": (F.col("x"), 1)}, {"med": 0.5}, descend=descend).first()
    assert row["x_n"] == 0 and row["x_med"] is None


def test_size_check_reads_statistics_only(spark, star):
    small = planned_input_bytes(star.order_items)
    assert 0 < small < 10 * 1024 * 1024
    rdd_backed = spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "x int")
    assert planned_input_bytes(rdd_backed) > 2**40


def test_winsorize_caps_at_interpolated_quantile(spark):
    values = [float(i) for i in range(1, 101)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    out = [r["x"] for r in winsorize(df, "x", 2, upper=0.95).collect()]
    cap = np.quantile(values, 0.95)
    assert max(v for v in out if v is not None) == pytest.approx(cap)
    assert out.count(None) == 1


def test_describe_like_pandas(spark):
    values = [1, 5, 5, 7, 100, 2, 2]
    out = describe_numeric(longs(spark, values), {"x": (F.col("x"), 1.0)}).orderBy("_ord").collect()
    want = pd.Series(values).describe()
    assert [r["stat"] for r in out] == list(want.index)
    for r in out:
        assert r["x"] == pytest.approx(want[r["stat"]], abs=1e-4)


def base_frame(spark, values):
    rows = [(i, int(v), int(v), float(v), int(v) * 1_000_000) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "customer_unique_id int, recency bigint, frequency bigint, monetary double, monetary_units bigint")


@pytest.mark.parametrize("descend", [True, False])
@pytest.mark.parametrize(
    "values",
    [
        [1] * 97 + [2, 3, 15],
        [1, 2, 2, 3, 3, 3, 4, 9],
        list(range(1, 38)),
        [1, 1, 1, 2, 2, 5, 5, 5, 5, 8, 13, 21, 21, 34],
    ],
)
def test_scores_follow_merged_quantile_bins(spark, values, descend):
    scored = qcut_scores(base_frame(spark, values), descend=descend).orderBy("customer_unique_id").collect()
    bins = pd.qcut(pd.Series(values), 5, labels=False, duplicates="drop")
    top = bins.max() + 1
    assert [r["F_score"] for r in scored] == [b + 1 for b in bins]
    assert [r["M_score"] for r in scored] == [b + 1 for b in bins]
    assert [r["R_score"] for r in scored] == [top - b for b in bins]


def test_single_column_score_matches_pandas_bins(spark):
    values = [0.5, 0.5, 0.75, 1.25, 1.25, 1.25, 2.0, 9.5, 9.75, 12.0, 40.25]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    units = ((F.col("x") * 100).cast("bigint"), 100.0)
    bins = pd.qcut(pd.Series(values), 4, labels=False, duplicates="drop")
    up = qcut_score(df, "x", units, q=4).orderBy("i").collect()
    down = qcut_score(df, "x", units, q=4, reverse=True, descend=True).orderBy("i").collect()
    assert [r["score"] for r in up] == [b + 1 for b in bins]
    assert [r["score"] for r in down] == [bins.max() + 1 - b for b in bins]


def test_constant_column_has_no_bins(spark):
    row = qcut_scores(base_frame(spark, [4] * 10)).first()
    assert (row["R_score"], row["F_score"], row["M_score"]) == (0, 1, 1)


@pytest.mark.parametrize("name", ["spread", "far", "constant", "single", "signed"])
def test_deviation_matches_numpy(spark, name):
    rng = np.random.default_rng(3)
    values = {
        "spread": rng.integers(0, 2**40, 5000),
        "far": 3 * 2**50 + rng.integers(0, 1000, 5000),
        "constant": np.full(500, 123_456_789_012),
        "single": np.array([42]),
        "signed": rng.integers(-(10**9), 10**9, 5000),
    }[name]
    df = spark.createDataFrame([(int(v),) for v in values], "v long")
    for descend in (True, False):
        row = quantile_row(df, {"v": (F.col("v"), 1.0)}, {"med": 0.5}, descend=descend, deviation=True).first()
        assert row.v_n == len(values)
        assert row.v_mean == pytest.approx(values.mean(), rel=1e-12)
        if len(values) == 1:
            assert row.v_dev is None
        elif descend or name != "far":  # the built-in aggregate loses digits far from zero
            assert row.v_dev == pytest.approx(np.std((values - values.min()).astype(float), ddof=1), rel=1e-5)
