"""Approximate distinct counts against exact ones."""

import pytest
from pyspark.sql import functions as F

from orderlens.operators.kpi import person_metrics
from orderlens.operators.sketches import distinct_sketches, estimated, roll_up, standard_error


def test_small_groups_are_exact_and_nulls_do_not_count(spark):
    df = spark.createDataFrame([("a", 1, 7), ("a", 2, 7), ("a", 2, 8), ("b", 1, None), ("c", 1, 9)], "g string, day int, v long")
    rolled = roll_up(distinct_sketches(df, ["g", "day"], "v"), ["g"])
    assert {r.g: r.n for r in rolled.select("g", estimated().alias("n")).collect()} == {"a": 2, "b": 0, "c": 1}


@pytest.mark.parametrize("lg_k", [10, 14])
def test_rolled_up_estimates_stay_within_the_stated_error(spark, lg_k):
    """Two thirds of the rows lie in one group, and days share most of their values."""
    df = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(99).alias("g"),
        (F.col("id") % 7).alias("day"),
        (F.col("id") % 120_011).alias("v"),
    )
    exact = {r.g: r.n for r in df.groupBy("g").agg(F.countDistinct("v").alias("n")).collect()}
    rolled = roll_up(distinct_sketches(df, ["g", "day"], "v", lg_k), ["g"]).select("g", estimated().alias("n"))
    for r in rolled.collect():
        assert r.n == pytest.approx(exact[r.g], rel=4 * standard_error(lg_k))


def test_persons_by_sketch(star):
    exact, rough = person_metrics(star).first()[0], person_metrics(star, lg_k=14).first()[0]
    assert rough == pytest.approx(exact, rel=3 * standard_error(14))
