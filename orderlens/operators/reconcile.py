"""Compare computed metrics with expected figures."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.frames import inline_table, rows_from_columns
from orderlens.functions.numeric import rnd


def metrics_long(one_row: DataFrame) -> DataFrame:
    """Numeric columns of a one-row frame as (metric, value) rows."""
    return rows_from_columns(
        one_row,
        [{"metric": F.lit(c), "value": F.col(c).cast("double")} for c in one_row.columns],
    )


def expected_metrics(like: DataFrame, figures: Mapping[str, float]) -> DataFrame:
    rows = [(name, float(value)) for name, value in figures.items()]
    return inline_table(like.sparkSession, ["metric", "value"], rows)


def reconcile(actual: DataFrame, expected: DataFrame, tol: float = 0.0) -> DataFrame:
    """Every metric of either side with both values, difference and verdict.

    ``status`` is ok, differs, missing (expected but not computed) or extra. Two
    NULL values agree.
    """
    a = actual.select("metric", F.col("value").alias("actual"), F.lit(True).alias("_a"))
    e = expected.select("metric", F.col("value").alias("expected"), F.lit(True).alias("_e"))
    diff = F.col("actual") - F.col("expected")
    agrees = F.col("actual").eqNullSafe(F.col("expected")) | F.coalesce(
        rnd(F.abs(diff), 9) <= F.lit(float(tol)), F.lit(False)
    )
    return a.join(e, "metric", "full").select(
        "metric",
        "actual",
        "expected",
        rnd(diff, 6).alias("diff"),
        F.when(F.col("_a").isNull(), "missing")
        .when(F.col("_e").isNull(), "extra")
        .when(agrees, "ok")
        .otherwise("differs")
        .alias("status"),
    )
