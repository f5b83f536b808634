"""Shares of a total, distributions, top-k and cumulative shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.frames import as_struct
from orderlens.functions.numeric import exact_avg, percent, rnd


def share_of_total(
    df: DataFrame, measure: str, out: str = "pct", digits: int = 2, total: str = "window"
) -> DataFrame:
    """Add ``measure`` as a percentage of its sum over all rows.

    ``total="window"`` is for report-sized inputs (one row per category): it
    brings the rows to one task. ``total="scalar"`` computes the sum as a
    separate aggregate and leaves the rows where they are; use it whenever the
    number of rows can grow with the data.
    """
    if total == "scalar":
        whole: Column = as_struct(df.agg(F.sum(measure).alias("total")))["total"]
    elif total == "window":
        whole = F.sum(measure).over(Window.partitionBy())
    else:
        raise ValueError(f"unknown total mode: {total}")
    return df.withColumn(out, percent(measure, whole, digits))


def distribution(
    df: DataFrame,
    key: str,
    count_name: str,
    avg_of: str | None = None,
    avg_name: str = "avg_value",
    digits: int = 2,
    total: str = "window",
) -> DataFrame:
    """Rows per key, their share, and optionally the mean of a money column.

    ``total`` is passed to :func:`share_of_total`; use ``"scalar"`` for keys
    whose number grows with the data.
    """
    measures = [F.count(F.lit(1)).alias(count_name)]
    if avg_of is not None:
        measures.append(rnd(exact_avg(avg_of), digits).alias(avg_name))
    return share_of_total(df.groupBy(key).agg(*measures), count_name, digits=digits, total=total)


def with_total_row(df: DataFrame, key: str, measure: str, label: str, pct: str = "pct") -> DataFrame:
    """Append a total row; ``_ord`` sorts the rows by key with the total last."""
    total = df.agg(F.coalesce(F.sum(measure), F.lit(0)).cast("bigint").alias(measure)).select(
        F.lit(label).alias(key),
        measure,
        F.lit(100.0).alias(pct),
        F.lit(None).cast("bigint").alias("_ord"),
    )
    rows = df.select(
        F.col(key).cast("string").alias(key), measure, pct, F.col(key).cast("bigint").alias("_ord")
    )
    return rows.unionByName(total)


def top_k(df: DataFrame, by: str, k: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows with the largest ``by``, ties settled by ``tiebreak`` ascending.

    Planned as take-ordered: every task keeps ``k`` rows, nothing is sorted as
    a whole.
    """
    order = [F.col(by).desc_nulls_last()] + [F.col(c).asc_nulls_last() for c in tiebreak]
    return df.orderBy(*order).limit(k)


def cumulative_share(
    df: DataFrame, order: str, col: str = "pct", out: str = "cum_pct", digits: int = 2
) -> DataFrame:
    """Running sum of a share column over report-sized, ordered rows."""
    running = Window.partitionBy().orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, rnd(F.sum(col).over(running), digits))


def monthly_trend(df: DataFrame, month: Column, count_name: str = "order_cnt") -> DataFrame:
    """Rows per month label; months without rows stay absent."""
    return df.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias(count_name))


def avg_of_group(df: DataFrame, key: str, **measures: Column) -> DataFrame:
    """Aggregate per key first, then average the per-key results over all keys."""
    per_key = df.groupBy(key).agg(*[expr.alias(name) for name, expr in measures.items()])
    return per_key.agg(*[F.avg(name).alias(name) for name in measures])
