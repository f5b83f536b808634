"""Approximate distinct counts from mergeable sketches, for those who ask for them.

A sketch per group can be written once (say per day) and rolled up later to any
coarser grouping without the rows. Up to the sketch's size it is exact; beyond,
the relative standard error is that of :func:`standard_error`, whatever the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14  # 2**LG_K registers: at most some 16 KB a group


def standard_error(lg_k: int = LG_K) -> float:
    """Relative standard error of an estimate from merged sketches."""
    return 1.04 / sqrt(1 << lg_k)


def distinct_sketches(df: DataFrame, by: Sequence[str], column: str, lg_k: int = LG_K) -> DataFrame:
    """One row per group with ``sketch``, which holds the distinct non-NULL values of ``column``.

    ``column`` is a whole number, a string or binary. Sketches are built in the
    map tasks and merged after the shuffle, so a hot group sends one row a task.
    """
    return df.groupBy(*by).agg(F.hll_sketch_agg(F.col(column), lg_k).alias("sketch"))


def roll_up(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups; a value that several of the finer groups hold counts once."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated() -> Column:
    """The distinct count that a row's ``sketch`` stands for."""
    return F.hll_sketch_estimate("sketch")
