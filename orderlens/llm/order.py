"""Places in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.store import saved

_ROW_BITS = 33  # below these bits, Spark's row numbers count within a partition


def numbered(ordered: DataFrame, within: str, name: str) -> DataFrame:
    """`ordered` with `position` (from 0) and `n`, the row's place among the rows of its `within` and their number.

    `ordered` must be dealt by ranges and sorted in each partition, by `within`
    first. Each row keeps its number in its partition; only counts for each
    (within, partition) meet in one place. `within` must not be null.
    """
    rows = saved(ordered.withColumn("__row", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("__part", F.shiftright("__row", _ROW_BITS))
    runs = rows.groupBy(within, "__part").agg(F.min("__row").alias("__first"), F.count("*").alias("__c"))
    tree = Window.partitionBy(within)
    before = F.sum("__c").over(tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")
    runs = runs.select(within, "__part", "__first", before.alias("__before"), F.sum("__c").over(tree).alias("n"))
    place = F.col("__before") + F.col("__row") - F.col("__first")
    return rows.join(runs, [within, "__part"]).withColumn("position", place).drop("__row", "__part", "__first", "__before")


def by_ranges(rows: DataFrame, *keys: str | Column, partitions: int | None = None) -> DataFrame:
    """`rows` dealt by ranges of `keys` and sorted by them; give keys that hardly repeat, so that ranges come out even."""
    dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys)
