"""Monthly cohorts: counts, retention, matrix and average curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.frames import distinct_count
from orderlens.functions.numeric import rate, rnd


# A person's months are bits of this many 64-bit words, numbered from the year 0 on and taken modulo their number.
# Months of one person further apart than all words hold (85 years) would share bits: they stop the query.
MONTH_WORDS = 16


def _month_index(ts: str) -> Column:
    day = F.col(ts).cast("date")
    return (F.year(day) * 12 + F.month(day) - 1).cast("bigint")


def active_months(purchases: DataFrame, person: str, ts: str, words: int = MONTH_WORDS) -> DataFrame:
    """One row per person: ``first`` month, ``span`` of months after it and ``bits``, the months with a purchase.

    A single aggregate with a map-side step: a task keeps one bitmap per person,
    bitmaps of tasks merge by OR, and persons are shuffled once. Months are
    counted from the year 0. Purchases without a time belong to no month.
    """
    bit = "shiftleft(1L, int(pmod(_month, 64)))"
    bits = [F.expr(f"bit_or(if(pmod(floor(_month / 64), {words}) = {k}, {bit}, 0L))").alias(f"_w{k}") for k in range(words)]
    rows = purchases.select(person, _month_index(ts).alias("_month")).filter("_month IS NOT NULL")
    span = F.max("_month") - F.min("_month")
    merged = rows.groupBy(person).agg(F.min("_month").alias("first"), span.alias("span"), *bits)
    too_far = F.raise_error(F.lit(f"purchases of one person lie more than {words * 64} months apart"))
    return merged.select(
        person,
        "first",
        F.when(F.col("span") < words * 64, F.col("span")).otherwise(too_far.cast("bigint")).alias("span"),
        F.array(*[f"_w{k}" for k in range(words)]).alias("bits"),
    )


def cohort_counts(purchases: DataFrame, person: str, ts: str) -> DataFrame:
    """Active persons per first-purchase month and months since then, from one bitmap of months per person."""
    months = active_months(purchases, person, ts)
    held = "shiftright(get(bits, int(pmod(floor((first + o) / 64), size(bits)))), int(pmod(first + o, 64))) & 1L"
    offsets = F.expr(f"filter(sequence(0L, span), o -> {held} = 1L)")
    first_day = F.make_date(F.floor(F.col("first") / 12).cast("int"), (F.pmod(F.col("first"), F.lit(12)) + 1).cast("int"), F.lit(1))
    return (
        months.select(first_day.alias("cohort_month"), F.explode(offsets).alias("offset_month"))
        .groupBy("cohort_month", "offset_month")
        .agg(F.count(F.lit(1)).alias("user_cnt"))
    )


def cohort_retention(counts: DataFrame, min_size: int = 50, digits: int | None = 2) -> DataFrame:
    """Active persons as a percentage of the cohort's first month.

    Only cohorts whose month zero has at least ``min_size`` persons are kept.
    ``digits=None`` leaves the percentage unrounded.
    """
    cohort = Window.partitionBy("cohort_month")
    size = F.max(F.when(F.col("offset_month") == 0, F.col("user_cnt"))).over(cohort)
    base = F.first("user_cnt").over(cohort.orderBy("offset_month"))
    pct = rate("user_cnt", "_base")
    return (
        counts.withColumn("_size", size)
        .withColumn("_base", base)
        .filter(F.col("_size") >= min_size)
        .select(
            "cohort_month",
            "offset_month",
            "user_cnt",
            (pct if digits is None else rnd(pct, digits)).alias("retention_pct"),
        )
    )


def retention_matrix(
    retention: DataFrame, value: str = "retention_pct", months: int = 12, digits: int | None = 1
) -> DataFrame:
    """Wide form ``m0 .. m<months-1>`` per cohort label; absent cells are NULL.

    The offsets are given, so no extra job looks for the pivot values.
    """
    offsets = list(range(months))
    label = F.date_format("cohort_month", "yyyy-MM").alias("cohort_month")
    wide = retention.groupBy(label).pivot("offset_month", offsets).agg(F.max(value))
    cells = [F.col(f"`{i}`") if digits is None else rnd(F.col(f"`{i}`"), digits) for i in offsets]
    return wide.select("cohort_month", *[cell.alias(f"m{i}") for i, cell in zip(offsets, cells)])


def retention_curve(
    retention: DataFrame,
    max_offset: int | None = None,
    zero_fill: bool = False,
    digits: int = 2,
    out: str = "avg_retention_pct",
) -> DataFrame:
    """Mean retention per offset over the cohorts that have that offset.

    ``max_offset`` is the last offset taken. ``zero_fill`` divides by the number of all cohorts instead.
    """
    rows = retention if max_offset is None else retention.filter(F.col("offset_month") <= max_offset)
    if not zero_fill:
        return rows.groupBy("offset_month").agg(rnd(F.avg("retention_pct"), digits).alias(out))
    cohorts = distinct_count(retention, "cohort_month", "n")
    return (
        rows.groupBy("offset_month")
        .agg(F.sum("retention_pct").alias("_sum"))
        .select("offset_month", rnd(F.col("_sum") / cohorts.scalar(), digits).alias(out))
    )
