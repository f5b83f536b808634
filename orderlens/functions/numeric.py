"""Rounding, rates and exact money sums as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def rnd(value: Column | str, digits: int) -> Column:
    """Half-up rounding of the decimal reading of a double.

    Going through ``decimal(28, 10)`` first absorbs the last-bit noise of
    floating point, so the result does not depend on the order in which
    partitions were summed and agrees between engines.
    """
    return F.round(as_column(value).cast("decimal(28,10)"), digits).cast("double")


def rate(part: Column | str, whole: Column | str) -> Column:
    """``part`` as a percentage of ``whole``; NULL when ``whole`` is zero."""
    return F.try_divide(as_column(part) * F.lit(100.0), as_column(whole).cast("double"))


def percent(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    return rnd(rate(part, whole), digits)


# Amounts are added up as whole numbers of this many decimals: unit prices, tax
# lines and converted currencies have more than two.
MONEY_DIGITS = 6
MONEY_UNIT = float(10**MONEY_DIGITS)


def minor_units(amount: Column | str, digits: int = MONEY_DIGITS) -> Column:
    """An amount with ``digits`` decimals as a whole number of its smallest unit."""
    return F.rint(as_column(amount) * F.lit(float(10**digits))).cast("bigint")


def major_units(units: Column | str, digits: int = MONEY_DIGITS) -> Column:
    return as_column(units).cast("double") / F.lit(float(10**digits))


def total_units(units: Column | str) -> Column:
    """Sum of minor units with room for any number of rows."""
    return F.sum(as_column(units).cast("decimal(20,0)"))


def exact_sum(amount: Column | str, digits: int = MONEY_DIGITS) -> Column:
    """Sum of a money column, exact to ``digits`` decimals and independent of task order.

    Amounts are rounded to ``digits`` decimals row by row, the total is not.
    """
    return major_units(total_units(minor_units(amount, digits)), digits)


def exact_avg(amount: Column | str, digits: int = MONEY_DIGITS) -> Column:
    total = total_units(minor_units(amount, digits))
    return F.try_divide(major_units(total, digits), F.count(as_column(amount)).cast("double"))
