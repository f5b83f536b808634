"""Calendar buckets and elapsed time on zone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderlens.functions.numeric import as_column

MICROS_PER_UNIT = {
    "seconds": 1_000_000,
    "minutes": 60_000_000,
    "hours": 3_600_000_000,
    "days": 86_400_000_000,
}


def month_label(ts: Column | str) -> Column:
    return F.date_format(as_column(ts).cast("date"), "yyyy-MM")


def month_start(ts: Column | str) -> Column:
    return F.trunc(as_column(ts).cast("date"), "MM")


def month_number(day: Column | str) -> Column:
    day = as_column(day)
    return F.year(day) * 12 + F.month(day)


def months_between_labels(start: Column | str, end: Column | str) -> Column:
    """Number of month boundaries crossed: Jan 31 to Feb 1 is one."""
    return (month_number(end) - month_number(start)).cast("bigint")


def elapsed_micros(start: Column | str, end: Column | str) -> Column:
    """``end - start`` in microseconds; NULL if either is NULL, may be negative.

    Uses the interval between the two timestamps, so the session time zone and
    its clock changes play no part.
    """
    seconds = (as_column(end) - as_column(start)).cast("interval second").cast("decimal(18,6)")
    return (seconds * F.lit(1_000_000)).cast("bigint")


def elapsed(start: Column | str, end: Column | str, unit: str) -> Column:
    return elapsed_micros(start, end).cast("double") / F.lit(float(MICROS_PER_UNIT[unit]))
