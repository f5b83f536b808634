"""Conversion funnels over stage timestamps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.frames import broadcast_if_small, rows_from_columns
from orderlens.functions.numeric import percent
from orderlens.operators.shares import top_k
from orderlens.sources.model import StateLookup

Stage = tuple[str, str]  # (label, timestamp column)


def funnel(
    df: DataFrame,
    stages: Sequence[Stage],
    by: Sequence[str] = (),
    base: str = "first",
    count_name: str = "order_cnt",
    digits: int = 2,
) -> DataFrame:
    """Count rows per stage with the overall and the step conversion rate.

    A row counts for a stage when its timestamp is set; no order between stages
    is enforced. ``base="first"`` divides by the first stage, ``base="rows"`` by
    the number of rows. One scan and one aggregate, whatever the number of
    stages; the rates are taken on the aggregated row.
    """
    if base not in ("first", "rows"):
        raise ValueError(f"unknown base: {base}")
    counts = [f"_s{i}" for i in range(len(stages))]
    wide = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(col).alias(name) for (_, col), name in zip(stages, counts)],
    )
    start = F.col("_rows") if base == "rows" else F.col(counts[0])
    previous = [None, *counts]
    rows = [
        {
            "stage": F.lit(label),
            count_name: F.col(count),
            "overall_rate": percent(count, start, digits),
            "step_rate": percent(count, before, digits) if before else F.lit(None).cast("double"),
        }
        for (label, _), count, before in zip(stages, counts, previous)
    ]
    return rows_from_columns(wide, rows, keep=by)


def funnel_by(
    df: DataFrame,
    group: str,
    ratios: Mapping[str, tuple[str, str]],
    min_rows: int = 100,
    k: int | None = 10,
    lookup: StateLookup | None = None,
    count_name: str = "total_orders",
    digits: int = 2,
) -> DataFrame:
    """Stage ratios per group, for groups with at least ``min_rows`` rows.

    ``ratios`` maps output name to (reached column, base column). When the group
    sits in a lookup, rows are first summed per lookup key: the join then sees
    one row per key, and a key that holds a large part of the data cannot skew it.
    """
    stages = sorted({col for pair in ratios.values() for col in pair})
    by = lookup.key if lookup else group
    sums = df.groupBy(by).agg(
        F.count(F.lit(1)).alias(count_name), *[F.count(c).alias(f"_{c}") for c in stages]
    )
    if lookup:
        totals = [count_name, *[f"_{c}" for c in stages]]
        sums = sums.join(broadcast_if_small(lookup.frame), lookup.key).groupBy(group).agg(
            *[F.sum(name).alias(name) for name in totals]
        )
    out = sums.filter(F.col(count_name) >= min_rows).select(
        group,
        count_name,
        *[percent(f"_{part}", f"_{whole}", digits).alias(n) for n, (part, whole) in ratios.items()],
    )
    return top_k(out, count_name, k, [group]) if k else out
