"""Elapsed time between stages: per order, per stage, per status, box statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.dates import MICROS_PER_UNIT, elapsed, elapsed_micros
from orderlens.functions.frames import rows_from_columns
from orderlens.functions.numeric import rnd
from orderlens.operators.quantiles import (
    interpolated,
    quantile_row,
    statistics_of_counts,
    value_counts,
)


@dataclass(frozen=True)
class Span:
    """Time from ``start`` to ``end``, reported in ``unit`` under ``label``."""

    label: str
    start: str
    end: str
    unit: str

    def micros(self) -> Column:
        return elapsed_micros(self.start, self.end)

    def value(self) -> Column:
        return elapsed(self.start, self.end, self.unit)


def with_durations(df: DataFrame, spans: Sequence[Span], digits: int | None = None) -> DataFrame:
    """Add one duration column per span; negative and NULL values pass through."""
    shape = (lambda c: c) if digits is None else (lambda c: rnd(c, digits))
    return df.withColumns({s.label: shape(s.value()) for s in spans})


def stage_durations(
    df: DataFrame,
    spans: Sequence[Span],
    names: Sequence[str] = ("avg_hours", "median_hours", "p95_hours"),
    digits: int = 1,
    descend: bool = True,
) -> DataFrame:
    """Mean, median and 95th percentile per span, each in the span's own unit.

    A row takes part when both timestamps are set; nothing is clipped. A span
    without any such row keeps its row, with NULLs.
    """
    columns = {f"s{i}": (s.micros(), MICROS_PER_UNIT[s.unit]) for i, s in enumerate(spans)}
    row = quantile_row(df, columns, {"median": 0.5, "p95": 0.95}, digits=None, descend=descend)
    return rows_from_columns(
        row,
        [
            {
                "_ord": F.lit(i),
                "stage": F.lit(s.label),
                **{n: rnd(f"s{i}_{field}", digits) for n, field in zip(names, ("mean", "median", "p95"))},
                "unit": F.lit(s.unit),
            }
            for i, s in enumerate(spans)
        ],
    )


def duration_by(
    df: DataFrame, by: str, spans: Sequence[Span], count_name: str = "order_cnt", digits: int = 1
) -> DataFrame:
    """Rows and mean durations per group; every row counts."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias(count_name), *[rnd(F.avg(s.value()), digits).alias(s.label) for s in spans]
    )


def box_stats(df: DataFrame, spans: Sequence[Span], clip: float = 0.99, digits: int = 4) -> DataFrame:
    """Box-plot numbers per span after capping each span at its ``clip`` quantile.

    Capping keeps the order of the values, so the quartiles of the capped column
    follow from the order statistics of the raw one. Whiskers are the outermost
    values within 1.5 interquartile ranges of the box, never inside it.
    """
    probs = {"clip": clip, "q1": 0.25, "median": 0.5, "q3": 0.75}
    units = {s.label: float(MICROS_PER_UNIT[s.unit]) for s in spans}
    counts = value_counts(df, [s.micros() for s in spans])
    stats = statistics_of_counts(counts, [s.label for s in spans], list(probs.values()), descend=True)

    def pick(name: str, field: str) -> Column:
        return F.max(F.when(F.col("prob") == F.lit(probs[name]), F.col(field)))

    raw = stats.groupBy("dim").agg(
        F.first("n").alias("n"),
        *[pick(p, f).alias(f"{p}_{f}") for p in probs for f in ("lo", "hi", "frac")],
    )
    capped = raw.withColumn("cap", interpolated(F.col("clip_lo"), F.col("clip_hi"), F.col("clip_frac")))
    for q in ("q1", "median", "q3"):
        low = F.least(F.col(f"{q}_lo").cast("double"), F.col("cap"))
        high = F.least(F.col(f"{q}_hi").cast("double"), F.col("cap"))
        capped = capped.withColumn(q, low + F.col(f"{q}_frac") * (high - low))
    reach = (F.col("q3") - F.col("q1")) * F.lit(1.5)
    box = capped.select(
        "dim", "n", "cap", "q1", "median", "q3", (F.col("q1") - reach).alias("floor"), (F.col("q3") + reach).alias("roof")
    )

    labels = F.array(*[F.lit(s.label) for s in spans])
    position = (F.array_position(labels, F.col("dim")) - 1).cast("int")
    # One row per span is broadcast; the value counts are the ones ranked above.
    kept = counts.join(F.broadcast(box.withColumn("d", position)), "d").withColumn(
        "x", F.least(F.col("v").cast("double"), F.col("cap"))
    )
    inside = F.col("x").between(F.col("floor"), F.col("roof"))
    whiskers = kept.groupBy("dim", "n", "cap", "q1", "median", "q3").agg(
        F.least(F.min(F.when(inside, F.col("x"))), F.col("q1")).alias("whisker_low"),
        F.greatest(F.max(F.when(inside, F.col("x"))), F.col("q3")).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("cnt"))), F.lit(0)).cast("bigint").alias("fliers"),
    )
    unit = F.element_at(F.create_map(*[F.lit(x) for kv in units.items() for x in kv]), F.col("dim"))
    return whiskers.select(
        F.col("dim").alias("stage"),
        "n",
        *[rnd(F.col(c) / unit, digits).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high", "cap")],
        "fliers",
    )
