"""Small building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def inline_table(spark: SparkSession, names: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """A handful of constant rows as a local relation, which Spark can size exactly."""
    columns = {name: [row[i] for row in rows] for i, name in enumerate(names)}
    return spark.createDataFrame(pa.table(columns))


def rows_from_columns(df: DataFrame, rows: Sequence[dict[str, Column]], keep: Sequence[str] = ()) -> DataFrame:
    """Turn each input row into ``len(rows)`` output rows, in one scan.

    Every dict maps output column to expression; ``keep`` columns are repeated.
    """
    structs = [F.struct(*[expr.alias(name) for name, expr in row.items()]) for row in rows]
    return df.select(*keep, F.inline(F.array(*structs)))


def as_struct(one_row: DataFrame) -> Column:
    """The single row of ``one_row`` as a struct value usable in any other frame.

    This is an uncorrelated scalar subquery: Spark runs it once and ships one
    value, so no join is planned.
    """
    return one_row.select(F.struct(*[F.col(c) for c in one_row.columns])).scalar()


def gather_row(spark: SparkSession, frames: Sequence[DataFrame]) -> DataFrame:
    """Put several one-row frames side by side."""
    structs = [as_struct(frame).alias(f"_{i}") for i, frame in enumerate(frames)]
    fields = [
        F.col(f"_{i}.{name}").alias(name)
        for i, frame in enumerate(frames)
        for name in frame.columns
    ]
    return spark.range(1).select(*structs).select(*fields)


def distinct_count(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row with the number of distinct non-NULL values of a column.

    Grouping first spreads the values over all tasks with a map-side step. It
    also keeps the optimizer from merging several such counts into a single
    aggregate, which would multiply every input row.
    """
    return df.select(column).filter(F.col(column).isNotNull()).distinct().agg(F.count(F.lit(1)).alias(name))


def planned_input_bytes(df: DataFrame) -> int:
    """Total size Spark knows for the sources under ``df``.

    Reads optimizer statistics only, no job runs. A source without statistics
    counts as huge, so callers that compare this with a limit stay on the safe
    side.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def fits_broadcast(df: DataFrame) -> bool:
    """Whether all sources of ``df`` together fit Spark's own broadcast limit."""
    return planned_input_bytes(df) <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast when all sources of ``df`` together fit Spark's own limit.

    Spark multiplies sizes when it estimates a join, so a lookup that is itself
    a small join looks huge and would force a shuffle of the fact table. Only
    for frames that are no larger than their sources, e.g. lookups joined to
    lookups. Beyond the limit nothing is hinted: Spark then joins by shuffle and
    splits skewed partitions at run time.
    """
    return F.broadcast(df) if fits_broadcast(df) else df


def salted_join(rows: DataFrame, lookup: DataFrame, key: str, spread: str, salts: int = 16) -> DataFrame:
    """Inner join on ``key`` whose hot values are dealt to ``salts`` partitions by the values of ``spread``.

    ``lookup`` is repeated ``salts`` times, so it should be much shorter than
    ``rows``; ``rows`` keep their number. The split is part of the plan and does
    not wait for what is seen at run time.
    """
    salted = rows.withColumn("_salt", F.pmod(F.hash(spread), F.lit(salts)))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [key, "_salt"]).drop("_salt")
