"""Lookup joins: translation with fallback and deduplicated lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def translate(df: DataFrame, lookup: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Left-join a lookup and keep the original value where it has no entry.

    No broadcast hint: Spark knows the lookup's size and decides.
    """
    return df.join(lookup.select(key, value), key, "left").withColumn(
        out, F.coalesce(F.col(value), F.col(key))
    ).drop(value)


def dedup_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the smallest by ``order``, then by the other columns.

    Runs as an aggregate with a map-side step, so a key with very many copies
    sends one row per task instead of all of them.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    row = F.struct(*rest)
    best = F.min_by(row, F.struct(*order, *rest)) if order else F.min(row)
    return df.groupBy(*keys).agg(best.alias("_row")).select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in rest]
    ).select(*df.columns)
