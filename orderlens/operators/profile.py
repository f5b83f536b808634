"""Table sizes, table overview and time coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.sources.model import CommerceModel


def table_sizes(model: CommerceModel) -> DataFrame:
    """Rows per role. Every branch counts without reading data columns."""
    counts = [
        model.row_source(role).agg(F.count(F.lit(1)).alias("row_cnt")).select(F.lit(role).alias("table_name"), "row_cnt")
        for role in model.roles
    ]
    return reduce(DataFrame.unionByName, counts)


def table_overview(model: CommerceModel, shown: int = 8) -> DataFrame:
    """Rows, number of columns and the first column names of every role."""
    details = [
        model.row_source(role)
        .agg(F.count(F.lit(1)).alias("row_cnt"))
        .select(
            F.lit(role).alias("table_name"),
            "row_cnt",
            F.lit(len(df.columns)).cast("bigint").alias("column_cnt"),
            F.lit(", ".join(df.columns[:shown])).alias("key_columns"),
        )
        for role, df in model.roles.items()
    ]
    return reduce(DataFrame.unionByName, details)


def persons_by_state(model: CommerceModel) -> DataFrame:
    """Distinct persons per state, from the distinct (person, state) pairs."""
    return model.person_states.groupBy("customer_state").agg(F.count("customer_unique_id").alias("customer_cnt"))


def coverage(df: DataFrame, ts: str) -> DataFrame:
    """First and last value of a timestamp column."""
    return df.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
