"""Identity audit, repeat buyers, gaps between orders and their buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.frames import distinct_count, gather_row
from orderlens.functions.labels import bucket_index, bucket_label
from orderlens.functions.numeric import percent, rnd
from orderlens.operators.shares import distribution, share_of_total, with_total_row

# Upper bounds in days (right-closed) and labels of the gap buckets.
GAP_EDGES = (7, 14, 30, 60, 90, 180)
GAP_LABELS = ("0-7 days", "8-14 days", "15-30 days", "31-60 days", "61-90 days", "91-180 days", "180+ days")
GAP_LABELS_ZH = ("0-7 天", "8-14 天", "15-30 天", "31-60 天", "61-90 天", "91-180 天", "180+ 天")

# Fixed value: label of the total row.
TOTAL_LABEL = "合计"


def identity_audit(identities: DataFrame) -> DataFrame:
    """Distinct order identities against distinct persons.

    Each distinct count reads its own column only, so together they cost one
    pass over the two columns.
    """
    frames = [
        distinct_count(identities, "customer_id", "distinct_customer_ids"),
        distinct_count(identities, "customer_unique_id", "distinct_unique_ids"),
        identities.agg(F.count(F.lit(1)).alias("total_rows")),
    ]
    return gather_row(identities.sparkSession, frames).select(
        "distinct_customer_ids",
        "distinct_unique_ids",
        "total_rows",
        (F.col("distinct_customer_ids") - F.col("distinct_unique_ids")).alias("duplicated_ids"),
    )


def repeat_persons(identities: DataFrame, min_ids: int = 2) -> DataFrame:
    """Persons with at least ``min_ids`` order identities."""
    return (
        identities.groupBy("customer_unique_id")
        .agg(F.countDistinct("customer_id").alias("id_count"))
        .filter(F.col("id_count") >= min_ids)
    )


def repeat_distribution(identities: DataFrame, min_ids: int = 2, total_label: str = TOTAL_LABEL) -> DataFrame:
    """Histogram of identities per repeat person, with share and a total row."""
    dist = distribution(repeat_persons(identities, min_ids), "id_count", "user_cnt")
    return with_total_row(dist, "id_count", "user_cnt", total_label)


def repeat_stats(identities: DataFrame, min_ids: int = 2, digits: int = 2) -> DataFrame:
    return repeat_persons(identities, min_ids).agg(
        F.count(F.lit(1)).alias("repeat_users"),
        F.max("id_count").alias("max_ids"),
        rnd(F.avg("id_count"), digits).alias("avg_ids"),
    )


def repurchase_rate(purchases: DataFrame, person: str = "customer_unique_id", order: str = "order_id") -> DataFrame:
    """Persons, those with two and three or more orders, rate, mean and maximum.

    ``order`` is a key of ``purchases``, one row each, as in all operators on the model.
    """
    per_person = purchases.groupBy(person).agg(F.count(order).alias("n"))
    at_least = lambda k: F.count(F.when(F.col("n") >= k, F.lit(1)))
    return per_person.agg(
        F.count(F.lit(1)).alias("total_users"),
        at_least(2).alias("repurchase_users"),
        at_least(3).alias("three_plus_users"),
        rnd(F.avg("n"), 2).alias("avg_orders_per_user"),
        F.max("n").alias("max_orders"),
    ).select(
        "total_users",
        "repurchase_users",
        "three_plus_users",
        percent("repurchase_users", "total_users").alias("repurchase_rate"),
        "avg_orders_per_user",
        "max_orders",
    )


def nth_gap(
    purchases: DataFrame, person: str, ts: str, a: int = 1, b: int = 2, out: str = "days_to_repurchase"
) -> DataFrame:
    """Days between a person's ``a``-th and ``b``-th purchase; 0 if on one day.

    The rank filter lets Spark keep only ``b`` rows per person in every task
    before the shuffle, so a person with very many orders stays cheap. No
    self-join: both dates come out of one aggregate over the kept rows.
    """
    ranked = purchases.select(person, F.col(ts).cast("date").alias("_day")).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(person).orderBy("_day"))
    )
    day_at = lambda rank: F.max(F.when(F.col("_rank") == rank, F.col("_day")))
    return (
        ranked.filter(F.col("_rank") <= b)
        .groupBy(person)
        .agg(day_at(a).alias("_a"), day_at(b).alias("_b"))
        .filter(F.col("_b").isNotNull())
        .select(person, F.datediff("_b", "_a").cast("bigint").alias(out))
    )


def bucketize(
    df: DataFrame,
    column: str,
    edges: Sequence[float] = GAP_EDGES,
    labels: Sequence[str] = GAP_LABELS,
    avg_name: str | None = "avg_days",
    group_name: str = "window_group",
    count_name: str = "user_cnt",
) -> DataFrame:
    """Rows per right-closed range with share and mean; empty ranges are absent.

    ``_ord`` is the position of the range.
    """
    measures = [F.count(F.lit(1)).alias(count_name)]
    if avg_name:
        measures.append(rnd(F.avg(column), 1).alias(avg_name))
    counted = df.groupBy(bucket_index(column, edges).alias("_ord")).agg(*measures)
    shared = share_of_total(counted, count_name)
    return shared.select(
        bucket_label("_ord", labels).alias(group_name),
        count_name,
        "pct",
        *([avg_name] if avg_name else []),
        "_ord",
    )
