"""KPI rows gathered from several tables and figures derived from data marts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.frames import distinct_count, gather_row
from orderlens.functions.numeric import major_units, minor_units, percent, rnd, total_units
from orderlens.operators.sketches import distinct_sketches, estimated
from orderlens.sources.model import CommerceModel


def order_metrics(model: CommerceModel) -> DataFrame:
    """All and delivered orders, in one pass over the status column."""
    delivered = F.col("order_status") == F.lit(model.delivered_status)
    return model.orders.agg(
        F.count(F.lit(1)).alias("total_orders"), F.count(F.when(delivered, F.lit(1))).alias("delivered_orders")
    )


def person_metrics(model: CommerceModel, lg_k: int | None = None) -> DataFrame:
    """Distinct persons; with ``lg_k`` an estimate from sketches of that size, without a shuffle of persons."""
    if lg_k is not None:
        sketch = distinct_sketches(model.identities, [], "customer_unique_id", lg_k)
        return sketch.select(estimated().alias("unique_customers"))
    return distinct_count(model.identities, "customer_unique_id", "unique_customers")


def order_sums(model: CommerceModel) -> DataFrame:
    """Amount (in millionths) and number of items per order, which KPIs and RFM share."""
    return model.order_items.groupBy("order_id").agg(
        F.sum(minor_units("price")).alias("_units"), F.count(F.lit(1)).alias("_items")
    )


def basket_metrics(model: CommerceModel) -> DataFrame:
    """Mean order value and items per order, over the items of all orders."""
    orders = F.count(F.lit(1)).cast("double")
    return order_sums(model).agg(
        rnd(F.try_divide(major_units(total_units("_units")), F.count("_units").cast("double")), 2).alias("avg_order_value"),
        rnd(F.try_divide(F.sum("_items").cast("double"), orders), 2).alias("avg_items_per_order"),
    )


def revenue_metrics(model: CommerceModel, sums: DataFrame | None = None) -> DataFrame:
    """Mean order value over all orders and revenue of the delivered ones.

    Both come from one aggregation of the items, joined once to the statuses;
    ``sums`` are those of :func:`order_sums` if they exist already.
    """
    status = model.delivered(model.orders).select("order_id", F.lit(True).alias("_delivered"))
    joined = (sums if sums is not None else order_sums(model)).join(status, "order_id", "left")
    delivered_units = total_units(F.when(F.col("_delivered"), F.col("_units")))
    return joined.agg(
        rnd(major_units(delivered_units), 2).alias("total_gmv"),
        rnd(F.try_divide(major_units(total_units("_units")), F.count("_units").cast("double")), 2).alias("avg_order_value"),
    )


def kpi_row(model: CommerceModel) -> DataFrame:
    """Delivered orders, persons, mean order value and items per order."""
    frames = [order_metrics(model).select("delivered_orders"), person_metrics(model), basket_metrics(model)]
    return gather_row(model.spark, frames)


def dashboard_kpis(model: CommerceModel, sums: DataFrame | None = None) -> DataFrame:
    """The eight scalars of the dashboard."""
    frames = [
        order_metrics(model),
        person_metrics(model),
        revenue_metrics(model, sums),
        model.order_reviews.agg(rnd(F.avg("review_score"), 2).alias("avg_review_score")),
        model.row_source("sellers").agg(F.count(F.lit(1)).alias("sellers")),
        model.row_source("products").agg(F.count(F.lit(1)).alias("products")),
    ]
    return gather_row(model.spark, frames)


def _only(df: DataFrame, **columns) -> DataFrame:
    """Aggregate a report-sized mart to one row of named values."""
    return df.agg(*[expr.alias(name) for name, expr in columns.items()])


def insights(
    marts: Mapping[str, DataFrame], focus_category: str, trend_start: str
) -> DataFrame:
    """The figures quoted in the dashboard text, as one row.

    Works on the marts only, all of which are report-sized. A figure whose
    category, stage or segment is absent is NULL.
    """
    at = lambda cond, col: F.max(F.when(cond, F.col(col)))
    nth = lambda k, col="cnt": at(F.col("_ord") == k, col)
    segment = lambda code, col: at(F.col("segment_code") == code, col)

    funnel = _only(
        marts["funnel"],
        step_approved_pct=percent(nth(1), nth(0)),
        step_carrier_pct=percent(nth(2), nth(1)),
        overall_delivered_pct=percent(nth(3), nth(0)),
    )
    kpis = marts["kpis"].select(
        rnd(F.col("total_gmv") / 1e6, 2).alias("gmv_millions"),
        percent("delivered_orders", "total_orders").alias("delivered_pct"),
        "unique_customers",
        "avg_order_value",
    )
    states = _only(marts["states"], top_state_customers=F.max("customer_cnt"))
    # Ties go to the earliest month: the larger negated month number wins last.
    month_key = F.regexp_replace("month", "-", "").cast("int")
    monthly = _only(
        marts["monthly"],
        _peak=F.max_by(F.struct("month", "order_cnt"), F.struct(F.col("order_cnt"), -month_key)),
        avg_monthly_orders=rnd(F.avg(F.when(F.col("month") >= trend_start, F.col("order_cnt"))), 2),
    ).select(
        F.col("_peak.month").alias("peak_month"),
        F.col("_peak.order_cnt").alias("peak_month_orders"),
        "avg_monthly_orders",
    )
    focus = F.col("category") == F.lit(focus_category)
    categories = _only(marts["categories"], _focus=at(focus, "total_revenue") / at(focus, "order_cnt"))
    reviews = _only(
        marts["review_dist"],
        five_star_pct=at(F.col("review_score") == 5, "pct"),
        one_star_pct=at(F.col("review_score") == 1, "pct"),
    )
    shipping = _only(
        marts["stage_times"],
        ship_avg_days=nth(2, "avg_v"),
        ship_median_days=nth(2, "median_v"),
        ship_p95_days=nth(2, "p95_v"),
    )
    windows = _only(marts["windows"], first_window_pct=F.min_by("pct", "_ord"))
    repeat = _only(
        marts["cat_repurchase"],
        _top=F.min_by(F.struct("category", "repurchase_rate"), F.struct(-F.col("repurchase_rate"), F.col("category"))),
    ).select(
        F.col("_top.category").alias("top_repeat_category"),
        F.col("_top.repurchase_rate").alias("top_repeat_rate"),
    )
    segments = _only(
        marts["rfm"],
        champion_users=segment("champions", "user_cnt"),
        champion_gmv_pct=segment("champions", "gmv_pct"),
        at_risk_users=segment("at_risk", "user_cnt"),
        at_risk_gmv_pct=segment("at_risk", "gmv_pct"),
    )
    frames = [kpis, funnel, states, monthly, categories, reviews, shipping, windows, repeat, segments]
    row = gather_row(marts["kpis"].sparkSession, frames)
    return row.withColumn("top_state_pct", percent("top_state_customers", "unique_customers")).withColumn(
        "focus_ticket_ratio", rnd(F.try_divide(F.col("_focus"), F.col("avg_order_value")), 2)
    ).drop("_focus", "unique_customers", "avg_order_value", "top_state_customers")
