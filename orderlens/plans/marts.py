"""Dashboard marts, the report figures and their writers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.dates import month_label
from orderlens.functions.numeric import MONEY_UNIT, minor_units, percent
from orderlens.operators import category, cohort, durations, kpi, profile, repurchase, rfm
from orderlens.operators.funnel import funnel, funnel_by
from orderlens.operators.quantiles import exact_quantiles
from orderlens.operators.shares import cumulative_share, distribution, monthly_trend, top_k
from orderlens.plans import parameters as P
from orderlens.plans.parameters import Parameters
from orderlens.sources.model import CommerceModel

PERSON, TS = "customer_unique_id", "order_purchase_timestamp"


def build_marts(
    model: CommerceModel,
    params: Parameters,
    segments: DataFrame | None = None,
    counts: DataFrame | None = None,
    sums: DataFrame | None = None,
    pairs: DataFrame | None = None,
) -> dict[str, Callable[[], DataFrame]]:
    """Name to builder for every dashboard data set.

    ``segments`` (one row per person), ``counts`` (cohort counts), ``sums`` (items
    per order) and ``pairs`` (items per order and category) are built from the
    model unless given, e.g. read back from a written table.
    """

    def scored() -> DataFrame:
        return segments if segments is not None else rfm.rfm_segments(model, sums=sums)

    def retention() -> DataFrame:
        base = counts if counts is not None else cohort.cohort_counts(model.purchases(), PERSON, TS)
        return cohort.cohort_retention(base, params.min_cohort)

    def stage_rows() -> DataFrame:
        labels = F.array(*[F.lit(label) for label, _ in P.DASHBOARD_STAGES])
        counted = funnel(model.orders, P.DASHBOARD_STAGES, count_name="cnt")
        return counted.select("stage", "cnt", (F.array_position(labels, F.col("stage")) - 1).alias("_ord"))

    def stage_times() -> DataFrame:
        units = F.create_map(*[F.lit(x) for pair in P.UNIT_LABELS.items() for x in pair])
        out = durations.stage_durations(model.orders, P.DASHBOARD_SPANS, ("avg_v", "median_v", "p95_v"))
        return out.withColumn("unit", F.element_at(units, F.col("unit")))

    def segment_rows() -> DataFrame:
        by_code = rfm.segment_summary(scored(), {c: c for c in rfm.SEGMENT_LABELS})
        return by_code.select(
            rfm.segment_label("segment", rfm.SHORT_SEGMENT_LABELS).alias("segment"),
            "user_cnt",
            "total_gmv",
            "user_pct",
            "gmv_pct",
            F.col("segment").alias("segment_code"),
        )

    def windows() -> DataFrame:
        gaps = repurchase.nth_gap(model.purchases(), PERSON, TS)
        buckets = repurchase.bucketize(
            gaps, "days_to_repurchase", labels=repurchase.GAP_LABELS_ZH, avg_name=None
        )
        return cumulative_share(buckets, "_ord", digits=1)

    return {
        "kpis": lambda: kpi.dashboard_kpis(model, sums),
        "repurchase": lambda: repurchase.repurchase_rate(model.purchases()).select(
            "total_users", "repurchase_users", "repurchase_rate"
        ),
        "monthly": lambda: monthly_trend(model.delivered(model.orders), month_label(TS)),
        "status": lambda: distribution(model.orders, "order_status", "order_cnt"),
        "review_dist": lambda: distribution(model.order_reviews, "review_score", "_n").drop("_n"),
        "categories": lambda: category.category_performance(model, k=15, drop_null=True, details=False, pairs=pairs),
        "states": lambda: top_k(profile.persons_by_state(model), "customer_cnt", 10, ["customer_state"]),
        "funnel": stage_rows,
        "stage_times": stage_times,
        "funnel_by_state": lambda: funnel_by(
            model.state_orders, "customer_state", P.DELIVERY_RATE, min_rows=params.min_rows, lookup=model.states
        ),
        "rfm": segment_rows,
        "cohort": lambda: retention().withColumn("cohort_month", F.date_format("cohort_month", "yyyy-MM")),
        "cohort_matrix": lambda: cohort.retention_matrix(retention(), digits=None),
        "avg_retention": lambda: cohort.retention_curve(retention(), max_offset=12),
        "windows": windows,
        "cat_repurchase": lambda: category.category_repurchase(model, params.min_buyers, pairs=pairs).drop("repurchase_buyers"),
    }


def write_marts(
    model: CommerceModel,
    out_dir: str,
    params: Parameters = Parameters(),
    fmt: str = "parquet",
    sums: DataFrame | None = None,
    pairs: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Write every mart below ``out_dir`` and return the written frames.

    Items per order, items per order and category, the person table and the cohort
    counts feed several marts: they are written first and read back, so items are
    scanned once for each grain, the heavy joins run once and a lost executor
    never re-runs them. ``out_dir`` must be storage all executors share. ``sums`` and
    ``pairs`` are used as they are if given, e.g. from facts kept by month.
    """

    def save(name: str, df: DataFrame, small: bool = True) -> DataFrame:
        path = f"{out_dir}/{name}"
        (df.repartition(1) if small else df).write.mode("overwrite").format(fmt).save(path)
        return model.spark.read.format(fmt).load(path)

    if sums is None:
        sums = save("order_sums", kpi.order_sums(model), small=False)
    if pairs is None:
        products = category.product_categories(model)
        pairs = save("order_categories", category.order_categories(model, products, money=True), small=False)
    persons = save("person_segments", rfm.rfm_segments(model, sums=sums), small=False)
    counts = save("cohort_counts", cohort.cohort_counts(model.purchases(), PERSON, TS))
    written = {"order_sums": sums, "order_categories": pairs, "person_segments": persons, "cohort_counts": counts}
    for name, build in build_marts(model, params, persons, counts, sums, pairs).items():
        written[name] = save(name, build())
    written["insights"] = save("insights", kpi.insights(written, params.focus_category, params.trend_start))
    return written


def report_facts(model: CommerceModel) -> DataFrame:
    """The figures of the written report as (section, metric, label, value) rows."""

    def facts(section: str, one_row: DataFrame) -> DataFrame:
        cells = [
            F.struct(F.lit(c).alias("metric"), F.lit(None).cast("string").alias("label"), F.col(c).cast("double").alias("value"))
            for c in one_row.columns
        ]
        return one_row.select(F.lit(section).alias("section"), F.inline(F.array(*cells)))

    def labelled(section: str, metric: str, df: DataFrame, label: str, value: str) -> DataFrame:
        return df.select(
            F.lit(section).alias("section"),
            F.lit(metric).alias("metric"),
            F.col(label).cast("string").alias("label"),
            F.col(value).cast("double").alias("value"),
        )

    months = monthly_trend(model.orders, month_label(TS))
    covered = months.select(
        F.lit("platform").alias("section"),
        F.lit("month_range").alias("metric"),
        "month",
        "order_cnt",
    ).groupBy("section", "metric").agg(
        F.concat_ws(" ~ ", F.min("month"), F.max("month")).alias("label"),
        F.count(F.lit(1)).cast("double").alias("value"),
    )
    performance = category.category_performance(model, k=20)
    order_units = model.order_items.groupBy("order_id").agg(F.sum(minor_units("price")).alias("units"))
    median = exact_quantiles(order_units, {"median_order_value": (F.col("units"), MONEY_UNIT)}, [0.5], digits=2)
    times = durations.stage_durations(model.orders, P.STAGE_SPANS)
    states = profile.persons_by_state(model)
    payments = distribution(model.order_payments, "payment_type", "n")
    reviews = distribution(model.order_reviews, "review_score", "n")
    named = category.product_categories(model).filter(F.col("category").isNotNull())
    parts = [
        covered,
        facts("platform", kpi.dashboard_kpis(model)),
        facts("platform", kpi.order_metrics(model).select(percent("delivered_orders", "total_orders").alias("delivered_pct"))),
        facts("platform", named.agg(F.countDistinct("category").alias("categories"))),
        labelled("category", "top_by_orders", top_k(performance, "order_cnt", 3, ["category"]), "category", "order_cnt"),
        labelled("category", "top_by_revenue", top_k(performance, "total_revenue", 3, ["category"]), "category", "total_revenue"),
        facts("behaviour", repurchase.repurchase_rate(model.purchases())),
        facts("behaviour", repurchase.repeat_stats(model.identities)),
        labelled("behaviour", "top_state", top_k(states, "customer_cnt", 1, ["customer_state"]), "customer_state", "customer_cnt"),
        facts("trade", kpi.basket_metrics(model)),
        labelled("trade", "median", median, "dim", "value"),
        labelled("trade", "payment_pct", top_k(payments, "n", 2, ["payment_type"]), "payment_type", "pct"),
        labelled("operations", "stage_avg", times, "stage", "avg_hours"),
        labelled("operations", "review_pct", reviews.filter(F.col("review_score").isin(1, 5)), "review_score", "pct"),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_report_facts(model: CommerceModel, out_dir: str, fmt: str = "json") -> None:
    report_facts(model).repartition(1).write.mode("overwrite").format(fmt).save(out_dir)
