"""The named queries, grouped by stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.dates import month_label
from orderlens.operators import category, cohort, durations, kpi, profile, repurchase, rfm
from orderlens.operators.funnel import funnel, funnel_by
from orderlens.operators.shares import cumulative_share, distribution, monthly_trend, share_of_total, top_k
from orderlens.plans import parameters as P
from orderlens.plans.marts import build_marts
from orderlens.plans.parameters import Parameters
from orderlens.sources.model import CommerceModel

Build = Callable[[CommerceModel, Parameters], DataFrame]
PERSON, TS = "customer_unique_id", "order_purchase_timestamp"


@dataclass(frozen=True)
class NamedQuery:
    id: str
    stage: str
    title: str
    build: Build


CATALOG: dict[str, NamedQuery] = {}


def named(query_id: str, stage: str, title: str) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        CATALOG[query_id] = NamedQuery(query_id, stage, title, build)
        return build

    return register


def run_catalog(
    model: CommerceModel, stage: str | None = None, params: Parameters = Parameters()
) -> Iterator[tuple[str, str, DataFrame]]:
    """Yield (id, title, frame) of a stage in order; nothing runs until used."""
    for query in CATALOG.values():
        if stage in (None, query.stage):
            yield query.id, query.title, query.build(model, params)


def _sorted_by_ord(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("_ord").asc_nulls_last()).drop("_ord")


# --- overview ---------------------------------------------------------------


@named("q01_01_table_sizes", "overview", "Rows of each table")
def table_sizes(m, p):
    return profile.table_sizes(m).orderBy(F.desc("row_cnt"), "table_name")


@named("q01_02_status_share", "overview", "Orders and share per status")
def status_share(m, p):
    return distribution(m.orders, "order_status", "order_cnt").orderBy(F.desc("order_cnt"), "order_status")


@named("q01_03_monthly_trend", "overview", "Delivered orders per month")
def delivered_per_month(m, p):
    return monthly_trend(m.delivered(m.orders), month_label(TS)).orderBy("month")


@named("q01_04_category_top20", "overview", "Category performance, top 20 by orders")
def category_top20(m, p):
    return category.category_performance(m, k=20)


@named("q01_05_identity_audit", "overview", "Order identities against persons")
def identity_audit(m, p):
    return repurchase.identity_audit(m.identities)


@named("q01_06_repeat_distribution", "overview", "Order identities per repeat person, with total")
def repeat_distribution(m, p):
    return _sorted_by_ord(repurchase.repeat_distribution(m.identities))


def _state_share(m: CommerceModel) -> DataFrame:
    return share_of_total(profile.persons_by_state(m), "customer_cnt")


@named("q01_07_state_share", "overview", "Persons and share per state")
def state_share(m, p):
    return _state_share(m).orderBy(F.desc("customer_cnt"), "customer_state")


@named("q01_08_payment_share", "overview", "Payments, share and mean value per type")
def payment_share(m, p):
    out = distribution(m.order_payments, "payment_type", "pay_cnt", avg_of="payment_value", avg_name="avg_value")
    return out.orderBy(F.desc("pay_cnt"), "payment_type")


@named("q01_09_review_share", "overview", "Reviews and share per score")
def review_share(m, p):
    return distribution(m.order_reviews, "review_score", "review_cnt").orderBy("review_score")


@named("q01_10_kpi_row", "overview", "Key figures in one row")
def kpi_row(m, p):
    return kpi.kpi_row(m)


@named("n1_coverage", "overview", "First and last purchase")
def coverage(m, p):
    return profile.coverage(m.orders, TS)


@named("n1_table_overview", "overview", "Rows, columns and leading columns per table")
def table_overview(m, p):
    return profile.table_overview(m)


@named("n1_category_top10_by_revenue", "overview", "Top 10 by revenue within the top 20 by orders")
def category_top10_by_revenue(m, p):
    return top_k(category.category_performance(m, k=20), "total_revenue", 10, ["category"])


@named("n1_repeat_stats", "overview", "Persons with several order identities")
def repeat_stats(m, p):
    return repurchase.repeat_stats(m.identities)


@named("n1_state_top10", "overview", "Ten states with most persons")
def state_top10(m, p):
    return top_k(_state_share(m), "customer_cnt", 10, ["customer_state"])


@named("n1_top_state_share", "overview", "Share of the leading state")
def top_state_share(m, p):
    return top_k(_state_share(m), "customer_cnt", 1, ["customer_state"]).select("customer_state", "pct")


# --- funnel -----------------------------------------------------------------


@named("q02_01_order_funnel", "funnel", "Order funnel with overall and step rates")
def order_funnel(m, p):
    return funnel(m.orders, P.ORDER_STAGES)


@named("q02_02_stage_durations", "funnel", "Mean, median and 95th percentile per stage")
def stage_durations(m, p):
    return durations.stage_durations(m.orders, P.STAGE_SPANS).orderBy("_ord").drop("_ord", "unit")


@named("q02_03_duration_by_status", "funnel", "Mean stage durations per status")
def duration_by_status(m, p):
    out = durations.duration_by(m.orders, "order_status", P.STATUS_SPANS)
    return out.orderBy(F.desc("order_cnt"), "order_status")


@named("q02_04_funnel_by_state", "funnel", "Delivery and carrier rate per state, ten largest")
def funnel_by_state(m, p):
    return funnel_by(m.state_orders, "customer_state", P.STATE_RATIOS, min_rows=p.min_rows, lookup=m.states)


@named("n2_funnel_rowbase", "funnel", "Order funnel over the number of rows")
def funnel_rowbase(m, p):
    return funnel(m.orders, P.ORDER_STAGES, base="rows", count_name="cnt")


@named("n2_order_durations", "funnel", "Four durations per order")
def order_durations(m, p):
    return durations.with_durations(m.orders, P.ORDER_SPANS, digits=6).select(
        "order_id", *[s.label for s in P.ORDER_SPANS]
    )


@named("n2_box_stats", "funnel", "Box-plot numbers of the stage durations, delivered orders")
def box_stats(m, p):
    return durations.box_stats(m.delivered(m.orders), P.ORDER_SPANS[:3])


# --- segmentation -----------------------------------------------------------


@named("q03_01_rfm_describe", "segmentation", "Persons and their measures in one row")
def rfm_describe(m, p):
    return rfm.rfm_describe(rfm.rfm_base(m))


@named("q03_02_quintile_cuts", "segmentation", "Inner quintile cut points")
def quintile_cuts(m, p):
    return rfm.quintile_cuts(rfm.rfm_base(m))


@named("q03_03_score_distribution", "segmentation", "Persons per dimension and score")
def score_distribution(m, p):
    return rfm.score_distribution(rfm.qcut_scores(rfm.rfm_base(m))).orderBy("dim", "score")


@named("q03_04_segment_summary", "segmentation", "Size, averages and shares per segment")
def segment_summary(m, p):
    return rfm.segment_summary(rfm.rfm_segments(m)).orderBy(F.desc("total_gmv"), "segment")


@named("q03_05_frequency_distribution", "segmentation", "Persons per number of orders")
def frequency_distribution(m, p):
    return rfm.frequency_distribution(rfm.order_counts(m)).orderBy("frequency")


@named("n3_rfm_table", "segmentation", "Measures, scores, code and segment per person")
def rfm_table(m, p):
    return rfm.rfm_segments(m).select(
        PERSON,
        "recency",
        "frequency",
        "monetary",
        "R_score",
        "F_score",
        "M_score",
        rfm.rfm_code().alias("RFM_score"),
        rfm.segment_label("segment_code").alias("segment"),
    )


@named("n3_describe", "segmentation", "Describe table of the three measures")
def rfm_describe_table(m, p):
    return _sorted_by_ord(rfm.describe_measures(rfm.rfm_base(m)))


@named("n3_segment_summary_all", "segmentation", "Segment summary with empty segments")
def segment_summary_all(m, p):
    return _sorted_by_ord(rfm.segment_summary(rfm.rfm_segments(m), keep_empty=True))


@named("n3_segment_heatmap", "segmentation", "Scaled profile per segment")
def segment_heatmap(m, p):
    return rfm.segment_heatmap(rfm.segment_summary(rfm.rfm_segments(m), keep_empty=True))


@named("n3_frequency_first20", "segmentation", "The twenty lowest order counts")
def frequency_first20(m, p):
    return rfm.frequency_distribution(rfm.order_counts(m)).select("frequency", "user_cnt").orderBy("frequency").limit(20)


@named("n3_one_vs_many", "segmentation", "One-time against repeat persons")
def one_vs_many(m, p):
    return rfm.one_vs_many(rfm.order_counts(m))


# --- retention --------------------------------------------------------------


def _counts(m: CommerceModel) -> DataFrame:
    return cohort.cohort_counts(m.purchases(), PERSON, TS)


@named("q04_01_repurchase_rate", "retention", "Repurchase rate")
def repurchase_rate(m, p):
    return repurchase.repurchase_rate(m.purchases())


@named("q04_02_cohort_counts", "retention", "Persons per cohort and month offset")
def cohort_counts(m, p):
    return _counts(m).orderBy("cohort_month", "offset_month")


@named("q04_03_cohort_retention", "retention", "Retention per cohort and month offset")
def cohort_retention(m, p):
    return cohort.cohort_retention(_counts(m), p.min_cohort).orderBy("cohort_month", "offset_month")


@named("q04_04_retention_matrix", "retention", "Retention matrix over twelve months")
def retention_matrix(m, p):
    exact = cohort.cohort_retention(_counts(m), p.min_cohort, digits=None)
    return cohort.retention_matrix(exact).orderBy("cohort_month")


@named("q04_05_retention_curve", "retention", "Mean retention per month offset")
def retention_curve(m, p):
    exact = cohort.cohort_retention(_counts(m), p.min_cohort, digits=None)
    return cohort.retention_curve(exact).orderBy("offset_month")


def _gaps(m: CommerceModel) -> DataFrame:
    return repurchase.nth_gap(m.purchases(), PERSON, TS)


@named("q04_06_repurchase_windows", "retention", "Days to the second order, in ranges")
def repurchase_windows(m, p):
    return _sorted_by_ord(repurchase.bucketize(_gaps(m), "days_to_repurchase"))


@named("q04_07_category_repurchase", "retention", "Repurchase rate per category, top 15")
def category_repurchase(m, p):
    return category.category_repurchase(m, p.min_buyers)


@named("n4_retention_counts_matrix", "retention", "Persons per cohort and month since the first purchase")
def retention_counts_matrix(m, p):
    kept = cohort.cohort_retention(_counts(m), p.min_cohort)
    # Long form, as the number of offsets follows from the data.
    label = F.date_format("cohort_month", "yyyy-MM").alias("cohort_month")
    return kept.select(label, "offset_month", "user_cnt").orderBy("cohort_month", "offset_month")


@named("n4_cumulative_windows", "retention", "Cumulative share over the gap ranges")
def cumulative_windows(m, p):
    buckets = repurchase.bucketize(_gaps(m), "days_to_repurchase")
    return _sorted_by_ord(cumulative_share(buckets, "_ord").select("window_group", "pct", "cum_pct", "_ord"))


# --- dashboard --------------------------------------------------------------


def _mart(name: str) -> Build:
    return lambda m, p: build_marts(m, p)[name]()


@named("d_kpis", "dashboard", "Eight dashboard figures")
def dashboard_kpis(m, p):
    return _mart("kpis")(m, p)


@named("d_repurchase", "dashboard", "Repurchase figures")
def dashboard_repurchase(m, p):
    return _mart("repurchase")(m, p)


@named("d_review_dist", "dashboard", "Share per review score")
def dashboard_reviews(m, p):
    return _mart("review_dist")(m, p).orderBy("review_score")


@named("d_categories15", "dashboard", "Top 15 named categories")
def dashboard_categories(m, p):
    return _mart("categories")(m, p)


@named("d_states10", "dashboard", "Top ten states")
def dashboard_states(m, p):
    return _mart("states")(m, p)


@named("d_funnel", "dashboard", "Funnel counts")
def dashboard_funnel(m, p):
    return _mart("funnel")(m, p).drop("_ord")


@named("d_stage_times", "dashboard", "Stage durations with unit")
def dashboard_stage_times(m, p):
    return _sorted_by_ord(_mart("stage_times")(m, p))


@named("d_funnel_by_state", "dashboard", "Delivery rate per state")
def dashboard_funnel_by_state(m, p):
    return _mart("funnel_by_state")(m, p)


@named("d_rfm", "dashboard", "Segments with short labels")
def dashboard_rfm(m, p):
    return _mart("rfm")(m, p).drop("segment_code").orderBy(F.desc("total_gmv"), "segment")


@named("d_cohort", "dashboard", "Retention with month labels")
def dashboard_cohort(m, p):
    return _mart("cohort")(m, p).orderBy("cohort_month", "offset_month")


@named("d_cohort_matrix", "dashboard", "Heatmap cells of the rounded retention")
def dashboard_cohort_matrix(m, p):
    return _mart("cohort_matrix")(m, p).orderBy("cohort_month")


@named("d_avg_retention12", "dashboard", "Mean of rounded retention up to month 12")
def dashboard_avg_retention(m, p):
    return _mart("avg_retention")(m, p).orderBy("offset_month")


@named("d_windows", "dashboard", "Gap ranges with cumulative share")
def dashboard_windows(m, p):
    return _sorted_by_ord(_mart("windows")(m, p))


@named("d_category_repurchase", "dashboard", "Repurchase rate per category")
def dashboard_category_repurchase(m, p):
    return _mart("cat_repurchase")(m, p)


@named("d_insights", "dashboard", "Figures of the dashboard text")
def dashboard_insights(m, p):
    marts = build_marts(m, p)
    needed = ("kpis", "funnel", "states", "monthly", "categories", "review_dist", "stage_times", "windows",
              "cat_repurchase", "rfm")
    return kpi.insights({n: marts[n]() for n in needed}, p.focus_category, p.trend_start)
