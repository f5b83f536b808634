"""Operators on small hand-made frames: the edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orderlens.functions.dates import elapsed_micros, month_label, months_between_labels
from orderlens.functions.numeric import exact_avg, exact_sum, percent, rnd
from orderlens.operators import cohort, durations, lookups, reconcile, repurchase, rfm, shares
from orderlens.operators.durations import Span
from orderlens.operators.funnel import funnel, funnel_by
from orderlens.sources.model import StateLookup

D, TS = dt.date, dt.datetime


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# --- expressions -------------------------------------------------------------


def test_rounding_is_half_up_on_the_decimal_reading(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (-1.005,), (0.1 + 0.2,), (None,)], "x double")
    assert [r[0] for r in df.select(rnd("x", 2)).collect()] == [1.01, 2.68, -1.01, 0.3, None]


def test_percent_of_zero_is_null(spark):
    df = spark.createDataFrame([(1, 4), (1, 0)], "a bigint, b bigint")
    assert [r[0] for r in df.select(percent("a", "b")).collect()] == [25.0, None]


def test_money_sums_are_exact(spark):
    df = spark.createDataFrame([(0.1,)] * 1000 + [(1e12,)], "x double")
    row = df.agg(exact_sum("x").alias("s"), exact_avg("x").alias("a")).first()
    assert row["s"] == 1_000_000_000_100.0


def test_elapsed_time_ignores_zone_and_keeps_sign_and_micros(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    a, b = "timestamp_ntz'2024-03-31 00:30:00.25'", "timestamp_ntz'2024-03-31 04:30:00.5'"
    df = spark.sql(f"SELECT {a} AS a, {b} AS b")
    try:
        for name in ("UTC", "Europe/Berlin", "America/Sao_Paulo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            forth, back = df.select(elapsed_micros("a", "b"), elapsed_micros("b", "a")).first()
            assert forth == 4 * 3600 * 1_000_000 + 250_000 and back == -forth
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_month_offset_counts_boundaries(spark):
    df = spark.createDataFrame([(D(2024, 1, 31), D(2024, 2, 1)), (D(2023, 12, 1), D(2024, 12, 31))], "a date, b date")
    assert [r[0] for r in df.select(months_between_labels("a", "b")).collect()] == [1, 12]


# --- shares ------------------------------------------------------------------


def test_share_modes_agree(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 4)], "k string, n bigint")
    window = rows(shares.share_of_total(df, "n"), "k")
    assert window == rows(shares.share_of_total(df, "n", total="scalar"), "k")
    assert [r[2] for r in window] == [14.29, 28.57, 57.14]
    with pytest.raises(ValueError):
        shares.share_of_total(df, "n", total="other")


def test_top_k_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("c", 5), ("a", 5), ("b", 5), ("d", 9)], "k string, n int")
    assert [r[0] for r in rows(shares.top_k(df, "n", 3, ["k"]))] == ["d", "a", "b"]


def test_months_without_rows_are_absent(spark):
    df = spark.createDataFrame([(D(2024, 1, 5),), (D(2024, 3, 5),)], "d date")
    assert rows(shares.monthly_trend(df, month_label("d")), "month") == [("2024-01", 1), ("2024-03", 1)]


def test_repeat_distribution_has_total_even_when_empty(spark):
    ids = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3), (5, 3), (6, 3)], "customer_id int, customer_unique_id int")
    out = repurchase.repeat_distribution(ids).orderBy(F.col("_ord").asc_nulls_last()).drop("_ord")
    assert rows(out) == [("2", 1, 50.0), ("3", 1, 50.0), ("合计", 2, 100.0)]
    nobody = ids.filter("customer_unique_id = 2")
    assert rows(repurchase.repeat_distribution(nobody).drop("_ord")) == [("合计", 0, 100.0)]


# --- lookups -----------------------------------------------------------------


def test_dedup_before_join_does_not_multiply(spark):
    zips = spark.createDataFrame([("01", 3), ("01", 1), ("01", 2), ("02", 9)], "zip string, lat int")
    people = spark.createDataFrame([("p", "01"), ("q", "02"), ("r", "01")], "who string, zip string")
    one = lookups.dedup_by_key(zips, ["zip"], ["lat"])
    assert rows(one, "zip") == [("01", 1), ("02", 9)]
    assert people.join(one, "zip").count() == 3


def test_translation_falls_back_and_keeps_null(spark):
    items = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, k string")
    words = spark.createDataFrame([("x", "ex")], "k string, v string")
    out = lookups.translate(items, words, "k", "v", "name").select("id", "name")
    assert rows(out, "id") == [(1, "ex"), (2, "y"), (3, None)]


# --- funnel and durations ----------------------------------------------------

STAGES = [("one", "a"), ("two", "b"), ("three", "c")]


@pytest.fixture
def staged(spark):
    t = TS(2024, 1, 1)
    data = [
        ("g", t, t, None),
        ("g", t, None, t),
        ("g", None, None, None),
        ("h", None, None, t),
    ]
    return spark.createDataFrame(data, "g string, a timestamp_ntz, b timestamp_ntz, c timestamp_ntz")


def test_stages_are_independent(staged):
    assert rows(funnel(staged, STAGES)) == [
        ("one", 2, 100.0, None),
        ("two", 1, 50.0, 50.0),
        ("three", 2, 100.0, 200.0),
    ]


def test_row_base_and_groups(staged):
    assert [r[2] for r in rows(funnel(staged, STAGES, base="rows"))] == [50.0, 25.0, 50.0]
    grouped = rows(funnel(staged, STAGES, by=["g"]).filter("stage = 'three'"), "g")
    assert grouped == [("g", "three", 1, 50.0, 100.0), ("h", "three", 1, None, None)]


def test_funnel_by_with_and_without_lookup(spark, staged):
    ratios = {"two_rate": ("b", "a")}
    direct = rows(funnel_by(staged, "g", ratios, min_rows=1))
    assert direct == [("g", 3, 50.0), ("h", 1, None)]
    names = spark.createDataFrame([("g", "north"), ("h", "north")], "g string, area string")
    out = funnel_by(staged, "area", ratios, min_rows=1, lookup=StateLookup("g", names))
    assert rows(out) == [("north", 4, 50.0)]
    assert rows(funnel_by(staged, "g", ratios, min_rows=2)) == [("g", 3, 50.0)]


def test_durations_keep_negatives_and_skip_null_starts(spark):
    t = TS(2024, 1, 10)
    data = [(t, t + dt.timedelta(hours=6)), (t, t - dt.timedelta(hours=2)), (None, t), (t, None)]
    df = spark.createDataFrame(data, "a timestamp_ntz, b timestamp_ntz")
    spans = [Span("ab", "a", "b", "hours"), Span("ba", "b", "a", "days")]
    out = rows(durations.stage_durations(df, spans).drop("_ord"))
    assert out == [("ab", 2.0, 2.0, 5.6, "hours"), ("ba", -0.1, -0.1, 0.1, "days")]
    each = [r["ab"] for r in durations.with_durations(df, spans).collect()]
    assert each == [6.0, -2.0, None, None]


def test_span_without_rows_keeps_its_row(spark):
    df = spark.createDataFrame([(None, None)], "a timestamp_ntz, b timestamp_ntz")
    assert rows(durations.stage_durations(df, [Span("ab", "a", "b", "hours")]).drop("_ord")) == [
        ("ab", None, None, None, "hours")
    ]


def test_box_statistics_match_numpy(spark):
    import numpy as np

    hours = [1, 2, 2, 3, 4, 5, 7, 8, 40]
    t = TS(2024, 1, 1)
    df = spark.createDataFrame([(t, t + dt.timedelta(hours=h)) for h in hours], "a timestamp_ntz, b timestamp_ntz")
    row = durations.box_stats(df, [Span("ab", "a", "b", "hours")]).first()
    clipped = np.minimum(hours, np.quantile(hours, 0.99))
    q1, med, q3 = np.quantile(clipped, [0.25, 0.5, 0.75])
    inside = clipped[(clipped >= q1 - 1.5 * (q3 - q1)) & (clipped <= q3 + 1.5 * (q3 - q1))]
    assert (row["q1"], row["median"], row["q3"]) == pytest.approx((q1, med, q3))
    assert (row["whisker_low"], row["whisker_high"]) == pytest.approx((inside.min(), inside.max()))
    assert row["fliers"] == len(clipped) - len(inside) and row["n"] == 9


# --- cohorts and gaps --------------------------------------------------------


@pytest.fixture
def purchases(spark):
    data = [
        ("a", 1, TS(2024, 1, 31)),
        ("a", 2, TS(2024, 3, 1)),
        ("a", 3, TS(2024, 3, 2)),
        ("b", 4, TS(2024, 1, 2)),
        ("c", 5, TS(2024, 2, 10, 8)),
        ("c", 6, TS(2024, 2, 10, 9)),
        ("c", 7, TS(2024, 4, 1)),
    ]
    return spark.createDataFrame(data, "person string, order_id int, ts timestamp_ntz")


def test_cohorts_skip_absent_offsets(purchases):
    counts = cohort.cohort_counts(purchases, "person", "ts")
    assert rows(counts, "cohort_month", "offset_month") == [
        (D(2024, 1, 1), 0, 2),
        (D(2024, 1, 1), 2, 1),
        (D(2024, 2, 1), 0, 1),
        (D(2024, 2, 1), 2, 1),
    ]
    kept = cohort.cohort_retention(counts, min_size=1, digits=None)
    assert rows(cohort.retention_curve(kept), "offset_month") == [(0, 100.0), (2, 75.0)]
    big = cohort.cohort_retention(counts, min_size=2)
    assert rows(big, "offset_month") == [(D(2024, 1, 1), 0, 2, 100.0), (D(2024, 1, 1), 2, 1, 50.0)]
    wide = cohort.retention_matrix(kept, months=3)
    assert rows(wide, "cohort_month") == [("2024-01", 100.0, None, 50.0), ("2024-02", 100.0, None, 100.0)]


def test_gap_of_one_day_and_of_single_orders(purchases):
    gaps = repurchase.nth_gap(purchases, "person", "ts")
    assert rows(gaps, "person") == [("a", 30), ("c", 0)]
    later = repurchase.nth_gap(purchases, "person", "ts", a=2, b=3)
    assert rows(later, "person") == [("a", 1), ("c", 51)]


def test_repurchase_rate(purchases):
    out = repurchase.repurchase_rate(purchases, "person")
    assert rows(out) == [(3, 2, 2, 66.67, 2.33, 3)]


def test_buckets_are_right_closed_and_empty_ones_absent(spark):
    df = spark.createDataFrame([(0,), (7,), (8,), (180,), (181,)], "d bigint")
    out = repurchase.bucketize(df, "d").orderBy("_ord")
    assert [(r["window_group"], r["user_cnt"]) for r in out.collect()] == [
        ("0-7 days", 2),
        ("8-14 days", 1),
        ("91-180 days", 1),
        ("180+ days", 1),
    ]
    running = shares.cumulative_share(out, "_ord").orderBy("_ord").collect()
    assert [r["cum_pct"] for r in running] == [40.0, 60.0, 80.0, 100.0]


# --- segments ----------------------------------------------------------------


@pytest.fixture
def scored(spark):
    data = [(1, 5, 1, 5), (2, 5, 1, 1), (3, 1, 1, 5), (4, 1, 1, 1)]
    df = spark.createDataFrame(data, "customer_unique_id int, R_score int, F_score int, M_score int")
    return df.withColumns(
        {
            "recency": F.lit(10).cast("bigint"),
            "frequency": F.lit(1).cast("bigint"),
            "monetary": F.lit(2.5),
            "monetary_units": F.lit(2_500_000).cast("bigint"),
        }
    )


def test_segments_by_median(scored):
    out = rfm.segment_by_median(scored)
    assert [r["segment_code"] for r in out.orderBy("customer_unique_id").collect()] == [
        "champions",
        "loyal",
        "at_risk",
        "hibernating",
    ]


def test_empty_segments_only_on_request(scored):
    segmented = rfm.segment_by_median(scored)
    assert rfm.segment_summary(segmented).count() == 4
    full = rfm.segment_summary(segmented, keep_empty=True).orderBy("_ord").collect()
    assert [r["segment"] for r in full] == list(rfm.SEGMENT_LABELS.values())
    empty = full[5]
    assert (empty["user_cnt"], empty["total_gmv"], empty["avg_recency"], empty["user_pct"]) == (0, 0.0, None, 0.0)
    assert sum(r["user_cnt"] for r in full) == 4
    heat = rfm.segment_heatmap(rfm.segment_summary(segmented, keep_empty=True))
    assert heat.filter("avg_recency IS NULL").count() == 5


def test_compare_scores_counts_missing_and_different(spark):
    a = spark.createDataFrame([(1, 5), (2, 3), (3, None)], "k int, s int")
    b = spark.createDataFrame([(1, 5), (2, 4), (3, None), (4, 1)], "k int, s int")
    assert rows(rfm.compare_scores(a, b, "k", ("s",))) == [(3, 0, 1, 2)]


def test_reconcile_verdicts(spark):
    one = spark.createDataFrame([(10, 2.004, None, 7)], "a int, b double, c double, d int")
    actual = reconcile.metrics_long(one)
    expected = reconcile.expected_metrics(one, {"a": 10, "b": 2.0, "d": 8, "e": 1})
    out = {r["metric"]: r["status"] for r in reconcile.reconcile(actual, expected, tol=0.005).collect()}
    assert out == {"a": "ok", "b": "ok", "c": "extra", "d": "differs", "e": "missing"}
