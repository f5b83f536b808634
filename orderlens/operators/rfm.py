"""Recency, frequency, monetary: base table, quantile scores, median segments."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.frames import as_struct, inline_table, rows_from_columns
from orderlens.functions.labels import ascending_score, descending_score, named
from orderlens.functions.numeric import MONEY_UNIT, major_units, percent, rnd, total_units
from orderlens.operators.kpi import order_sums
from orderlens.operators.quantiles import describe_numeric, quantile_row, quantile_struct
from orderlens.operators.shares import distribution, share_of_total
from orderlens.sources.model import CommerceModel

PERSON = "customer_unique_id"

# Segment codes by (recency high, frequency high, monetary high).
SEGMENT_RULES: dict[tuple[bool, bool, bool], str] = {
    (True, True, True): "champions",
    (True, True, False): "loyal",
    (True, False, True): "potential_loyalists",
    (True, False, False): "new",
    (False, True, True): "at_risk",
    (False, True, False): "hibernating",
    (False, False, True): "promising",
    (False, False, False): "lost",
}

# Report labels, in report order. The sixth has no rule and is
# therefore always empty; it shows up only where empty segments are kept.
SEGMENT_LABELS: dict[str, str] = {
    "champions": "Champions（冠军用户）",
    "loyal": "Loyal Customers（忠诚用户）",
    "potential_loyalists": "Potential Loyalists（潜力忠诚）",
    "new": "New Customers（新用户）",
    "promising": "Promising（有潜力）",
    "needs_attention": "Needs Attention（需要关注）",
    "at_risk": "At Risk（流失风险）",
    "hibernating": "Hibernating（休眠用户）",
    "lost": "Lost（已流失）",
}

# The shorter labels of the dashboard, where they differ.
SHORT_SEGMENT_LABELS: dict[str, str] = {
    **SEGMENT_LABELS,
    "loyal": "Loyal（忠诚用户）",
    "new": "New（新用户）",
    "hibernating": "Hibernating（休眠）",
}

# Names of the score dimensions in reports.
DIMENSION_LABELS = {"R_score": "R (Recency)", "F_score": "F (Frequency)", "M_score": "M (Monetary)"}


def rfm_base(model: CommerceModel, as_of: date | None = None, sums: DataFrame | None = None) -> DataFrame:
    """Recency, frequency and monetary value per person with a delivered order.

    Recency counts days up to the day after the last purchase of all orders, or
    up to ``as_of``. Orders without items do not take part. Items are summed per
    order before the join, so the join sees one row per order on both sides.
    ``monetary_units`` is the same amount in whole millionths. ``sums`` are the
    amounts per order (``kpi.order_sums``) if they exist already.
    """
    amounts = order_sums(model) if sums is None else sums
    persons = (
        model.purchases()
        .join(amounts, "order_id")
        .groupBy(PERSON)
        .agg(
            F.max("order_purchase_timestamp").alias("_last"),
            F.count(F.lit(1)).alias("frequency"),
            F.sum("_units").alias("monetary_units"),
        )
    )
    if as_of is None:
        newest = model.orders.agg(F.max("order_purchase_timestamp").alias("ts"))
        today = F.date_add(as_struct(newest)["ts"].cast("date"), 1)
    else:
        today = F.lit(as_of)
    return persons.select(
        PERSON,
        F.datediff(today, F.col("_last").cast("date")).cast("bigint").alias("recency"),
        "frequency",
        major_units("monetary_units").alias("monetary"),
        "monetary_units",
    )


def rfm_measures() -> dict[str, tuple[Column, float]]:
    """The three measures as whole-number columns for the quantile operators."""
    return {
        "recency": (F.col("recency"), 1.0),
        "frequency": (F.col("frequency"), 1.0),
        "monetary": (F.col("monetary_units"), MONEY_UNIT),
    }


def quantile_edges(base: DataFrame, q: int = 5, descend: bool = True) -> DataFrame:
    """Minimum, the inner quantiles and maximum of each measure, as one row."""
    return quantile_row(base, rfm_measures(), {f"e{i}": i / q for i in range(q + 1)}, descend=descend)


def qcut_score(
    df: DataFrame,
    column: str,
    units: tuple[Column, float],
    q: int = 5,
    reverse: bool = False,
    out: str = "score",
    descend: bool = True,
) -> DataFrame:
    """Score one column by its own quantile bins, merged where edges coincide.

    ``units`` is the column as whole numbers and how many of them make one unit.
    """
    row = quantile_row(df, {"x": units}, {f"e{i}": i / q for i in range(q + 1)}, descend=descend)
    edges = [f"_edges.x_e{i}" for i in range(q + 1)]
    score = descending_score(column, edges) if reverse else ascending_score(column, edges)
    return df.withColumn("_edges", as_struct(row)).withColumn(out, score).drop("_edges")


def qcut_scores(base: DataFrame, q: int = 5, descend: bool = True) -> DataFrame:
    """Quantile scores with merged bins: recency reversed, the others ascending."""
    edges = as_struct(quantile_edges(base, q, descend))
    scored = base.withColumn("_edges", edges)

    def edge_list(name: str) -> list[str]:
        return [f"_edges.{name}_e{i}" for i in range(q + 1)]

    return scored.withColumns(
        {
            "R_score": descending_score("recency", edge_list("recency")),
            "F_score": ascending_score("frequency", edge_list("frequency")),
            "M_score": ascending_score("monetary", edge_list("monetary")),
        }
    ).drop("_edges")


def score_distribution(scored: DataFrame) -> DataFrame:
    """Persons per dimension and score."""
    rows = [
        {"dim": F.lit(label), "score": F.col(column).cast("bigint")}
        for column, label in DIMENSION_LABELS.items()
    ]
    return rows_from_columns(scored, rows).groupBy("dim", "score").agg(F.count(F.lit(1)).alias("user_cnt"))


def rfm_code() -> Column:
    return F.concat(*[F.col(c).cast("string") for c in DIMENSION_LABELS])


def segment_by_median(scored: DataFrame, rules: Mapping[tuple[bool, bool, bool], str] = SEGMENT_RULES) -> DataFrame:
    """Add the segment code: a score at or above its median counts as high.

    Scores have a handful of values whatever the size of the data, so the
    built-in percentile is safe for their medians.
    The three answers form a position in the list of codes, which keeps each
    score expression in the plan once.
    """
    scores = {c: (F.col(c), 1.0) for c in DIMENSION_LABELS}
    medians = quantile_struct(scored, scores, {"med": 0.5}, descend=False)
    high = [(F.col(c) >= F.col(f"_medians.{c}_med")).cast("int") for c in DIMENSION_LABELS]
    position = high[0] * 4 + high[1] * 2 + high[2] + 1
    codes = [rules[bool(i & 4), bool(i & 2), bool(i & 1)] for i in range(8)]
    code = F.element_at(F.array(*[F.lit(c) for c in codes]), position)
    return scored.withColumn("_medians", medians).withColumn("segment_code", code).drop("_medians")


def segment_label(code: str, labels: Mapping[str, str] = SEGMENT_LABELS) -> Column:
    return named(code, labels)


def rfm_segments(
    model: CommerceModel, q: int = 5, as_of: date | None = None, sums: DataFrame | None = None
) -> DataFrame:
    """The full chain: one row per person with measures, scores and segment code."""
    return segment_by_median(qcut_scores(rfm_base(model, as_of, sums), q))


def segment_summary(
    segmented: DataFrame, labels: Mapping[str, str] = SEGMENT_LABELS, keep_empty: bool = False
) -> DataFrame:
    """Size, averages, revenue and shares per segment.

    ``keep_empty`` lists all labels in report order, with NULL averages for the
    empty ones; the report order is in ``_ord``.
    """
    stats = segmented.groupBy("segment_code").agg(
        F.count(F.lit(1)).alias("user_cnt"),
        rnd(F.avg("recency"), 1).alias("avg_recency"),
        rnd(F.avg("frequency"), 2).alias("avg_frequency"),
        rnd(F.try_divide(major_units(total_units("monetary_units")), F.count(F.lit(1)).cast("double")), 2).alias(
            "avg_monetary"
        ),
        rnd(major_units(total_units("monetary_units")), 2).alias("total_gmv"),
    )
    if keep_empty:
        order = inline_table(segmented.sparkSession, ["segment_code", "_ord"], list(zip(labels, range(len(labels)))))
        stats = (
            order.join(stats, "segment_code", "left")
            .withColumn("user_cnt", F.coalesce("user_cnt", F.lit(0)))
            .withColumn("total_gmv", F.coalesce("total_gmv", F.lit(0.0)))
        )
    shares = share_of_total(share_of_total(stats, "user_cnt", "user_pct"), "total_gmv", "gmv_pct")
    named = shares.withColumn("segment", segment_label("segment_code", labels))
    columns = ["segment", "user_cnt", "avg_recency", "avg_frequency", "avg_monetary", "total_gmv", "user_pct", "gmv_pct"]
    return named.select(*columns, *(["_ord"] if keep_empty else []))


def minmax_scale(
    df: DataFrame, columns: Mapping[str, Column], eps: float = 1e-10, digits: int = 6, total: str = "scalar"
) -> DataFrame:
    """Scale columns to 0..1 by their own range; NULL stays NULL.

    ``total="window"`` is for report-sized inputs: ``df`` runs once and its rows
    meet in one task. ``total="scalar"`` finds the ranges by an aggregate of their
    own and leaves the rows where they are; use it for rows that grow with the data.
    """
    ends = {f"{n}_{end}": f(c.cast("double")) for n, c in columns.items() for end, f in (("min", F.min), ("max", F.max))}
    if total == "scalar":
        bounds: Column = as_struct(df.agg(*[end.alias(name) for name, end in ends.items()]))
    elif total == "window":
        bounds = F.struct(*[end.over(Window.partitionBy()).alias(name) for name, end in ends.items()])
    else:
        raise ValueError(f"unknown total mode: {total}")

    def scaled(name: str, value: Column) -> Column:
        low, high = F.col(f"_bounds.{name}_min"), F.col(f"_bounds.{name}_max")
        return rnd((value.cast("double") - low) / (high - low + F.lit(eps)), digits)

    return df.withColumn("_bounds", bounds).withColumns(
        {n: scaled(n, c) for n, c in columns.items()}
    ).drop("_bounds")


def segment_heatmap(summary: DataFrame) -> DataFrame:
    """Scaled segment profile; recency is negated so that higher is better."""
    profile = {
        "avg_recency": -F.col("avg_recency"),
        "avg_frequency": F.col("avg_frequency"),
        "avg_monetary": F.col("avg_monetary"),
    }
    return minmax_scale(summary, profile, total="window").select("segment", *profile)


def rfm_describe(base: DataFrame) -> DataFrame:
    """One row of averages, medians and extremes of the three measures, from one pass over ``base``.

    Every person has a frequency, so its count is that of the persons.
    """
    q = quantile_row(base, rfm_measures(), {"min": 0.0, "med": 0.5, "max": 1.0})
    users = F.col("frequency_n")
    spent = F.col("monetary_mean") * F.col("monetary_n")
    return q.select(
        users.alias("user_cnt"),
        rnd(F.col("recency_mean"), 2).alias("avg_recency"),
        F.col("recency_med").alias("median_recency"),
        F.col("recency_min").cast("bigint").alias("min_recency"),
        F.col("recency_max").cast("bigint").alias("max_recency"),
        rnd(F.col("frequency_mean"), 2).alias("avg_frequency"),
        F.col("frequency_med").alias("median_frequency"),
        F.col("frequency_max").cast("bigint").alias("max_frequency"),
        rnd(F.try_divide(spent, users.cast("double")), 2).alias("avg_monetary"),
        F.col("monetary_med").alias("median_monetary"),
        F.col("monetary_max").alias("max_monetary"),
    )


def quintile_cuts(base: DataFrame, descend: bool = True) -> DataFrame:
    """The four inner cut points of each measure, as one row."""
    row = quantile_row(base, rfm_measures(), {"q20": 0.2, "q40": 0.4, "q60": 0.6, "q80": 0.8}, descend=descend)
    short = {"recency": "r", "frequency": "f", "monetary": "m"}
    return row.select(
        *[F.col(f"{n}_{q}").alias(f"{s}_{q}") for n, s in short.items() for q in ("q20", "q40", "q60", "q80")]
    )


def describe_measures(base: DataFrame) -> DataFrame:
    return describe_numeric(base, rfm_measures())


def order_counts(model: CommerceModel) -> DataFrame:
    """Delivered orders with items per person, without touching prices."""
    with_items = model.order_items.select("order_id").distinct()
    return model.purchases().join(with_items, "order_id").groupBy(PERSON).agg(F.count(F.lit(1)).alias("frequency"))


def frequency_distribution(counts: DataFrame) -> DataFrame:
    return distribution(counts, "frequency", "user_cnt")


def one_vs_many(counts: DataFrame, digits: int = 1) -> DataFrame:
    """Persons with exactly one order against those with more, with shares."""
    one = F.count(F.when(F.col("frequency") == 1, F.lit(1)))
    many = F.count(F.when(F.col("frequency") > 1, F.lit(1)))
    return counts.agg(one.alias("one_time_users"), many.alias("multi_users"), F.count(F.lit(1)).alias("_n")).select(
        "one_time_users",
        percent("one_time_users", "_n", digits).alias("one_time_pct"),
        "multi_users",
        percent("multi_users", "_n", digits).alias("multi_pct"),
    )


def compare_scores(a: DataFrame, b: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Compare two scorings per key: keys on each side and mismatches per column.

    A key missing on one side counts as a mismatch in every column.
    """
    left = a.select(key, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(True).alias("_in_a"))
    right = b.select(key, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(True).alias("_in_b"))
    both = left.join(right, key, "full")
    present = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()

    def differs(c: str) -> Column:
        same = present & F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
        return F.count(F.when(~same, F.lit(1))).alias(f"{c}_mismatches")

    return both.agg(
        F.count(F.when(present, F.lit(1))).alias("compared"),
        F.count(F.when(F.col("_in_b").isNull(), F.lit(1))).alias("only_a"),
        F.count(F.when(F.col("_in_a").isNull(), F.lit(1))).alias("only_b"),
        *[differs(c) for c in columns],
    )
