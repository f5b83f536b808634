"""Queries for operators and options that no named query exercises.

Each one runs over whole tables. They take (model, directory) and are checked by
the SQL of :func:`check_statements` where SQL can express them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.dates import month_label
from orderlens.functions.numeric import MONEY_UNIT, exact_sum, minor_units, rnd
from orderlens.operators import category, cohort, durations, kpi, reconcile, repurchase, rfm
from orderlens.operators.durations import Span
from orderlens.operators.funnel import funnel
from orderlens.operators.lookups import dedup_by_key
from orderlens.operators.quantiles import describe_numeric, exact_quantiles, winsorize
from orderlens.operators.shares import avg_of_group, share_of_total
from orderlens.operators.sketches import distinct_sketches, estimated, roll_up, standard_error
from orderlens.plans.marts import build_marts, report_facts
from orderlens.plans.oracle import PCT, R, sql
from orderlens.plans.parameters import STAR_PARAMETERS
from orderlens.sources.model import CommerceModel

PERSON, TS = "customer_unique_id", "order_purchase_timestamp"

# Stages of the event lifecycle, per user and day.
EVENT_STAGES = ("view", "click", "signup", "purchase")
EVENT_SPANS = (
    Span("view→click", "view", "click", "hours"),
    Span("click→signup", "click", "signup", "hours"),
    Span("signup→purchase", "signup", "purchase", "minutes"),
)

CHECKS: dict[str, Callable[[CommerceModel, str], DataFrame]] = {}


def check(name: str):
    def register(build):
        CHECKS[name] = build
        return build

    return register


def daily_lifecycle(model: CommerceModel, directory: str) -> DataFrame:
    """First event of each type per user and day, from the event table."""
    events = model.spark.read.parquet(f"{directory}/events.parquet")
    at = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts"))).alias(kind)
    return events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(*map(at, EVENT_STAGES))


@check("event_funnel")
def event_funnel(m, directory):
    return funnel(daily_lifecycle(m, directory), [(s, s) for s in EVENT_STAGES], count_name="cnt")


@check("event_funnel_by_month")
def event_funnel_by_month(m, directory):
    days = daily_lifecycle(m, directory).withColumn("month", month_label("day"))
    return funnel(days, [(s, s) for s in EVENT_STAGES], by=["month"], base="rows", count_name="cnt")


@check("event_stage_durations")
def event_stage_durations(m, directory):
    out = durations.stage_durations(
        daily_lifecycle(m, directory), EVENT_SPANS, ("avg_v", "median_v", "p95_v"), digits=2, descend=True
    )
    return out.drop("_ord")


@check("quantiles_by_counting")
def quantiles_by_counting(m, directory):
    """The multi-level search, forced, over all item and payment amounts."""
    items = m.order_items.select(minor_units("price").alias("units"))
    out = exact_quantiles(items, {"price": (F.col("units"), MONEY_UNIT)}, [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0], descend=True)
    return out.select("dim", "prob", "n", "value")


@check("segments_by_counting")
def segments_by_counting(m, directory):
    """The full segmentation with the multi-level search forced."""
    scored = rfm.qcut_scores(rfm.rfm_base(m), descend=True)
    return rfm.segment_summary(rfm.segment_by_median(scored)).select("segment", "user_cnt", "total_gmv")


@check("score_comparison")
def score_comparison(m, directory):
    """Scores from the counting search against those from the built-in aggregate."""
    base = rfm.rfm_base(m)
    columns = tuple(rfm.DIMENSION_LABELS)
    return rfm.compare_scores(
        rfm.qcut_scores(base, descend=True), rfm.qcut_scores(base, descend=False), PERSON, columns
    )


@check("payment_describe")
def payment_describe(m, directory):
    units = m.order_payments.select(minor_units("payment_value").alias("units"))
    return describe_numeric(units, {"payment_value": (F.col("units"), MONEY_UNIT)}).drop("_ord")


@check("winsorized_payments")
def winsorized_payments(m, directory):
    capped = winsorize(m.order_payments, "payment_value", 2, upper=0.95)
    return capped.groupBy("payment_type").agg(
        F.count(F.lit(1)).alias("n"),
        rnd(F.max("payment_value"), 4).alias("top"),
        rnd(F.avg("payment_value"), 2).alias("mean"),
    )


@check("deduplicated_lookup")
def deduplicated_lookup(m, directory):
    """One item per order, the cheapest: the lookup joins without multiplying rows."""
    cheapest = dedup_by_key(m.order_items, ["order_id"], ["price", "product_id", "seller_id"])
    return m.order_payments.select("order_id").join(cheapest, "order_id")


@check("geolocation_join")
def geolocation_join(m, directory):
    prefixes = dedup_by_key(m.geolocation, ["zip_code_prefix"])
    return m.geolocation.join(prefixes, "zip_code_prefix").groupBy("zip_code_prefix").agg(
        F.count(F.lit(1)).alias("n")
    )


@check("person_revenue_share")
def person_revenue_share(m, directory):
    """Share of revenue per person: many rows, so the total is a separate aggregate."""
    amounts = m.order_items.groupBy("order_id").agg(F.sum(minor_units("price")).alias("units"))
    persons = m.purchases().join(amounts, "order_id").groupBy(PERSON).agg(F.sum("units").alias("units"))
    return share_of_total(persons, "units", digits=4, total="scalar").select(PERSON, "pct")


@check("category_performance_all")
def category_performance_all(m, directory):
    return category.category_performance(m, k=None)


@check("category_repurchase_all")
def category_repurchase_all(m, directory):
    return category.category_repurchase(m, min_buyers=0, k=None)


@check("second_to_third_order")
def second_to_third_order(m, directory):
    return repurchase.nth_gap(m.purchases(), PERSON, TS, a=2, b=3, out="days")


@check("retention_curve_zero_fill")
def retention_curve_zero_fill(m, directory):
    counts = cohort.cohort_counts(m.purchases(), PERSON, TS)
    exact = cohort.cohort_retention(counts, STAR_PARAMETERS.min_cohort, digits=None)
    return cohort.retention_curve(exact, zero_fill=True)


@check("average_basket")
def average_basket(m, directory):
    out = avg_of_group(m.order_items, "order_id", total=exact_sum("price"), items=F.count(F.lit(1)))
    return out.select(rnd("total", 2).alias("avg_total"), rnd("items", 2).alias("avg_items"))


@check("kpi_reconciliation")
def kpi_reconciliation(m, directory):
    """KPI figures against the same figures reached on other paths."""
    marts = build_marts(m, STAR_PARAMETERS)
    actual = reconcile.metrics_long(kpi.dashboard_kpis(m))
    by_path = {
        "total_orders": marts["status"]().agg(F.sum("order_cnt").alias("value")),
        "delivered_orders": marts["monthly"]().agg(F.sum("order_cnt").alias("value")),
        "unique_customers": repurchase.identity_audit(m.identities).select(F.col("distinct_unique_ids").alias("value")),
        "total_gmv": rfm.rfm_base(m).agg(F.sum("monetary_units").alias("u")).select((F.col("u") / MONEY_UNIT).alias("value")),
    }
    frames = [df.select(F.lit(k).alias("metric"), F.col("value").cast("double")) for k, df in by_path.items()]
    expected = frames[0]
    for frame in frames[1:]:
        expected = expected.unionByName(frame)
    return reconcile.reconcile(actual, expected, tol=0.005)


@check("approximate_users_by_event")
def approximate_users_by_event(m, directory):
    """Sketches per event type and day, rolled up to the type: exact count, and whether the estimate is within three standard errors."""
    events = m.spark.read.parquet(f"{directory}/events.parquet").withColumn("day", F.col("ts").cast("date"))
    rough = roll_up(distinct_sketches(events, ["event_type", "day"], "user_id"), ["event_type"])
    exact = events.select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count("user_id").alias("users"))
    off = F.abs(F.col("_estimate") - F.col("users"))
    return exact.join(rough.select("event_type", estimated().alias("_estimate")), "event_type").select(
        "event_type", "users", (off <= F.col("users") * F.lit(3 * standard_error())).alias("within_bound")
    )


@check("report_figures")
def report_figures(m, directory):
    return report_facts(m)


def _kpi_rows() -> str:
    """(metric, value) of the dashboard figures, in SQL."""
    values = {
        "total_orders": "(SELECT COUNT(*) FROM orders)",
        "delivered_orders": "(SELECT COUNT(*) FROM done)",
        "unique_customers": "(SELECT COUNT(*) FROM percust)",
        "total_gmv": R("(SELECT SUM(total) FROM baskets JOIN done ON k = order_id)", 2),
        "avg_order_value": R("(SELECT AVG(total) FROM baskets)", 2),
        "avg_review_score": R("(SELECT AVG(CAST(l_quantity AS INT) % 5 + 1) FROM lineitem)", 2),
        "sellers": "(SELECT COUNT(*) FROM supplier)",
        "products": "(SELECT COUNT(*) FROM part)",
    }
    return " UNION ALL ".join(f"SELECT '{k}' AS metric, CAST({v} AS DOUBLE) AS value" for k, v in values.items())


def _report_statement() -> str:
    none = "CAST(NULL AS VARCHAR)"

    def single(section: str, metric: str, value: str) -> str:
        return f"SELECT '{section}' AS section, '{metric}' AS metric, {none} AS label, CAST({value} AS DOUBLE) AS value"

    def several(section: str, metric: str, label: str, value: str, rest: str) -> str:
        return (
            f"SELECT '{section}', '{metric}', CAST(label AS VARCHAR), CAST(value AS DOUBLE) FROM "
            f"(SELECT {label} AS label, {value} AS value {rest})"
        )

    top20 = "(SELECT * FROM cat ORDER BY orders DESC, category LIMIT 20)"
    days = lambda a, b, per: R(f"(SELECT AVG((epoch_us({b}) - epoch_us({a})) / {per}) FROM ord)", 1)
    month = "strftime(o_orderdate, '%Y-%m')"
    parts = [
        single("platform", "delivered_pct", PCT("(SELECT COUNT(*) FROM done)", "(SELECT COUNT(*) FROM orders)")),
        f"SELECT 'platform', metric, {none}, value FROM ({_kpi_rows()})",
        single("platform", "categories", "(SELECT COUNT(DISTINCT category) FROM prod)"),
        several(
            "platform", "month_range", f"MIN({month}) || ' ~ ' || MAX({month})", f"COUNT(DISTINCT {month})", "FROM orders"
        ),
        several("category", "top_by_orders", "category", "orders", f"FROM {top20} ORDER BY orders DESC, category LIMIT 3"),
        several(
            "category", "top_by_revenue", "category", R("revenue", 2),
            f"FROM {top20} ORDER BY revenue DESC, category LIMIT 3",
        ),
        single("behaviour", "total_users", "(SELECT COUNT(*) FROM perdone)"),
        single("behaviour", "repurchase_users", "(SELECT COUNT(*) FROM perdone WHERE n > 1)"),
        single("behaviour", "three_plus_users", "(SELECT COUNT(*) FROM perdone WHERE n > 2)"),
        single(
            "behaviour", "repurchase_rate",
            PCT("(SELECT COUNT(*) FROM perdone WHERE n > 1)", "(SELECT COUNT(*) FROM perdone)"),
        ),
        single("behaviour", "avg_orders_per_user", R("(SELECT AVG(n) FROM perdone)", 2)),
        single("behaviour", "max_orders", "(SELECT MAX(n) FROM perdone)"),
        single("behaviour", "repeat_users", "(SELECT COUNT(*) FROM percust WHERE ids > 1)"),
        single("behaviour", "max_ids", "(SELECT MAX(ids) FROM percust WHERE ids > 1)"),
        single("behaviour", "avg_ids", R("(SELECT AVG(ids) FROM percust WHERE ids > 1)", 2)),
        several("behaviour", "top_state", "state", "n", "FROM states ORDER BY n DESC, state LIMIT 1"),
        single("trade", "avg_order_value", R("(SELECT AVG(total) FROM baskets)", 2)),
        single("trade", "avg_items_per_order", R("(SELECT AVG(items) FROM baskets)", 2)),
        several("trade", "median", "'median_order_value'", R("quantile_cont(total, 0.5)", 2), "FROM baskets"),
        several(
            "trade", "payment_pct", "o_orderpriority", PCT("COUNT(*)", "(SELECT COUNT(*) FROM orders)"),
            "FROM orders GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 2",
        ),
        several("operations", "stage_avg", "'purchase→approve'", days("purchased", "approved", "3600e6"), ""),
        several("operations", "stage_avg", "'approve→carrier'", days("approved", "carrier", "86400e6"), ""),
        several("operations", "stage_avg", "'carrier→customer'", days("carrier", "delivered", "86400e6"), ""),
        several(
            "operations", "review_pct", "CAST(l_quantity AS INT) % 5 + 1",
            PCT("COUNT(*)", "(SELECT COUNT(*) FROM lineitem)"), "FROM lineitem GROUP BY 1 HAVING label IN (1, 5)",
        ),
    ]
    body = " UNION ALL ".join(parts)
    return sql(body, "done", "percust", "perdone", "baskets", "cat", "states", "ord")


def check_statements() -> dict[str, str]:
    probs = (0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)

    def funnel_rows(source: str, base: str, keep: str = "") -> str:
        counts = ", ".join(f"COUNT({s}) AS {s}" for s in EVENT_STAGES)
        rows = []
        for i, s in enumerate(EVENT_STAGES):
            step = PCT(s, EVENT_STAGES[i - 1]) if i else "CAST(NULL AS DOUBLE)"
            rows.append(
                f"SELECT {keep}'{s}' AS stage, {s} AS cnt, {PCT(s, base)} AS overall_rate, {step} AS step_rate FROM c"
            )
        group = " GROUP BY 1" if keep else ""
        return f"WITH c AS (SELECT {source}COUNT(*) AS n, {counts} FROM daily{group}) " + " UNION ALL ".join(rows)

    def nested(body: str, *needs: str) -> str:
        return sql(f"SELECT * FROM ({body})", *needs)

    per = {"hours": "3600e6", "minutes": "60e6"}
    spans = []
    for s in EVENT_SPANS:
        x = f"((epoch_us({s.end}) - epoch_us({s.start})) / {per[s.unit]})"
        spans.append(
            f"SELECT '{s.label}' AS stage, {R(f'AVG({x})', 2)} AS avg_v, {R(f'quantile_cont({x}, 0.5)', 2)} AS median_v, "
            f"{R(f'quantile_cont({x}, 0.95)', 2)} AS p95_v, '{s.unit}' AS unit FROM daily"
        )
    describe = {
        "count": "CAST(COUNT(x) AS DOUBLE)", "mean": R("AVG(x)", 4), "std": R("stddev_samp(x)", 4), "min": R("MIN(x)", 4),
        "25%": R("quantile_cont(x, 0.25)", 4), "50%": R("quantile_cont(x, 0.5)", 4), "75%": R("quantile_cont(x, 0.75)", 4),
        "max": R("MAX(x)", 4),
    }
    return {
        "event_funnel": nested(funnel_rows("", EVENT_STAGES[0]), "daily"),
        "event_funnel_by_month": nested(funnel_rows("strftime(day, '%Y-%m') AS month, ", "n", "month, "), "daily"),
        "event_stage_durations": sql(" UNION ALL ".join(spans), "daily"),
        "quantiles_by_counting": " UNION ALL ".join(
            f"SELECT 'price' AS dim, CAST({p} AS DOUBLE) AS prob, COUNT(*) AS n, "
            f"{R(f'quantile_cont(l_extendedprice, {p})', 6)} AS value FROM lineitem" for p in probs
        ),
        "segments_by_counting": sql(
            "SELECT segment, user_cnt, total_gmv FROM (SELECT "
            + "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rfm.SEGMENT_LABELS.items()) + " END AS segment, "
            + f"users AS user_cnt, {R('gmv', 2)} AS total_gmv FROM summary)",
            "summary",
        ),
        "score_comparison": sql(
            "SELECT COUNT(*) AS compared, 0 AS only_a, 0 AS only_b, 0 AS R_score_mismatches, 0 AS F_score_mismatches, "
            "0 AS M_score_mismatches FROM rfm",
            "rfm",
        ),
        "payment_describe": " UNION ALL ".join(
            f"SELECT '{k}' AS stat, {v} AS payment_value FROM (SELECT o_totalprice AS x FROM orders)"
            for k, v in describe.items()
        ),
        "winsorized_payments": f"WITH c AS (SELECT quantile_cont(o_totalprice, 0.95) AS cap FROM orders) "
        f"SELECT o_orderpriority AS payment_type, COUNT(*) AS n, {R('MAX(LEAST(o_totalprice, cap))', 4)} AS top, "
        f"{R('AVG(LEAST(o_totalprice, cap))', 2)} AS mean FROM orders, c GROUP BY 1",
        "deduplicated_lookup": "SELECT order_id, product_id, seller_id, price FROM (SELECT l_orderkey AS order_id, "
        "l_partkey AS product_id, l_suppkey AS seller_id, l_extendedprice AS price, ROW_NUMBER() OVER (PARTITION BY "
        "l_orderkey ORDER BY l_extendedprice, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1 "
        "AND order_id IN (SELECT o_orderkey FROM orders)",
        "geolocation_join": "SELECT c_nationkey AS zip_code_prefix, COUNT(*) AS n FROM customer GROUP BY 1",
        "person_revenue_share": sql(
            f"SELECT person AS customer_unique_id, {PCT('u', '(SUM(u) OVER ())', 4)} AS pct FROM (SELECT person, "
            "SUM(l_extendedprice) AS u FROM done JOIN lineitem ON l_orderkey = order_id GROUP BY person)",
            "done",
        ),
        "category_performance_all": sql(
            f"SELECT category, orders AS order_cnt, {R('revenue', 2)} AS total_revenue, {R('price', 2)} AS avg_price, "
            "products AS product_cnt FROM cat",
            "cat",
        ),
        "category_repurchase_all": sql(
            "SELECT category, COUNT(*) AS total_buyers, COUNT(*) FILTER (WHERE n > 1) AS repurchase_buyers, "
            f"{PCT('COUNT(*) FILTER (WHERE n > 1)', 'COUNT(*)')} AS repurchase_rate FROM "
            "(SELECT person, category, COUNT(DISTINCT order_id) AS n FROM done JOIN lineitem ON l_orderkey = order_id "
            "JOIN prod ON product_id = l_partkey GROUP BY ALL) GROUP BY category",
            "done", "prod",
        ),
        "second_to_third_order": sql(
            "SELECT person AS customer_unique_id, date_diff('day', days[2], days[3]) AS days FROM "
            "(SELECT person, list_sort(list(day)) AS days FROM done GROUP BY person HAVING COUNT(*) >= 3)",
            "done",
        ),
        "retention_curve_zero_fill": sql(
            f"SELECT off AS offset_month, {R('SUM(pct) / (SELECT COUNT(DISTINCT born) FROM ret)', 2)} "
            "AS avg_retention_pct FROM ret GROUP BY off",
            "ret",
        ),
        "kpi_reconciliation": sql(
            "SELECT metric, value AS actual, CASE WHEN crossed THEN value END AS expected, "
            "CASE WHEN crossed THEN CAST(0 AS DOUBLE) END AS diff, CASE WHEN crossed THEN 'ok' ELSE 'extra' END AS status "
            "FROM (SELECT *, metric IN ('total_orders', 'delivered_orders', 'unique_customers', 'total_gmv') AS crossed "
            f"FROM ({_kpi_rows()}))",
            "done", "percust", "baskets",
        ),
        "approximate_users_by_event": "SELECT event_type, COUNT(DISTINCT user_id) AS users, TRUE AS within_bound "
        "FROM events GROUP BY event_type",
        "report_figures": _report_statement(),
        "average_basket": sql(
            f"SELECT {R('AVG(total)', 2)} AS avg_total, {R('AVG(items)', 2)} AS avg_items FROM baskets", "baskets"
        ),
    }
