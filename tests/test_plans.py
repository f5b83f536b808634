"""Properties of the physical plans that matter at scale."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from orderlens.functions.numeric import minor_units
from orderlens.operators import category, repurchase, rfm
from orderlens.operators.kpi import order_sums, person_metrics
from orderlens.operators.quantiles import exact_quantiles, quantile_row
from orderlens.operators.funnel import funnel
from orderlens.operators.shares import distribution
from orderlens.plans.marts import build_marts
from orderlens.plans.parameters import ORDER_STAGES, Parameters
from orderlens.sources.model import CommerceModel
from orderlens.sources.schemas import ROLE_COLUMNS
from tests.conftest import SF

QUERIES = contract.queries()


@pytest.fixture
def hot(spark):
    """No table is small enough to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_unused_lifecycle_join_is_dropped(star):
    plan = plan_of(distribution(star.orders, "order_status", "n"))
    assert "Join" not in plan
    assert "ReadSchema: struct<o_orderstatus:string>" in plan


def test_status_filter_reaches_the_scan(star):
    plan = plan_of(star.purchases().groupBy("customer_unique_id").count())
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string>" in plan


def test_funnel_scans_each_table_once(star):
    assert plan_of(funnel(star.orders, ORDER_STAGES)).count("FileScan") == 2


def test_gap_limits_rows_before_the_shuffle(star):
    plan = plan_of(repurchase.nth_gap(star.purchases(), "customer_unique_id", "order_purchase_timestamp"))
    shuffle, partial = plan.index("Exchange"), plan.rindex("WindowGroupLimit")
    assert "Partial" in plan[partial:].splitlines()[0] and partial > shuffle


def test_segment_chain_computes_the_base_once(spark):
    df = QUERIES["q03_04_segment_summary"](spark, SF)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")
    assert "ReusedExchange" in "".join(final)


def test_top_k_takes_ordered(spark):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["q01_04_category_top20"](spark, SF))


def test_no_distinct_expand_in_category_performance(spark):
    assert "Expand" not in plan_of(QUERIES["q01_04_category_top20"](spark, SF))
    assert "Expand" not in plan_of(QUERIES["q01_05_identity_audit"](spark, SF))


def table_scans(df, table: str) -> int:
    """How often the optimized plan reads a table, subqueries and shared parts counted each."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(table)


def test_heatmap_plans_the_segments_once(star):
    summary = rfm.segment_summary(rfm.rfm_segments(star))
    assert table_scans(rfm.segment_heatmap(summary), "Relation [") == table_scans(summary, "Relation [")


def test_marts_on_shared_item_sums_do_not_scan_items(star, spark, tmp_path):
    """Figures that need items take them from the two sums, with the same values."""
    shared = {}
    frames = {"sums": order_sums(star), "pairs": category.order_categories(star, category.product_categories(star), money=True)}
    for name, frame in frames.items():
        frame.write.parquet(str(tmp_path / name))
        shared[name] = spark.read.parquet(str(tmp_path / name))
    given, built = build_marts(star, Parameters(min_buyers=1), **shared), build_marts(star, Parameters(min_buyers=1))
    for name in ("categories", "cat_repurchase", "rfm"):
        df = given[name]()
        assert not any("lineitem" in file for file in df.inputFiles())
        assert sorted(map(str, df.collect())) == sorted(map(str, built[name]().collect()))
    assert given["kpis"]().first() == built["kpis"]().first()


def scans_run(df) -> int:
    """File scans of the plan as it ran, those of reused exchanges left out."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().executedPlan().toString().count("FileScan")


def test_describe_takes_moments_from_the_value_counts(star):
    """Quartiles alone need as many scans as the whole description."""
    base = rfm.rfm_base(star)
    quartiles = scans_run(quantile_row(base, rfm.rfm_measures(), {"min": 0.0, "q50": 0.5}))
    for described in (rfm.rfm_describe(base), rfm.describe_measures(base)):
        assert scans_run(described) == quartiles


def test_states_of_role_tables_read_customers_once(spark):
    def role(name: str, n: int):
        return spark.range(n).select(*[F.col("id").cast("string").alias(c) for c in ROLE_COLUMNS[name]])

    roles = {name: role(name, 5 if name == "customers" else 3) for name in ROLE_COLUMNS}
    model = CommerceModel.from_roles(spark, roles)
    out = build_marts(model, Parameters(min_rows=1))["funnel_by_state"]()
    assert table_scans(out, "Range (0, 5") == 1
    assert {r.customer_state: r.total_orders for r in out.collect()} == {"0": 1, "1": 1, "2": 1}


def test_sketches_are_merged_in_the_map_tasks(star):
    plan = plan_of(person_metrics(star, lg_k=12))
    assert "partial_hll_sketch_agg" in plan and "Exchange hashpartitioning(customer_unique_id" not in plan


def test_cohorts_shuffle_persons_once(spark):
    plan = plan_of(QUERIES["q04_02_cohort_counts"](spark, SF))
    assert plan.count("Exchange hashpartitioning(customer_unique_id") == 1 and "Window" not in plan
    partial = plan[plan.index("Exchange hashpartitioning(customer_unique_id") :]
    assert "partial_bit_or" in partial


def test_products_meet_sums_of_pairs_by_a_salted_join(star, hot):
    for frame in (category.category_performance(star, k=None), category.category_repurchase(star, k=None)):
        plan = plan_of(frame)
        assert "Join [product_id" in plan and "_salt" in plan[plan.index("Join [product_id") :].split("\n")[0]
        assert "HashAggregate(keys=[order_id" in plan[plan.index("_salt") :]


def test_the_first_level_of_the_quantile_search_is_short(star):
    units = star.order_items.select(minor_units("price").alias("u"))
    out = exact_quantiles(units, {"price": (F.col("u"), 1.0)}, [0.1, 0.5])
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(d" in text and "shiftright(cell" in text
    cells = [line for line in text.splitlines() if "windowspecdefinition" in line and "cell" in line]
    assert cells and all("run#" in line or "sub#" in line for line in cells)


def test_hot_key_is_aggregated_before_the_state_join(spark):
    plan = plan_of(QUERIES["q02_04_funnel_by_state"](spark, SF))
    join = plan.index("Join")
    assert "HashAggregate(keys=[customer_unique_id" in plan[join:]
