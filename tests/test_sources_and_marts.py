"""CSV input, model views, marts, report figures and the catalog."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orderlens import model_from_csv, model_from_parquet, write_roles
from orderlens.functions.numeric import exact_sum
from orderlens.operators import category, kpi, repurchase, rfm
from orderlens.plans.catalog import CATALOG, run_catalog
from orderlens.plans.marts import report_facts, write_marts, write_report_facts
from orderlens.plans.parameters import STAR_PARAMETERS, Parameters
from orderlens.sources.csv import read_role, require_inputs

FILES = {
    # Columns out of role order and extra columns, as real exports have them.
    "x_orders_dataset.csv": """order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date
o1,c1,delivered,2018-01-01 10:00:00,2018-01-01 12:00:00,2018-01-03 12:00:00,2018-01-08 12:00:00,2018-01-20 00:00:00
o2,c2,delivered,2018-01-05 10:00:00,,2018-01-06 10:00:00,2018-01-07 10:00:00,2018-01-20 00:00:00
o3,c3,canceled,2018-02-01 00:00:00,,,,2018-02-20 00:00:00
o4,c4,delivered,2018-02-02 00:00:00,2018-02-02 01:00:00,2018-02-03 00:00:00,2018-02-04 00:00:00,2018-02-20 00:00:00
""",
    "x_customers_dataset.csv": """customer_unique_id,customer_id,customer_zip_code_prefix,customer_state
u1,c1,01310,SP
u1,c2,01310,SP
u2,c3,20000,RJ
u3,c4,20000,RJ
""",
    "x_order_items_dataset.csv": """order_id,order_item_id,product_id,seller_id,price,freight_value
o1,1,p1,s1,10.10,1.0
o1,2,p2,s1,20.20,1.0
o2,1,p1,s1,10.10,1.0
o3,1,p3,s2,5.00,1.0
""",
    "x_order_payments_dataset.csv": """order_id,payment_sequential,payment_type,payment_value
o1,1,credit_card,31.30
o2,1,voucher,10.10
""",
    "x_order_reviews_dataset.csv": '''review_id,order_id,review_score,review_comment_message
r1,o1,5,"good, ""very"" good
second line"
r2,o2,1,
''',
    "x_products_dataset.csv": """product_id,product_category_name
p1,brinquedos
p2,sem_traducao
p3,
""",
    "x_sellers_dataset.csv": "seller_id,seller_state\ns1,SP\ns2,RJ\n",
    "x_geolocation_dataset.csv": "geolocation_zip_code_prefix,geolocation_lat\n01310,1.0\n01310,1.1\n20000,2.0\n",
    "product_category_name_translation.csv": "product_category_name,product_category_name_english\nbrinquedos,toys\n",
}


@pytest.fixture(scope="module")
def csv_dir(tmp_path_factory):
    directory = tmp_path_factory.mktemp("csv")
    for name, text in FILES.items():
        (directory / name).write_text(text)
    return str(directory)


@pytest.fixture(scope="module")
def shop(spark, csv_dir):
    return model_from_csv(spark, csv_dir)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_missing_roles_are_named(spark, tmp_path):
    (tmp_path / "a_orders_dataset.csv").write_text("order_id\n")
    with pytest.raises(FileNotFoundError, match="customers .*products"):
        require_inputs(spark, str(tmp_path))
    with pytest.raises(ValueError, match="customer_id"):
        read_role(spark, str(tmp_path), "orders")


def test_csv_columns_are_matched_by_name_and_typed(shop):
    orders = shop.orders
    assert dict(orders.dtypes)["order_purchase_timestamp"] == "timestamp_ntz"
    second = orders.filter("order_id = 'o2'").first()
    assert second["order_approved_at"] is None
    assert second["order_purchase_timestamp"] == dt.datetime(2018, 1, 5, 10)
    assert rows(shop.customers, "customer_id")[0] == ("c1", "u1", "SP")
    assert rows(shop.geolocation, "zip_code_prefix")[0] == ("01310",)


def test_multi_line_text_stays_one_review(shop):
    assert rows(shop.order_reviews, "order_id") == [("o1", 5), ("o2", 1)]


def test_null_category_kept_or_dropped(shop):
    kept = category.category_performance(shop, k=None)
    assert {r["category"]: r["order_cnt"] for r in kept.collect()} == {"toys": 2, "sem_traducao": 1, None: 1}
    assert {r["product_cnt"] for r in kept.collect()} == {1}
    dropped = category.category_performance(shop, k=None, drop_null=True)
    assert None not in [r["category"] for r in dropped.collect()]


def test_order_without_items_is_in_funnel_but_not_in_rfm(shop):
    persons = {r["customer_unique_id"]: r for r in rfm.rfm_base(shop).collect()}
    assert set(persons) == {"u1"}
    assert persons["u1"]["frequency"] == 2 and persons["u1"]["monetary"] == 40.4
    # 2018-02-02 is the last purchase, the reference day is the one after.
    assert persons["u1"]["recency"] == 29
    assert rfm.rfm_base(shop, as_of=dt.date(2018, 1, 6)).first()["recency"] == 1
    assert CATALOG["q02_01_order_funnel"].build(shop, Parameters()).first()["order_cnt"] == 4


def test_all_orders_against_delivered_revenue(shop):
    row = kpi.dashboard_kpis(shop).first()
    assert (row["total_orders"], row["delivered_orders"], row["unique_customers"]) == (4, 3, 3)
    assert row["total_gmv"] == 40.4 and row["avg_order_value"] == 15.13 and row["avg_review_score"] == 3.0


def test_identity_views_of_csv_model(shop):
    assert rows(repurchase.identity_audit(shop.identities)) == [(4, 3, 4, 1)]
    assert rows(shop.person_states, "customer_unique_id") == [("u1", "SP"), ("u2", "RJ"), ("u3", "RJ")]


def test_views_allow_plain_sql(spark, shop):
    shop.create_views("t_")
    assert spark.sql("SELECT count(*) FROM t_orders WHERE order_status = 'delivered'").first()[0] == 3


def test_columnar_copy_gives_the_same_results(spark, shop, tmp_path):
    write_roles(shop, str(tmp_path))
    copy = model_from_parquet(spark, str(tmp_path))
    assert copy.orders.schema == shop.orders.schema
    assert rows(kpi.dashboard_kpis(copy)) == rows(kpi.dashboard_kpis(shop))
    assert rows(rfm.rfm_base(copy)) == rows(rfm.rfm_base(shop))
    plan = copy.purchases()._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(order_status,delivered)" in plan


def test_every_named_query_runs_on_csv(shop):
    params = Parameters(min_cohort=1, min_rows=1, min_buyers=1)
    for query_id, _, df in run_catalog(shop, params=params):
        assert df.columns, query_id
        df.collect()


def test_catalog_stages_are_lazy_and_ordered(star):
    ids = [query_id for query_id, title, df in run_catalog(star, "retention", STAR_PARAMETERS)]
    assert ids[0] == "q04_01_repurchase_rate" and all(CATALOG[i].stage == "retention" for i in ids)


def test_marts_are_written_and_agree_with_the_queries(spark, star_small, tmp_path):
    params = Parameters(min_cohort=1, min_rows=1, min_buyers=1, focus_category="brand_01", trend_start="2000-01")
    written = write_marts(star_small, str(tmp_path), params)
    for name, df in written.items():
        assert spark.read.parquet(str(tmp_path / name)).count() == df.count() > 0
    assert "_ord" in written["funnel"].columns and "segment_code" in written["rfm"].columns
    direct = CATALOG["d_insights"].build(star_small, params).first().asDict()
    assert written["insights"].first().asDict() == direct


def test_insights_of_an_absent_category_are_null(star_small):
    params = Parameters(min_cohort=1, min_rows=1, min_buyers=1, focus_category="none", trend_start="9999-01")
    row = CATALOG["d_insights"].build(star_small, params).first()
    assert row["focus_ticket_ratio"] is None and row["avg_monthly_orders"] is None
    assert row["peak_month"] is not None


def test_report_figures_are_exported(spark, star_small, tmp_path):
    out = str(tmp_path / "facts")
    write_report_facts(star_small, out)
    assert spark.read.json(out).count() == report_facts(star_small).count()


def test_invariants(star):
    q = lambda name: CATALOG[name].build(star, STAR_PARAMETERS)
    for name in ("q01_02_status_share", "q01_07_state_share", "q01_08_payment_share", "q01_09_review_share"):
        assert sum(r["pct"] for r in q(name).collect()) == pytest.approx(100, abs=0.06)
    assert {r["retention_pct"] for r in q("q04_03_cohort_retention").filter("offset_month = 0").collect()} == {100.0}
    total = star.orders.count()
    assert all(r["order_cnt"] <= total for r in q("q02_01_order_funnel").collect())
    assert sum(r["user_cnt"] for r in q("q03_04_segment_summary").collect()) == rfm.rfm_base(star).count()
    assert q("n4_cumulative_windows").collect()[-1]["cum_pct"] == pytest.approx(100, abs=0.06)


def test_csv_columns_match_by_name_and_bad_values_fail(spark, tmp_path):
    (tmp_path / "a_order_items_dataset.csv").write_text("order_id,product_id,seller_id,price\no1,p1,s1,0.004\n")
    (tmp_path / "b_order_items_dataset.csv").write_text("price,seller_id,product_id,order_id\n2.5,s2,p2,o2\n")
    rows = read_role(spark, str(tmp_path), "order_items").collect()
    assert {tuple(r) for r in rows} == {("o1", "p1", "s1", 0.004), ("o2", "p2", "s2", 2.5)}
    (tmp_path / "c_order_items_dataset.csv").write_text("order_id,product_id,seller_id,price\no3,p3,s3,abc\n")
    with pytest.raises(Exception):
        read_role(spark, str(tmp_path), "order_items").collect()


def test_amounts_with_more_than_two_decimals_add_up(spark):
    df = spark.range(1000).select(F.lit(0.004).alias("price"))
    assert df.agg(exact_sum("price").alias("s")).first()["s"] == 4.0
