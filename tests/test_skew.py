"""A person, a product and an order that each hold a large part of the rows.

Results are compared with plain Python over the same rows.
"""

import datetime as dt
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from orderlens import CommerceModel
from orderlens.functions.frames import salted_join
from orderlens.operators import category, cohort, kpi, repurchase, rfm
from orderlens.operators.funnel import funnel_by

ORDERS, ITEMS = 3000, 12000
HOT_SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
}


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    start = dt.datetime(2020, 1, 1)
    orders, items = [], []
    for i in range(ORDERS):
        person = 7 if i % 3 == 0 else rng.randrange(100, 900)
        bought = start + dt.timedelta(days=rng.randrange(900), seconds=rng.randrange(86400))
        sent = bought + dt.timedelta(hours=rng.randrange(1, 90)) if rng.random() < 0.8 else None
        status = "delivered" if rng.random() < 0.7 else "shipped"
        orders.append((i, i, person, status, bought, sent))
    for _ in range(ITEMS):
        order = 5 if rng.random() < 0.33 else rng.randrange(ORDERS)
        product = 11 if rng.random() < 0.33 else rng.randrange(400)
        items.append((order, product, rng.randrange(100, 99999) / 100))
    return orders, items


@pytest.fixture(scope="module")
def model(spark, data):
    orders, items = data
    table = lambda names, rows: spark.createDataFrame(
        pa.table({n: list(c) for n, c in zip(names, zip(*rows))})
    )
    o = table(["order_id", "customer_id", "person", "order_status", "order_purchase_timestamp", "sent"], orders)
    roles = {
        "orders": o.selectExpr(
            "order_id", "customer_id", "order_status", "order_purchase_timestamp",
            "sent AS order_approved_at", "sent AS order_delivered_carrier_date", "sent AS order_delivered_customer_date",
        ),
        "customers": o.selectExpr(
            "customer_id", "person AS customer_unique_id", "concat('S', person % 5) AS customer_state"
        ),
        # Many input partitions, so that a hot shuffle partition can be split.
        "order_items": table(["order_id", "product_id", "price"], items)
        .selectExpr("order_id", "product_id", "product_id AS seller_id", "price")
        .repartition(12),
        "order_payments": o.selectExpr("order_id", "'card' AS payment_type", "1.0D AS payment_value"),
        "order_reviews": o.selectExpr("order_id", "5 AS review_score"),
        "products": spark.range(400).selectExpr(
            "id AS product_id", "concat('cat', id % 9) AS product_category_name"
        ),
        "sellers": spark.range(3).selectExpr("id AS seller_id"),
        "geolocation": spark.range(3).selectExpr("id AS zip_code_prefix"),
        "category_translation": spark.range(1).selectExpr(
            "'cat0' AS product_category_name", "'zero' AS product_category_name_english"
        ),
    }
    return CommerceModel.from_roles(spark, roles)


@pytest.fixture
def hot(spark):
    before = {k: spark.conf.get(k, None) for k in HOT_SETTINGS}
    for key, value in HOT_SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def name_of(product):
    return "zero" if product % 9 == 0 else f"cat{product % 9}"


def test_hot_product(spark, model, data, hot):
    orders, items = data
    out = category.category_performance(model, k=None)
    got = {r["category"]: (r["order_cnt"], r["total_revenue"], r["product_cnt"]) for r in out.collect()}
    seen, cents, products = defaultdict(set), Counter(), defaultdict(set)
    for order, product, price in items:
        c = name_of(product)
        seen[c].add(order)
        products[c].add(product)
        cents[c] += round(price * 100)
    assert got == {c: (len(seen[c]), cents[c] / 100, len(products[c])) for c in seen}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan[plan.index("SortMergeJoin [product_id") :].split("\n")[0]


def test_hot_product_without_lowered_thresholds(spark, model, data):
    orders, items = data
    products = category.product_categories(model)
    pairs = model.order_items.select("order_id", "product_id").distinct()
    met = salted_join(pairs, products.hint("merge"), "product_id", "order_id", salts=16).select("order_id", "product_id", "category")
    assert sorted(met.collect()) == sorted({(o, p, name_of(p)) for o, p, _ in items})
    shares = Counter((p, o % 16) for o, p in {(o, p) for o, p, _ in items} if p == 11)
    assert max(shares.values()) < 0.1 * len(items)


def test_repeated_translation_leaves_the_number_of_products(spark, model):
    twice = model.category_translation.unionByName(model.category_translation)
    doubled = CommerceModel.from_roles(spark, {**model.roles, "category_translation": twice})
    counts = [{r.category: r.product_cnt for r in category.category_performance(m, k=None).collect()} for m in (model, doubled)]
    assert counts[0] == counts[1]


def test_cohorts_of_persons_over_many_years(spark):
    rng, start = random.Random(5), dt.datetime(1969, 11, 30)
    rows = [(rng.randrange(40) or None, start + dt.timedelta(days=rng.randrange(25_000))) for _ in range(900)] + [(3, None), (99, None)]
    frame = spark.createDataFrame(rows, "person int, ts timestamp_ntz")
    months = defaultdict(set)
    for person, ts in rows:
        if ts:
            months[person].add(ts.year * 12 + ts.month - 1)
    want = Counter((min(m), k - min(m)) for m in months.values() for k in m)
    got = {(r.cohort_month.year * 12 + r.cohort_month.month - 1, r.offset_month): r.user_cnt for r in cohort.cohort_counts(frame, "person", "ts").collect()}
    assert got == want
    far = spark.createDataFrame([(1, dt.datetime(1900, 1, 1)), (1, dt.datetime(2020, 1, 1))], "person int, ts timestamp_ntz")
    with pytest.raises(Exception, match="months apart"):
        cohort.cohort_counts(far, "person", "ts").collect()


def test_category_repurchase_of_hot_person(spark, model, data, hot):
    orders, items = data
    person = {o[0]: o[2] for o in orders if o[3] == "delivered"}
    bought = defaultdict(set)
    for order, product, _ in items:
        if order in person:
            bought[person[order], name_of(product)].add(order)
    want = defaultdict(lambda: [0, 0])
    for (_, c), ids in bought.items():
        want[c][0] += 1
        want[c][1] += len(ids) >= 2
    out = category.category_repurchase(model, min_buyers=0, k=None).collect()
    assert {r["category"]: [r["total_buyers"], r["repurchase_buyers"]] for r in out} == want


def test_rfm_of_hot_person_and_hot_order(spark, model, data, hot):
    orders, items = data
    cents = Counter()
    for order, _, price in items:
        cents[order] += round(price * 100)
    today = max(o[4] for o in orders).date() + dt.timedelta(days=1)
    want = {}
    for order, _, person, status, bought, _ in orders:
        if status == "delivered" and order in cents:
            last, n, total = want.get(person, (dt.date.min, 0, 0))
            want[person] = (max(last, bought.date()), n + 1, total + cents[order])
    got = {r["customer_unique_id"]: r for r in rfm.rfm_base(model).collect()}
    assert {k: ((today - v[0]).days, v[1], v[2] / 100) for k, v in want.items()} == {
        k: (r["recency"], r["frequency"], r["monetary"]) for k, r in got.items()
    }
    segments = rfm.rfm_segments(model).collect()
    assert len(segments) == len(want) and all(r["segment_code"] for r in segments)


def test_cohorts_and_gaps_of_hot_person(spark, model, data, hot):
    orders, _ = data
    days = defaultdict(list)
    for _, _, person, status, bought, _ in orders:
        if status == "delivered":
            days[person].append(bought.date())
    want = Counter()
    for dates in days.values():
        months = {(d.year, d.month) for d in dates}
        first = min(months)
        for y, m in months:
            want[dt.date(*first, 1), (y - first[0]) * 12 + m - first[1]] += 1
    counts = cohort.cohort_counts(model.purchases(), "customer_unique_id", "order_purchase_timestamp")
    assert {(r[0], r[1]): r[2] for r in counts.collect()} == want
    gaps = repurchase.nth_gap(model.purchases(), "customer_unique_id", "order_purchase_timestamp")
    assert {r[0]: r[1] for r in gaps.collect()} == {
        p: (sorted(d)[1] - sorted(d)[0]).days for p, d in days.items() if len(d) > 1
    }
    rate = repurchase.repurchase_rate(model.purchases()).first()
    assert rate["max_orders"] == max(map(len, days.values())) and rate["total_users"] == len(days)


def test_funnel_and_kpis_of_hot_person(spark, model, data, hot):
    orders, items = data
    reached, total = Counter(), Counter()
    for _, _, person, _, _, sent in orders:
        total[f"S{person % 5}"] += 1
        reached[f"S{person % 5}"] += sent is not None
    ratios = {"rate": ("order_approved_at", "order_purchase_timestamp")}
    out = funnel_by(model.person_orders, "customer_state", ratios, min_rows=1, k=None, lookup=model.states)
    assert {r[0]: (r[1], r[2]) for r in out.collect()} == {
        s: (n, round(reached[s] * 100 / n + 1e-9, 2)) for s, n in total.items()
    }
    row = kpi.dashboard_kpis(model).first()
    delivered = {o[0] for o in orders if o[3] == "delivered"}
    gmv = sum(round(p * 100) for o, _, p in items if o in delivered)
    assert row["total_gmv"] == gmv / 100 and row["total_orders"] == ORDERS
