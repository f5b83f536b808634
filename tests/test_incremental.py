"""Facts by month: a refresh rewrites changed months only and equals a build from scratch."""

from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from orderlens.operators import category, kpi
from orderlens.plans.incremental import NO_MONTH, changed_months, month_fingerprints, read_facts, refresh_facts, refresh_marts
from orderlens.plans.marts import write_marts
from orderlens.plans.parameters import Parameters

TIME = "order_purchase_timestamp"


def files(folder: Path, name: str) -> dict[str, set[str]]:
    return {p.name.split("=")[1]: {f.name for f in p.glob("*.parquet")} for p in (folder / name).glob("order_month=*")}


def cut(model, condition):
    """The model with some orders only, as an earlier export would have held them."""
    orders = model.person_orders.where(condition)
    ids = orders.select("order_id")
    roles = {**model.roles, "orders": orders, "order_items": model.order_items.join(ids, "order_id", "left_semi")}
    return replace(model, roles=roles, person_orders=orders, row_sources={})


def told(df):
    return sorted(map(str, (r.asDict() for r in df.select(*sorted(df.columns)).collect())))


@pytest.fixture(scope="module")
def late(star_small):
    return cut(star_small, F.col(TIME) >= "1997-10-01")


def test_only_changed_months_are_rewritten(late, tmp_path):
    last = late.person_orders.agg(F.date_format(F.max(TIME), "yyyy-MM")).first()[0]
    old = cut(late, F.date_format(TIME, "yyyy-MM") < last)
    out = str(tmp_path)
    first = refresh_facts(old, out)
    before = files(tmp_path, "order_facts")
    assert set(before) == set(first) and last not in before
    assert refresh_facts(old, out) == []

    assert refresh_facts(late, out) == [last]
    after = files(tmp_path, "order_facts")
    assert last in after and {m: f for m, f in after.items() if m != last} == before
    sums = read_facts(late, out, "order_facts").where("_items IS NOT NULL").select("order_id", "_units", "_items")
    assert told(sums) == told(kpi.order_sums(late))
    pairs = category.order_categories(late, category.product_categories(late), money=True)
    assert told(read_facts(late, out, "category_facts").drop("order_month")) == told(pairs)

    # A changed price rewrites its month, a month without orders is no longer read, a named month is rewritten.
    some = late.order_items.agg(F.min("order_id")).first()[0]
    month = late.person_orders.where(F.col("order_id") == some).select(F.date_format(TIME, "yyyy-MM")).first()[0]
    dearer = F.when(F.col("order_id") == some, F.col("price") + 1).otherwise(F.col("price"))
    changed = replace(late, roles={**late.roles, "order_items": late.order_items.withColumn("price", dearer)})
    assert refresh_facts(changed, out) == [month]
    assert refresh_facts(cut(changed, F.date_format(TIME, "yyyy-MM") != month), out) == [month]
    assert read_facts(late, out, "order_facts").where(F.col("order_month") == month).count() == 0
    assert refresh_facts(cut(changed, F.date_format(TIME, "yyyy-MM") != month), out, [last]) == [last]


def test_orders_without_a_time_and_an_empty_model(late, tmp_path):
    none = F.when(F.col("order_id") % 50 == 0, F.lit(None)).otherwise(F.col(TIME)).cast("timestamp_ntz")
    orders = late.person_orders.withColumn(TIME, none)
    model = replace(late, person_orders=orders)
    assert NO_MONTH in refresh_facts(model, str(tmp_path / "a"))
    assert read_facts(model, str(tmp_path / "a"), "order_facts").count() == orders.count()
    nothing = cut(late, F.lit(False))
    assert month_fingerprints(nothing).count() == 0 and changed_months(month_fingerprints(nothing), None) == []


def test_marts_from_facts_equal_marts_from_scratch(late, tmp_path):
    params = Parameters(min_cohort=1, min_rows=1, min_buyers=1, focus_category="brand_01", trend_start="2000-01")
    assert refresh_marts(late, str(tmp_path / "kept"), params)
    scratch = write_marts(late, str(tmp_path / "scratch"), params)
    for name in ("kpis", "categories", "rfm", "cat_repurchase", "insights"):
        kept = late.spark.read.parquet(str(tmp_path / "kept" / name))
        assert told(kept) == told(scratch[name]), name
    assert refresh_marts(late, str(tmp_path / "kept"), params) == []
