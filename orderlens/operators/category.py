"""Category performance and repeat rate within a category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.frames import fits_broadcast, salted_join
from orderlens.functions.numeric import major_units, minor_units, percent, rnd, total_units
from orderlens.operators.lookups import translate
from orderlens.operators.shares import top_k
from orderlens.sources.model import CommerceModel


def product_categories(model: CommerceModel) -> DataFrame:
    """Product to category name, translated where a translation exists.

    The translation is joined to the products, not to the much longer item table.
    """
    return translate(
        model.products, model.category_translation, "product_category_name", "product_category_name_english", "category"
    ).select("product_id", "category")


def order_categories(model: CommerceModel, products: DataFrame, money: bool = False) -> DataFrame:
    """One row per (order, category) of the items, with ``_units`` and ``_items`` if ``money`` is asked for.

    Products that fit a broadcast meet the items in their scan. Otherwise items
    are summed per (order, product) first, so neither a hot product nor a hot
    order is a key of its own, and these rows meet the products by a salted join.
    """
    measures = [total_units("_units").alias("_units"), F.sum("_items").alias("_items")] if money else []
    columns = [minor_units("price").alias("_units"), F.col("price").isNotNull().cast("bigint").alias("_items")] if money else []
    items = model.order_items.select("order_id", "product_id", *columns)
    if fits_broadcast(products):
        met = items.join(F.broadcast(products), "product_id")
    else:
        pair = items.groupBy("order_id", "product_id")
        met = salted_join(pair.agg(*measures) if money else items.distinct(), products, "product_id", "order_id")
    by = met.groupBy("order_id", "category")
    return by.agg(*measures) if money else met.select("order_id", "category").distinct()


def _products_sold(model: CommerceModel, products: DataFrame) -> DataFrame:
    """Distinct products with items per category; a repeated translation counts once."""
    sold = model.order_items.select("product_id").distinct()
    return sold.join(products, "product_id").select("category", "product_id").distinct().groupBy("category").agg(
        F.count(F.lit(1)).alias("product_cnt")
    )


def category_performance(
    model: CommerceModel,
    k: int | None = 20,
    drop_null: bool = False,
    details: bool = True,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Orders, revenue, mean price and products per category, largest first.

    Orders, revenue and items come from one frame with a row per (order,
    category), see ``order_categories``; products from their distinct ids.
    ``details=False`` leaves out mean price and products. ``pairs`` is that frame
    (with money) if it exists already.
    """
    products = product_categories(model)
    if drop_null:
        products = products.filter(F.col("category").isNotNull())
        pairs = pairs.filter(F.col("category").isNotNull()) if pairs is not None else None
    sales = (
        (pairs if pairs is not None else order_categories(model, products, money=True))
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("order_cnt"),
            F.sum("_units").alias("_units"),
            F.sum("_items").alias("_items"),
        )
    )
    revenue = major_units("_units")
    out = sales.select("category", "order_cnt", rnd(revenue, 2).alias("total_revenue"), "_units", "_items")
    if details:
        price = rnd(F.try_divide(revenue, F.col("_items").cast("double")), 2).alias("avg_price")
        sold = _products_sold(model, products).withColumnRenamed("category", "_category")
        out = out.join(sold, F.col("category").eqNullSafe(F.col("_category"))).select(
            "category", "order_cnt", "total_revenue", price, "product_cnt"
        )
    else:
        out = out.drop("_units", "_items")
    return top_k(out, "order_cnt", k, ["category"]) if k else out


def category_repurchase(
    model: CommerceModel, min_buyers: int = 500, k: int | None = 15, pairs: DataFrame | None = None
) -> DataFrame:
    """Buyers per category and the share who ordered from it at least twice.

    Items shrink to distinct (order, category) pairs before they meet the
    orders, so the per-person count is a plain row count and no distinct is
    needed further up. ``pairs`` are those of ``order_categories`` if they exist already.
    """
    per_person = (
        (pairs if pairs is not None else order_categories(model, product_categories(model)))
        .select("order_id", "category")
        .join(model.purchases().select("order_id", "customer_unique_id"), "order_id")
        .groupBy("customer_unique_id", "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    out = (
        per_person.groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("total_buyers"),
            F.count(F.when(F.col("n") >= 2, F.lit(1))).alias("repurchase_buyers"),
        )
        .filter(F.col("total_buyers") >= min_buyers)
        .select(
            "category",
            "total_buyers",
            "repurchase_buyers",
            percent("repurchase_buyers", "total_buyers").alias("repurchase_rate"),
        )
    )
    return top_k(out, "repurchase_rate", k, ["category"]) if k else out
