"""Map an order/line-item star schema in Parquet onto the commerce roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.functions.frames import broadcast_if_small, inline_table
from orderlens.sources.model import CommerceModel, StateLookup

# Fixed value: the order status that plays the part of "delivered".
STAR_DELIVERED = "F"

# Two of the 25 brands have no translation on purpose: they keep their own name.
TRANSLATED_BRANDS = 23


def _lifecycle(lineitem: DataFrame) -> DataFrame:
    """Stage timestamps per order, one partial-then-final aggregate over the lines."""
    shipped = F.col("l_linestatus") == F.lit("F")
    kept = shipped & (F.col("l_returnflag") != F.lit("R"))
    return lineitem.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.min("l_shipdate").alias("order_approved_at"),
        F.min(F.when(shipped, F.col("l_shipdate"))).alias("order_delivered_carrier_date"),
        F.max(F.when(kept, F.col("l_shipdate"))).alias("order_delivered_customer_date"),
    )


def model_from_star(spark: SparkSession, directory: str) -> CommerceModel:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{directory}/{name}.parquet")

    orders_in, lineitem, customer = table("orders"), table("lineitem"), table("customer")
    nation, part, supplier = table("nation"), table("part"), table("supplier")

    headers = orders_in.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderkey").alias("customer_id"),
        F.col("o_custkey").alias("customer_unique_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
    )
    # The right side is grouped by its key, so Catalyst drops this join for
    # queries that use no stage timestamp.
    person_orders = headers.join(_lifecycle(lineitem), "order_id", "left")
    identities = headers.select("customer_id", "customer_unique_id")

    person_state = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").alias("customer_unique_id"), F.col("n_name").alias("customer_state")
    )

    roles = {
        "orders": person_orders.drop("customer_unique_id"),
        "customers": identities.join(person_state, "customer_unique_id", "left").select(
            "customer_id", "customer_unique_id", "customer_state"
        ),
        "order_items": lineitem.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_extendedprice").alias("price"),
        ),
        "order_payments": orders_in.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_orderpriority").alias("payment_type"),
            F.col("o_totalprice").alias("payment_value"),
        ),
        "order_reviews": lineitem.select(
            F.col("l_orderkey").alias("order_id"),
            (F.col("l_quantity").cast("int") % 5 + 1).alias("review_score"),
        ),
        "products": part.select(
            F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("product_category_name")
        ),
        "sellers": supplier.select(F.col("s_suppkey").alias("seller_id")),
        "geolocation": customer.select(F.col("c_nationkey").alias("zip_code_prefix")),
        "category_translation": inline_table(
            spark,
            ["product_category_name", "product_category_name_english"],
            [(f"Brand#{n}", f"brand_{n:02d}") for n in range(1, TRANSLATED_BRANDS + 1)],
        ),
    }
    return CommerceModel(
        spark=spark,
        roles=roles,
        identities=identities,
        person_orders=person_orders,
        states=StateLookup("customer_unique_id", person_state),
        # Persons are made distinct before the join, so one heavy buyer costs one row.
        person_states=identities.select("customer_unique_id")
        .distinct()
        .join(broadcast_if_small(person_state), "customer_unique_id", "left"),
        delivered_status=STAR_DELIVERED,
        row_sources={"customers": identities, "orders": headers},
    )
