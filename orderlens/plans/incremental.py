"""Order facts kept by month of purchase, so a refresh rewrites only months that changed.

``order_facts`` holds a row per order and ``category_facts`` a row per order and
category, both in folders by month; ``month_state`` holds a fingerprint per month.
The fingerprints of the model against those stored tell which months changed. Only
these pass the joins with persons, products and money sums, and only their folders
are replaced (dynamic partition overwrite). The state is written last and to a new
folder: a refresh that dies half-way finds the same months changed when it is run
again. Months whose orders are all gone leave the state and are no longer read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.dates import month_label
from orderlens.operators import category, kpi
from orderlens.plans.marts import write_marts
from orderlens.plans.parameters import Parameters
from orderlens.sources.model import CommerceModel

MONTH, NO_MONTH = "order_month", "none"
_TIME = "order_purchase_timestamp"


def _month() -> F.Column:
    return F.coalesce(month_label(_TIME), F.lit(NO_MONTH))


def _row_sum(*columns: str) -> F.Column:
    """Order-free sum of row hashes; decimal, so it can't overflow."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))


def month_fingerprints(model: CommerceModel) -> DataFrame:
    """One row per month: orders, items and the sums of their row hashes.

    Items are summed per order with a map-side step first and meet the orders once.
    A change of a person, a status, an item's product or a price changes the sum of
    its month. Category names are not part of it: pass the months, or all, to
    ``refresh_facts`` after the product table changed.
    """
    items = model.order_items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("_n"), _row_sum("order_id", "product_id", "price").alias("_hash")
    )
    orders = model.person_orders.select(
        "order_id", _month().alias(MONTH), F.xxhash64("order_id", "customer_unique_id", "order_status", _TIME).alias("_own")
    )
    joined = orders.join(items, "order_id", "left")
    return joined.groupBy(MONTH).agg(
        F.count(F.lit(1)).alias("orders"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("items"),
        F.sum(F.col("_own").cast("decimal(38,0)")).alias("order_sum"),
        F.coalesce(F.sum("_hash"), F.lit(0)).cast("decimal(38,0)").alias("item_sum"),
    )


def _exists(model: CommerceModel, path: str) -> bool:
    at = model.spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(model.spark._jsc.hadoopConfiguration()).exists(at)


def _states(model: CommerceModel, out_dir: str) -> DataFrame | None:
    """The last state whose write ended, or None."""
    folder = f"{out_dir}/month_state"
    if not _exists(model, folder):
        return None
    states = model.spark.read.parquet(f"{folder}/*")
    return states.where(F.col("version") == states.agg(F.max("version")).scalar())


def changed_months(fingerprints: DataFrame, stored: DataFrame | None) -> list[str]:
    """Months that are new, differ or are gone; the list has at most one entry a month."""
    if stored is None:
        return sorted(r[0] for r in fingerprints.select(MONTH).collect())
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in fingerprints.columns]
    met = fingerprints.alias("n").join(stored.alias("o"), MONTH, "full")
    alike = same[1]
    for one in same[2:]:
        alike = alike & one
    return sorted(r[0] for r in met.where(~alike).select(MONTH).collect())


def _of_months(model: CommerceModel, months: Sequence[str]) -> CommerceModel:
    """The model with the orders of these months; the filter on the purchase time reaches the scan."""
    named = [m for m in months if m != NO_MONTH]
    keep = F.lit(False)
    for month in named:
        first = F.lit(f"{month}-01").cast("date")
        keep = keep | ((F.col(_TIME) >= first) & (F.col(_TIME) < F.add_months(first, 1)))
    if NO_MONTH in months:
        keep = keep | F.col(_TIME).isNull()
    orders = model.person_orders.where(keep)
    ids = orders.select("order_id")
    items = model.order_items.join(ids, "order_id", "left_semi")
    return replace(model, roles={**model.roles, "order_items": items}, person_orders=orders)


def _facts(part: CommerceModel) -> dict[str, DataFrame]:
    orders = part.person_orders.select("order_id", "customer_unique_id", "order_status", _TIME, _month().alias(MONTH))
    sums = kpi.order_sums(part)
    pairs = category.order_categories(part, category.product_categories(part), money=True)
    return {
        "order_facts": orders.join(sums, "order_id", "left"),
        "category_facts": pairs.join(orders.select("order_id", MONTH), "order_id"),
    }


def refresh_facts(model: CommerceModel, out_dir: str, months: Sequence[str] | None = None) -> list[str]:
    """Bring the facts below ``out_dir`` up to date and return the months rewritten.

    ``months`` (labels like ``2024-05``) are rewritten whether changed or not.
    ``out_dir`` must be storage all executors share; one refresh runs at a time.
    """
    folder = f"{out_dir}/month_state"
    stored = _states(model, out_dir)
    version = 1 if stored is None else stored.agg(F.max("version")).first()[0] + 1
    # Written before the facts and read back, so the state tells what was compared.
    fresh = f"{out_dir}/month_candidates"
    month_fingerprints(model).coalesce(1).write.mode("overwrite").parquet(fresh)
    fingerprints = model.spark.read.parquet(fresh)
    held = {r[0] for r in fingerprints.select(MONTH).collect()}
    changed = sorted({*changed_months(fingerprints, stored), *(months or [])})
    present = [m for m in changed if m in held]
    if present:
        for name, df in _facts(_of_months(model, present)).items():
            # Each month is dealt over several tasks by the order, so a month isn't one task's work.
            dealt = df.repartition(MONTH, F.pmod(F.xxhash64("order_id"), F.lit(8)))
            dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(f"{out_dir}/{name}")
    if changed:
        fingerprints.withColumn("version", F.lit(version)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/v{version}")
    return changed


def read_facts(model: CommerceModel, out_dir: str, name: str) -> DataFrame:
    """``order_facts`` or ``category_facts`` of the months in the state."""
    months = [r[0] for r in _states(model, out_dir).select(MONTH).collect()]
    spark = model.spark
    spark.catalog.refreshByPath(f"{out_dir}/{name}")
    facts = spark.read.option("basePath", f"{out_dir}/{name}")
    return facts.parquet(*[f"{out_dir}/{name}/{MONTH}={m}" for m in months if _exists(model, f"{out_dir}/{name}/{MONTH}={m}")])


def refresh_marts(model: CommerceModel, out_dir: str, params: Parameters = Parameters(), months: Sequence[str] | None = None) -> list[str]:
    """Refresh the facts, then the marts from them; nothing is written if no month changed and none is named.

    Items of unchanged months are neither joined nor summed again: the marts read
    sums and categories from the facts.
    """
    facts_dir = f"{out_dir}/facts"
    changed = refresh_facts(model, facts_dir, months)
    if changed:
        orders = read_facts(model, facts_dir, "order_facts")
        sums = orders.where(F.col("_items").isNotNull()).select("order_id", "_units", "_items")
        pairs = read_facts(model, facts_dir, "category_facts").drop(MONTH)
        write_marts(model, out_dir, params, sums=sums, pairs=pairs)
    return changed
