"""The nine roles of a commerce data set and the views derived from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.sources.schemas import ROLE_COLUMNS


@dataclass(frozen=True)
class StateLookup:
    """Maps a key found on the order frame to a region; unique on ``key``."""

    key: str
    frame: DataFrame


@dataclass(frozen=True)
class CommerceModel:
    """Role frames plus the identity views most operators start from.

    ``identities``      one row per order identity with its person
    ``person_orders``   orders with ``customer_unique_id``
    ``states``          lookup from an order key to ``customer_state``
    ``person_states``   distinct (person, state) pairs
    """

    spark: SparkSession
    roles: dict[str, DataFrame]
    identities: DataFrame
    person_orders: DataFrame
    states: StateLookup
    person_states: DataFrame
    delivered_status: str = "delivered"
    row_sources: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def from_roles(cls, spark: SparkSession, roles: dict[str, DataFrame], delivered_status: str = "delivered"):
        """Derive the identity views by joining orders with customers."""
        missing = sorted(set(ROLE_COLUMNS) - set(roles))
        if missing:
            raise ValueError(f"missing roles: {', '.join(missing)}")
        customers = roles["customers"]
        identities = customers.select("customer_id", "customer_unique_id")
        return cls(
            spark=spark,
            roles=roles,
            identities=identities,
            person_orders=resolve_person(roles["orders"], identities),
            states=StateLookup("customer_id", customers.select("customer_id", "customer_state")),
            person_states=customers.select("customer_unique_id", "customer_state").distinct(),
            delivered_status=delivered_status,
        )

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["roles"][name]
        except KeyError:
            raise AttributeError(name) from None

    def row_source(self, role: str) -> DataFrame:
        """The cheapest frame with the same rows as the role, for counting."""
        return self.row_sources.get(role, self.roles[role])

    @property
    def state_orders(self) -> DataFrame:
        """Orders with the key of ``states``; persons are joined only where that key needs them."""
        return self.orders if self.states.key in self.orders.columns else self.person_orders

    def delivered(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col("order_status") == F.lit(self.delivered_status))

    def purchases(self) -> DataFrame:
        """Delivered orders as (person, order, purchase time)."""
        return self.delivered(self.person_orders).select(
            "customer_unique_id", "order_id", "order_purchase_timestamp"
        )

    def create_views(self, prefix: str = "") -> None:
        """Register one temporary view per role for ad-hoc SQL."""
        for role, df in self.roles.items():
            df.createOrReplaceTempView(f"{prefix}{role}")


def resolve_person(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Attach the person behind each order identity."""
    return orders.join(customers.select("customer_id", "customer_unique_id"), "customer_id")
