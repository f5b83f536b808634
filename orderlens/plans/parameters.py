"""Fixed labels and thresholds of the named queries."""

from __future__ import annotations

from dataclasses import dataclass

from orderlens.operators.durations import Span

PURCHASED = "order_purchase_timestamp"
APPROVED = "order_approved_at"
CARRIER = "order_delivered_carrier_date"
DELIVERED = "order_delivered_customer_date"

# Funnel stages and their report labels.
ORDER_STAGES = (
    ("1. Purchase", PURCHASED),
    ("2. Approved", APPROVED),
    ("3. Carrier Pickup", CARRIER),
    ("4. Delivered", DELIVERED),
)
DASHBOARD_STAGES = (
    ("1. 下单", PURCHASED),
    ("2. 审批", APPROVED),
    ("3. 揽收", CARRIER),
    ("4. 送达", DELIVERED),
)

# Stage durations. The first is in hours, the others in days.
STAGE_SPANS = (
    Span("purchase→approve", PURCHASED, APPROVED, "hours"),
    Span("approve→carrier", APPROVED, CARRIER, "days"),
    Span("carrier→customer", CARRIER, DELIVERED, "days"),
)
DASHBOARD_SPANS = (
    Span("1. 下单→审批", PURCHASED, APPROVED, "hours"),
    Span("2. 审批→揽收", APPROVED, CARRIER, "days"),
    Span("3. 揽收→送达", CARRIER, DELIVERED, "days"),
)
UNIT_LABELS = {"hours": "小时", "days": "天"}
ORDER_SPANS = (
    Span("hr_to_approve", PURCHASED, APPROVED, "hours"),
    Span("days_to_carrier", APPROVED, CARRIER, "days"),
    Span("days_to_customer", CARRIER, DELIVERED, "days"),
    Span("days_total", PURCHASED, DELIVERED, "days"),
)
STATUS_SPANS = (
    Span("avg_hr_to_approve", PURCHASED, APPROVED, "hours"),
    Span("avg_days_to_carrier", APPROVED, CARRIER, "days"),
)

DELIVERY_RATE = {"delivery_rate": (DELIVERED, PURCHASED)}
STATE_RATIOS = {**DELIVERY_RATE, "carrier_rate": (CARRIER, APPROVED)}


@dataclass(frozen=True)
class Parameters:
    """Thresholds of the named queries, with the defaults of the full data set."""

    min_cohort: int = 50
    min_rows: int = 100
    min_buyers: int = 500
    focus_category: str = "watches_gifts"
    trend_start: str = "2018-01"


# Thresholds that leave some rows in and some out on the small star schema.
STAR_PARAMETERS = Parameters(min_cohort=5, focus_category="brand_01", trend_start="2000-01")
