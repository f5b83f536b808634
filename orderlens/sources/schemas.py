"""Roles of the commerce model: their columns, types and file patterns."""

from __future__ import annotations

# Role names, columns and types every operator relies on.
ROLE_COLUMNS: dict[str, dict[str, str]] = {
    "orders": {
        "order_id": "string",
        "customer_id": "string",
        "order_status": "string",
        "order_purchase_timestamp": "timestamp_ntz",
        "order_approved_at": "timestamp_ntz",
        "order_delivered_carrier_date": "timestamp_ntz",
        "order_delivered_customer_date": "timestamp_ntz",
    },
    "customers": {
        "customer_id": "string",
        "customer_unique_id": "string",
        "customer_state": "string",
    },
    "order_items": {
        "order_id": "string",
        "product_id": "string",
        "seller_id": "string",
        "price": "double",
    },
    "order_payments": {
        "order_id": "string",
        "payment_type": "string",
        "payment_value": "double",
    },
    "order_reviews": {"order_id": "string", "review_score": "int"},
    "products": {"product_id": "string", "product_category_name": "string"},
    "sellers": {"seller_id": "string"},
    "geolocation": {"zip_code_prefix": "string"},
    "category_translation": {
        "product_category_name": "string",
        "product_category_name_english": "string",
    },
}

# File name patterns of the public nine-table export.
ROLE_FILES: dict[str, str] = {
    "orders": "*orders_dataset.csv",
    "customers": "*customers_dataset.csv",
    "order_items": "*order_items_dataset.csv",
    "order_payments": "*order_payments_dataset.csv",
    "order_reviews": "*order_reviews_dataset.csv",
    "products": "*products_dataset.csv",
    "sellers": "*sellers_dataset.csv",
    "geolocation": "*geolocation_dataset.csv",
    "category_translation": "*category_name_translation.csv",
}

# Source column that fills a role column under another name.
COLUMN_ALIASES: dict[str, str] = {"geolocation_zip_code_prefix": "zip_code_prefix"}
