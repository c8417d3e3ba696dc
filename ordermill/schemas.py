"""Logical schemas of the model (Spark DDL)."""

from __future__ import annotations

CUSTOMERS = "id INT, name STRING, phone_number STRING, tier STRING, updated_at TIMESTAMP"

PAYMENT_METHOD = "id INT, method_name STRING, bank STRING"

ORDERS = (
    "id STRING, timestamp TIMESTAMP, customer_id INT, store_id INT, "
    "payment_method_id INT, num_products INT"
)

ORDER_DETAILS = (
    "id INT, order_id STRING, product_id INT, quantity INT, "
    "subtotal DECIMAL(10,2), is_suggestion BOOLEAN"
)

BOOKS = (
    "id BIGINT, work_key STRING, title STRING, author_name STRING, author_key STRING, "
    "first_publish_year INT, isbn STRING, language STRING, cover_id STRING, "
    "unit_price DECIMAL(10,2), created_at TIMESTAMP"
)

# Row images inside change events; the order time travels as epoch milliseconds.
ORDER_IMAGE = (
    "id STRING, customer_id INT, store_id INT, payment_method_id INT, "
    "num_products INT, timestamp BIGINT"
)

DETAIL_IMAGE = (
    "id INT, order_id STRING, product_id INT, quantity INT, "
    "subtotal DECIMAL(10,2), is_suggestion BOOLEAN"
)

CATALOGUE_DOC = (
    "STRUCT<key: STRING, title: STRING, author_name: ARRAY<STRING>, "
    "author_key: ARRAY<STRING>, first_publish_year: INT, isbn: ARRAY<STRING>, "
    "language: ARRAY<STRING>, cover_i: BIGINT>"
)

CATALOGUE_PAGE = f"start BIGINT, docs ARRAY<{CATALOGUE_DOC}>, _corrupt_record STRING"

COMPLETED_ORDER = (
    "order_id STRING, customer_id STRING, payment_method_id STRING, "
    "product_ids ARRAY<STRING>"
)


def envelope(image: str) -> str:
    """Schema of one change-event message whose row image has fields ``image``."""
    return (
        f"payload STRUCT<before: STRUCT<{_nested(image)}>, after: STRUCT<{_nested(image)}>, "
        "op: STRING, source: STRUCT<db: STRING, `table`: STRING, file: STRING, pos: BIGINT>>, "
        "_corrupt_record STRING"
    )


def _nested(fields: str) -> str:
    """``a INT, b STRING`` as struct members ``a: INT, b: STRING``."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(fields + ","):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            name, kind = fields[start:i].strip().split(" ", 1)
            out.append(f"`{name}`: {kind}")
            start = i + 1
    return ", ".join(out)
