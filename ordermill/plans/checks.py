"""The data-quality report over the silver layer."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from ordermill.config import Layout
from ordermill.operators import profile, quality
from ordermill.sinks.datasets import write_dataset
from ordermill.sources.datasets import read_dataset

log = logging.getLogger(__name__)


def model_checks(
    orders: DataFrame, details: DataFrame, customers: DataFrame, methods: DataFrame, order_key: str = "order_id"
) -> DataFrame:
    """Missing values, repeated keys and orphans of the order model.

    Row-wise checks of a table take one pass; each key is grouped once, for its repeats, its orphans and as a parent.
    """
    return quality.report(
        [
            quality.not_null(orders, "orders", ["num_products", "customer_id"]),
            quality.not_null(details, "order_details", ["product_id"]),
            quality.unique_key(orders, "orders", [order_key]),
            quality.unique_key(details, "order_details", ["order_id", "product_id"]),
            quality.foreign_keys(
                orders, "orders", {"customer_id": (customers, "id"), "payment_method_id": (methods, "id")}
            ),
            quality.foreign_keys(details, "order_details", {"order_id": (orders, order_key)}),
        ]
    )


def run_checks(spark: SparkSession, layout: Layout) -> int:
    """Write the report and the profiles of the silver tables; return the number of violations found."""
    tables = {n: read_dataset(spark, layout.silver_table(n)) for n in ("orders", "order_details", "customers", "payment_method")}
    found = model_checks(tables["orders"], tables["order_details"], tables["customers"], tables["payment_method"])
    target = f"{layout.silver}/_quality"
    write_dataset(found, target)
    for name, table in tables.items():
        write_dataset(profile.profile(table, table.columns), f"{layout.silver}/_profiles/{name}")
    violations = 0
    for row in read_dataset(spark, target).collect():  # one row per check
        violations += row["violations"]
        log.log(logging.WARNING if row["violations"] else logging.INFO, "%s of %s: %d", row["check"], row["table"], row["violations"])
    return violations
