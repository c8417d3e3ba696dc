"""Silver layer: one clean row per key."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.config import Layout
from ordermill.operators.drift import read_loads
from ordermill.operators.latest import latest_per_key
from ordermill.sinks.datasets import write_dataset

log = logging.getLogger(__name__)

QUANTITY_POLICIES = ("constant", "preserve")


def newest_load_first(frame: DataFrame, ties: Sequence[str]) -> list[Column]:
    """Load time, then the tie-breakers that are present, all descending, then a digest of the row.

    With the digest the survivor never depends on the order of tasks, whatever columns a source lacks.
    """
    names = ["bronze_ingestion_time", *[c for c in ties if c in frame.columns]]
    return [*[F.col(c).desc() for c in names], F.xxhash64(*frame.columns)]


def _stamped(frame: DataFrame, stamp: Column | None) -> DataFrame:
    return frame.withColumn("silver_processed_time", F.current_timestamp() if stamp is None else stamp)


def clean_orders(bronze: DataFrame, stamp: Column | None = None) -> DataFrame:
    order = newest_load_first(bronze, ("updated_at", "created_at", "timestamp", "payment_method_id"))
    cleaned = latest_per_key(bronze, ["id"], order).withColumnRenamed("id", "order_id")
    # Renaming a column that is absent changes nothing.
    return _stamped(cleaned.withColumnRenamed("created_at", "order_created_at"), stamp)


def clean_order_details(
    bronze: DataFrame,
    stamp: Column | None = None,
    quantity_policy: str = "constant",
    ties: Sequence[str] = ("id",),
) -> DataFrame:
    """Latest row per (order, product).

    ``constant`` sets every quantity to 1; ``preserve`` only fills missing ones.
    """
    if quantity_policy not in QUANTITY_POLICIES:
        raise ValueError(f"quantity_policy must be one of {QUANTITY_POLICIES}")
    order = newest_load_first(bronze, ties)
    cleaned = latest_per_key(bronze, ["order_id", "product_id"], order)
    one = F.lit(1)
    quantity = one if quantity_policy == "constant" else F.coalesce("quantity", one)
    return _stamped(cleaned.withColumn("quantity", quantity), stamp)


def clean_customers(bronze: DataFrame, stamp: Column | None = None) -> DataFrame:
    order = newest_load_first(bronze, ("updated_at", "name", "tier", "phone_number"))
    return _stamped(latest_per_key(bronze, ["id"], order), stamp)


def clean_payment_method(bronze: DataFrame, stamp: Column | None = None) -> DataFrame:
    order = newest_load_first(bronze, ("method_name", "bank"))
    return _stamped(latest_per_key(bronze, ["id"], order), stamp)


def run_silver(
    spark: SparkSession,
    layout: Layout,
    stamp: Column | None = None,
    quantity_policy: str = "constant",
    detail_ties: Sequence[str] = ("id",),
) -> dict[str, int]:
    def bronze(name: str) -> DataFrame:
        return read_loads(spark, layout.bronze_table(name))

    tables = {
        "orders": lambda: clean_orders(bronze("orders"), stamp),
        "order_details": lambda: clean_order_details(bronze("order_details"), stamp, quantity_policy, detail_ties),
        "customers": lambda: clean_customers(bronze("customers"), stamp),
        "payment_method": lambda: clean_payment_method(bronze("payment_method"), stamp),
    }
    counts = {}
    for name, build in tables.items():
        counts[name] = write_dataset(build(), layout.silver_table(name))
        log.info("silver %s: %d rows", name, counts[name])
    return counts
