"""Connections, dataset layout and per-table ingestion specs."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class JdbcConnection:
    """Where the relational source lives."""

    url: str
    user: str
    password: str = field(repr=False)
    driver: str = "com.mysql.cj.jdbc.Driver"

    @classmethod
    def from_env(cls) -> "JdbcConnection":
        # Variable names and defaults of the source database; the password has no default.
        host = os.environ.get("MYSQL_HOST", "mysql")
        database = os.environ.get("MYSQL_DATABASE", "project_db")
        return cls(
            url=f"jdbc:mysql://{host}:3306/{database}",
            user=os.environ.get("MYSQL_USER", "admin"),
            password=os.environ["MYSQL_PASSWORD"],
        )


@dataclass(frozen=True)
class Layout:
    """Roots of the three layers; any Hadoop-readable URI."""

    # Bucket names of the layers.
    bronze: str = "s3a://bronze"
    silver: str = "s3a://silver"
    gold: str = "s3a://gold"

    @classmethod
    def under(cls, root: str) -> "Layout":
        root = root.rstrip("/")
        return cls(f"{root}/bronze", f"{root}/silver", f"{root}/gold")

    def bronze_table(self, name: str) -> str:
        return f"{self.bronze}/{name}"

    def silver_table(self, name: str) -> str:
        return f"{self.silver}/{name}"

    def dimension(self, name: str) -> str:
        return f"{self.gold}/dimensions/{name}"

    def fact(self, name: str) -> str:
        return f"{self.gold}/facts/{name}"


# Columns tried, in this order, as the high-water mark.
HIGH_WATER_CANDIDATES = ("timestamp", "created_at", "updated_at")


@dataclass(frozen=True)
class TableSpec:
    """How one source table is ingested.

    ``partition_candidates`` are tried in order for the year/month/day columns;
    when none is present the load time is used.
    """

    name: str
    primary_key: tuple[str, ...]
    partition_candidates: tuple[str, ...]
    high_water_candidates: tuple[str, ...] = HIGH_WATER_CANDIDATES
    source_prefix: str = "mysql.project_db"

    @property
    def source_label(self) -> str:
        return f"{self.source_prefix}.{self.name}"


ORDERS = TableSpec("orders", ("id",), ("created_at", "timestamp"))
ORDER_DETAILS = TableSpec("order_details", ("id",), ("created_at", "timestamp"))
CUSTOMERS = TableSpec("customers", ("id",), ("created_at",))
PAYMENT_METHOD = TableSpec("payment_method", ("id",), ("created_at",))

SOURCE_TABLES = (ORDERS, ORDER_DETAILS, CUSTOMERS, PAYMENT_METHOD)

# Topics of the change stream and of the completed orders.
ORDERS_TOPIC = "mysql.project_db.orders"
ORDER_DETAILS_TOPIC = "mysql.project_db.order_details"
COMPLETED_TOPIC = "order_final"
KAFKA_BROKERS = ("localhost:9093", "localhost:9095")

# Lifetimes of the completion state, in seconds.
ORDER_INFO_TTL_SECONDS = 120
PRODUCT_SET_TTL_SECONDS = 120
EMITTED_TTL_SECONDS = 300
