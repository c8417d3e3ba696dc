"""Gold layer: four dimensions and two facts."""

from __future__ import annotations

import logging
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.config import Layout
from ordermill.functions.calendar import date_id
from ordermill.functions.payments import payment_type
from ordermill.operators.ingest import first_present
from ordermill.sinks.datasets import write_dataset
from ordermill.sources.datasets import read_dataset

log = logging.getLogger(__name__)

# Calendar range and the constants of attributes without a source.
CALENDAR_START = date(2024, 1, 1)
CALENDAR_END = date(2027, 12, 31)
PRODUCT_CONSTANTS = {
    "category": "General",
    "subcategory": "Standard",
    "brand": "Unknown",
    "price": 0.0,
    "product_status": "Active",
}
ORDER_STATUS = "completed"


def _now(stamp: Column | None) -> Column:
    return F.current_timestamp() if stamp is None else stamp


def _dim_stamps(stamp: Column | None) -> list[Column]:
    return [_now(stamp).alias("dim_created_at"), _now(stamp).alias("dim_updated_at")]


def dim_customer(customers: DataFrame, stamp: Column | None = None) -> DataFrame:
    return customers.select(
        F.col("id").alias("customer_id"),
        F.col("name").alias("customer_name"),
        F.col("phone_number").alias("phone"),
        F.col("tier").alias("customer_segment"),
        "updated_at",
        *_dim_stamps(stamp),
    )


def dim_payment_method(
    methods: DataFrame, stamp: Column | None = None, normalize: bool = False
) -> DataFrame:
    return methods.select(
        F.col("id").alias("payment_method_id"),
        "method_name",
        "bank",
        payment_type(F.col("method_name"), normalize).alias("payment_type"),
        F.lit(1).alias("is_active"),
        *_dim_stamps(stamp),
    )


def dim_product(details: DataFrame, stamp: Column | None = None) -> DataFrame:
    """One row per product seen in order lines; a null product keeps a row without a name."""
    return details.select("product_id").distinct().select(
        "product_id",
        F.concat(F.lit("Product_"), F.col("product_id")).alias("product_name"),
        *[F.lit(value).alias(name) for name, value in PRODUCT_CONSTANTS.items()],
        *_dim_stamps(stamp),
    )


def dim_date(
    spark: SparkSession, start: date = CALENDAR_START, end: date = CALENDAR_END
) -> DataFrame:
    """One row per day from ``start`` to ``end``; weeks are ISO weeks, Monday is day 1."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))
    weekday = F.weekday("date")
    return days.select(
        date_id(F.col("date")).alias("date_id"),
        "date",
        F.year("date").alias("year"),
        F.quarter("date").alias("quarter"),
        F.month("date").alias("month"),
        F.date_format("date", "MMMM").alias("month_name"),
        F.dayofmonth("date").alias("day"),
        (weekday + 1).alias("day_of_week"),
        F.date_format("date", "EEEE").alias("day_name"),
        F.when(weekday >= 5, 1).otherwise(0).alias("is_weekend"),
        F.lit(0).alias("is_holiday"),
        F.weekofyear("date").alias("week_of_year"),
    )


def _order_moment(orders: DataFrame, stamp: Column | None) -> Column:
    name = first_present(orders, ("order_created_at", "timestamp"))
    return _now(stamp) if name is None else F.col(name)


def fact_orders(orders: DataFrame, details: DataFrame, stamp: Column | None = None) -> DataFrame:
    """One row per order with the counts of its lines; orders without lines get zeros."""
    totals = details.groupBy("order_id").agg(
        F.count("product_id").alias("product_count"), F.sum("quantity").alias("total_quantity")
    )
    moment = _order_moment(orders, stamp)
    return orders.join(totals, "order_id", "left").select(
        "order_id",
        "customer_id",
        "payment_method_id",
        date_id(moment).alias("order_date_id"),
        F.coalesce("product_count", F.lit(0)).alias("product_count"),
        F.coalesce("num_products", F.lit(0)).alias("expected_products"),
        F.coalesce("total_quantity", F.lit(0)).alias("quantity_ordered"),
        F.lit(0.0).alias("total_amount"),
        F.lit(ORDER_STATUS).alias("order_status"),
        moment.alias("created_timestamp"),
        _now(stamp).alias("fact_created_at"),
    )


def fact_order_products(details: DataFrame, stamp: Column | None = None) -> DataFrame:
    return details.select(
        "order_id",
        "product_id",
        F.coalesce("quantity", F.lit(1)).alias("quantity"),
        F.lit(0.0).alias("unit_price"),
        F.lit(0.0).alias("line_total"),
        _now(stamp).alias("fact_created_at"),
    )


def price_lines(lines: DataFrame, books: DataFrame) -> DataFrame:
    """Lines with the catalogue's unit price and their total; unknown products stay at zero."""
    prices = books.select(F.col("id").alias("product_id"), F.col("unit_price").alias("_price"))
    price = F.coalesce("_price", F.lit(0).cast("decimal(10,2)"))
    return lines.join(prices, "product_id", "left").select(
        *[
            {
                "unit_price": price.alias("unit_price"),
                "line_total": (price * F.col("quantity").cast("decimal(10,0)")).alias("line_total"),
            }.get(c, F.col(c))
            for c in lines.columns
        ]
    )


def price_orders(orders: DataFrame, priced_lines: DataFrame) -> DataFrame:
    """``fact_orders`` with ``total_amount`` summed over its priced lines."""
    sums = priced_lines.groupBy("order_id").agg(F.sum("line_total").alias("_amount"))
    amount = F.coalesce("_amount", F.lit(0)).alias("total_amount")
    return orders.join(sums, "order_id", "left").select(
        *[amount if c == "total_amount" else F.col(c) for c in orders.columns]
    )


def run_gold(
    spark: SparkSession,
    layout: Layout,
    stamp: Column | None = None,
    calendar: tuple[date, date] = (CALENDAR_START, CALENDAR_END),
    normalize_payments: bool = False,
) -> dict[str, int]:
    """Rebuild the star schema; every table is overwritten, so dimensions hold current values only."""

    def silver(name: str) -> DataFrame:
        return read_dataset(spark, layout.silver_table(name))

    counts = {}

    def store(name: str, frame: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
        counts[name] = write_dataset(frame, path, "overwrite", partition_by)
        log.info("gold %s: %d rows", name, counts[name])

    methods = dim_payment_method(silver("payment_method"), stamp, normalize_payments)
    store("dim_customer", dim_customer(silver("customers"), stamp), layout.dimension("dim_customer"))
    store("dim_payment_method", methods, layout.dimension("dim_payment_method"))
    store("dim_product", dim_product(silver("order_details"), stamp), layout.dimension("dim_product"))
    store("dim_date", dim_date(spark, *calendar), layout.dimension("dim_date"))
    store(
        "fact_orders",
        fact_orders(silver("orders"), silver("order_details"), stamp),
        layout.fact("fact_orders"),
        ("order_date_id",),
    )
    store(
        "fact_order_products",
        fact_order_products(silver("order_details"), stamp),
        layout.fact("fact_order_products"),
    )
    return counts


def run_pricing(spark: SparkSession, layout: Layout, books: DataFrame) -> dict[str, int]:
    """The facts with the catalogue's prices, beside the unpriced ones, which ``run_gold`` rebuilds."""
    lines = price_lines(read_dataset(spark, layout.fact("fact_order_products")), books)
    orders = read_dataset(spark, layout.fact("fact_orders"))
    counts = {"fact_order_products_priced": write_dataset(lines, layout.fact("fact_order_products_priced"))}
    priced = read_dataset(spark, layout.fact("fact_order_products_priced"))
    target = layout.fact("fact_orders_priced")
    counts["fact_orders_priced"] = write_dataset(price_orders(orders, priced), target, "overwrite", ("order_date_id",))
    for name, rows in counts.items():
        log.info("gold %s: %d rows", name, rows)
    return counts
