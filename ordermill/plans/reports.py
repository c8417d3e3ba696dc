"""Queries over the star schema and the source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orders_by_month_segment(orders: DataFrame, customers: DataFrame, dates: DataFrame) -> DataFrame:
    """Orders, products and quantities per month and customer segment.

    The fact is shuffled for the customer join at most, where AQE may split a customer with very many orders, since what follows needs
    no partitioning of it; the sums are combined before their shuffle. Days outside the calendar and unknown customers
    count under a null month or segment.
    """
    segments = customers.select("customer_id", "customer_segment")
    months = dates.select(F.col("date_id").alias("order_date_id"), "year", "month")
    return (
        orders.join(months, "order_date_id", "left")
        .join(segments, "customer_id", "left")
        .groupBy("year", "month", "customer_segment")
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.sum("product_count").alias("product_count"),
            F.sum("quantity_ordered").alias("quantity_ordered"),
        )
    )


def sales_by_weekday_payment(orders: DataFrame, methods: DataFrame, dates: DataFrame) -> DataFrame:
    """Orders and quantities per weekday and payment type.

    The fact is first summed per (day, method): what is joined is bounded by days
    times methods, however large or skewed the fact is. Days outside the calendar and unknown
    methods count under nulls.
    """
    daily = orders.groupBy("order_date_id", "payment_method_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity_ordered").alias("q")
    )
    days = dates.select(
        F.col("date_id").alias("order_date_id"), "day_of_week", "day_name", "is_weekend"
    )
    types = methods.select("payment_method_id", "payment_type")
    return (
        daily.join(days, "order_date_id", "left")
        .join(types, "payment_method_id", "left")
        .groupBy("day_of_week", "day_name", "is_weekend", "payment_type")
        .agg(F.sum("n").alias("order_count"), F.sum("q").alias("quantity_ordered"))
    )


def quarter_sales(orders: DataFrame, dates: DataFrame, year: int, quarter: int) -> DataFrame:
    """Orders and quantities of one quarter per month and payment method.

    The fact is partitioned by day. The quarter is a filter on the calendar, which is broadcast (one row per day); its days prune the
    fact's folders while the query runs, so other quarters are not opened.
    """
    days = dates.where((F.col("year") == year) & (F.col("quarter") == quarter))
    days = days.select(F.col("date_id").alias("order_date_id"), "month", "month_name")
    return (
        orders.join(F.broadcast(days), "order_date_id")
        .groupBy("month", "month_name", "payment_method_id")
        .agg(F.count(F.lit(1)).alias("order_count"), F.sum("quantity_ordered").alias("quantity_ordered"))
    )


def product_sales(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines and quantity per product, summed before the dimension is joined."""
    sums = lines.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("line_count"), F.sum("quantity").alias("quantity")
    )
    return sums.join(products.select("product_id", "product_name"), "product_id")


def recent_orders(
    orders: DataFrame, customers: DataFrame, methods: DataFrame, limit: int = 10, lines: DataFrame | None = None
) -> DataFrame:
    """The newest orders with customer and payment-method names.

    Orders that do not carry ``num_products`` get it from their ``lines`` (order_id), after the limit.
    """
    o = orders.select("id", "timestamp", "customer_id", "payment_method_id", *(["num_products"] if lines is None else []))
    c = customers.select(F.col("id").alias("customer_id"), "name")
    m = methods.select(F.col("id").alias("payment_method_id"), "method_name")
    newest = (
        o.join(m, "payment_method_id")
        .join(c, "customer_id")
        .orderBy(F.col("timestamp").desc(), F.col("id").desc())
        .limit(limit)
    )
    sized = newest if lines is None else with_sizes(newest, lines)
    return sized.select("id", "timestamp", "name", "method_name", "num_products")


def with_sizes(few: DataFrame, lines: DataFrame) -> DataFrame:
    """A few orders with the number of their lines; only theirs are counted. ``few`` is broadcast."""
    own = lines.join(F.broadcast(few.select(F.col("id").alias("order_id"))), "order_id")
    sizes = own.groupBy(F.col("order_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("num_products"))
    return few.join(sizes, "id", "left")


def latest_order_of(orders: DataFrame, customer_id: int, lines: DataFrame | None = None) -> DataFrame:
    """The newest order of one customer; ``lines`` as above."""
    newest = (
        orders.where(F.col("customer_id") == customer_id)
        .orderBy(F.col("timestamp").desc(), F.col("id").desc())
        .limit(1)
    )
    return newest if lines is None else with_sizes(newest, lines)


def sellable_products(books: DataFrame, limit: int = 1500) -> DataFrame:
    """Products with a title and a price, the first ``limit`` by id."""
    return (
        books.where("title IS NOT NULL AND unit_price IS NOT NULL")
        .select("id", "title", "unit_price")
        .orderBy("id")
        .limit(limit)
    )
