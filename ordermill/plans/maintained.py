"""Star aggregates that follow the loads.

Orders per month and customer segment are kept on two levels: per (customer, month), and per (month, segment). A load
takes the old contributions of its orders from the silver rows as they were, in the buckets of these orders only, and adds the
new ones; a customer who changes segment moves with all their months. The order fact is not read.

Differences must be applied once. So a load first writes what its orders contributed before, and its differences, below
its number, and the tables note that number with the change: a load that died is run again with the same number and
goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.operators.maintained import accumulated, differences, totals
from ordermill.plans import gold
from ordermill.sinks.keyed import KeyedTable
from ordermill.sources.datasets import delete_folder, folder_exists

MEASURES = ("order_count", "product_count", "quantity_ordered")
CUSTOMER_MONTH = ("customer_id", "year", "month")
SEGMENT_MONTH = ("month_id", "year", "month", "customer_segment")

CUSTOMER_MONTHS = "customer_id BIGINT, year INT, month INT, order_count BIGINT, product_count BIGINT, quantity_ordered BIGINT"
SEGMENT_MONTHS = (
    "month_id INT, year INT, month INT, customer_segment STRING, "
    "order_count BIGINT, product_count BIGINT, quantity_ordered BIGINT"
)
STREAM = "loads"


def customer_months(facts: DataFrame, dates: DataFrame) -> DataFrame:
    months = dates.select(F.col("date_id").alias("order_date_id"), "year", "month")
    counted = facts.join(months, "order_date_id", "left").withColumn("order_count", F.lit(1))
    return totals(counted.withColumn("customer_id", F.col("customer_id").cast("bigint")), CUSTOMER_MONTH, MEASURES)


def segment_months(months: DataFrame, customers: DataFrame) -> DataFrame:
    """Unknown customers count under a null segment, days outside the calendar under a null month."""
    segments = customers.select("customer_id", "customer_segment")
    number = (F.col("year") * 100 + F.col("month")).cast("int")
    return totals(months.join(segments, "customer_id", "left").withColumn("month_id", number), SEGMENT_MONTH, MEASURES)


class SegmentMonths:
    """The two levels below ``path``."""

    def __init__(self, spark: SparkSession, path: str, dates: DataFrame, buckets: int = 256):
        self.spark, self.path, self.dates = spark, path.rstrip("/"), dates
        self.months = KeyedTable(spark, f"{self.path}/customer_months", CUSTOMER_MONTHS, "customer_id", buckets)
        self.segments = KeyedTable(spark, f"{self.path}/segment_months", SEGMENT_MONTHS, "month_id", min(buckets, 64))

    def read(self) -> DataFrame:
        return self.segments.read().drop("month_id")

    def ids_of(self, load: int, changed: DataFrame) -> DataFrame:
        """The orders of a load, as they were when it was first tried."""
        return self._kept(load, "ids", lambda: changed)

    def follow(
        self,
        load: int,
        orders: KeyedTable,
        details: KeyedTable,
        changed: DataFrame,
        apply: Callable[[], object],
        customers_before: DataFrame,
        customers_after: DataFrame,
    ) -> None:
        """Let ``apply`` bring a load into silver and the sums follow.

        ``changed`` has the ids of the orders in the load; the customer frames are the dimension before and after it. Loads are
        numbered one by one; the same load may be repeated until it has gone through.
        """
        def contributions() -> DataFrame:
            mine = [t.read_for(changed).join(changed, "order_id", "left_semi") for t in (orders, details)]
            return customer_months(gold.fact_orders(*mine), self.dates)

        delete_folder(self.spark, f"{self.path}/_loads/{load - 1}")
        changed = changed.persist()
        before = self._kept(load, "before", contributions)
        apply()
        after = self._kept(load, "after", contributions)
        changed.unpersist()
        by_customer = self._kept(load, "by_customer", lambda: differences(before, after, CUSTOMER_MONTH, MEASURES))
        by_segment = self._kept(
            load, "by_segment", lambda: self._segment_differences(by_customer, customers_before, customers_after)
        )
        for table, changes, group in (
            (self.months, by_customer, CUSTOMER_MONTH),
            (self.segments, by_segment, SEGMENT_MONTH),
        ):
            table.change(changes, lambda rows, c=changes, g=group: accumulated(rows, c, g, MEASURES), STREAM, load)

    def _segment_differences(self, by_customer: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
        """From the months of the customers concerned: those with changed sums and those who changed segment."""
        old = before.select("customer_id", F.col("customer_segment").alias("_old"), F.lit(True).alias("_was"))
        new = after.select("customer_id", F.col("customer_segment").alias("_new"), F.lit(True).alias("_is"))
        moved = old.join(new, "customer_id", "full").where("NOT (_old <=> _new AND _was <=> _is)").select("customer_id")
        concerned = by_customer.select("customer_id").unionByName(moved.select(F.col("customer_id").cast("bigint"))).distinct()
        stored = self.months.read_for(concerned)
        ids = concerned.withColumnRenamed("customer_id", "_id")
        was = stored.join(ids, F.col("customer_id").eqNullSafe(F.col("_id")), "left_semi")
        now = accumulated(was, by_customer, CUSTOMER_MONTH, MEASURES)
        return differences(segment_months(was, before), segment_months(now, after), SEGMENT_MONTH, MEASURES)

    def _kept(self, load: int, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A part of a load, written when it is first wanted."""
        path = f"{self.path}/_loads/{load}/{name}"
        if not folder_exists(self.spark, f"{path}/_SUCCESS"):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
