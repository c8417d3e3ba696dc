"""Bronze order tables stored in buckets by order, and the fact built from them without a shuffle.

Both tables have the same number of buckets of order id. The latest row per (order, product), the sums per order and the
join with the order heads all stand on that layout, so lines are read and counted where they lie. The files of a bucket are one task: buckets
must be many enough that one's share fits a task's disk (rows are sorted there, and spill), and an order with very many
lines makes its bucket that much longer. Bucketed tables are tables of the session's catalogue over files below ``path``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame

from ordermill.plans import gold, silver

#: Rows of a bucket should stay in the millions.
DEFAULT_BUCKETS = 256


def store_by_order(frame: DataFrame, path: str, key: str, buckets: int = DEFAULT_BUCKETS, sort: tuple[str, ...] = ()) -> DataFrame:
    """Write ``frame`` in buckets of ``key``, one file per bucket, and read it back as a table."""
    spark, name = frame.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    dealt = frame.repartition(buckets, key)  # the hash of the buckets, so every task writes one file
    writer = dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key, *sort)
    writer.format("parquet").saveAsTable(name)
    return spark.table(name)


def fact_orders(orders: DataFrame, details: DataFrame, stamp: Column | None = None, ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """The order fact over bronze tables bucketed by order (``id`` of orders, ``order_id`` of details)."""
    heads = silver.clean_orders(orders, stamp)
    lines = silver.clean_order_details(details, stamp, ties=ties)
    return gold.fact_orders(heads, lines, stamp)

