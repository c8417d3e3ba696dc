"""Keyed upsert with a per-column policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse_batch(
    batch: DataFrame, key: str, order: Sequence[Column], take_last: Sequence[str]
) -> DataFrame:
    """One row per key: last value of the ``take_last`` columns, first of the others.

    This is what inserting the rows one after the other would leave. Both picks are
    aggregates, so repeats of a key shrink before the shuffle.
    """
    take_first = [c for c in batch.columns if c != key and c not in take_last]
    place = F.struct(*order, F.xxhash64(*batch.columns))  # the hash only settles ties
    picked = batch.groupBy(key).agg(
        F.max_by(F.struct(*take_last), place).alias("_last"),
        F.min_by(F.struct(*take_first), place).alias("_first"),
    )
    return picked.select(
        *[
            F.col(c) if c == key else F.col(f"_last.{c}" if c in take_last else f"_first.{c}").alias(c)
            for c in batch.columns
        ]
    )


def upsert(current: DataFrame, incoming: DataFrame, key: str, update: Sequence[str]) -> DataFrame:
    """Rows of both sides; where a key is in both only the ``update`` columns change.

    Each side must hold a key once. Columns of ``current`` that ``incoming`` lacks
    are null in new rows.
    """
    old = current.withColumn("_old", F.lit(True)).alias("old")
    new = incoming.withColumn("_new", F.lit(True)).alias("new")
    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")

    def merged(name: str) -> Column:
        if name not in incoming.columns:
            return F.col(f"old.{name}")
        newest, oldest = F.col(f"new.{name}"), F.col(f"old.{name}")
        if name in update:
            return F.when(F.col("new._new"), newest).otherwise(oldest)
        return F.when(F.col("old._old"), oldest).otherwise(newest)

    return joined.select(*[merged(c).alias(c) for c in current.columns])


def number_rows(frame: DataFrame, key: str, id_column: str, above: int = 0, buckets: int = 8192) -> DataFrame:
    """``(key, id)`` with consecutive ids, from ``above`` + 1, for rows of a unique key.

    Numbers run over hash buckets, then keys, so no task has to see all rows: only the
    counts of the buckets meet in one place. A bucket is sorted in one task: take as many buckets as keep
    its share of ``frame`` (one batch of new keys) in the low millions.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    spread = frame.select(key, bucket.alias("_bucket"))
    sizes = spread.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return (
        spread.withColumn("_place", place)
        .join(offsets, "_bucket")
        .select(key, (F.lit(above).cast("bigint") + F.col("_before") + F.col("_place")).alias(id_column))
    )
