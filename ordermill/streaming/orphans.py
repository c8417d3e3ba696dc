"""Order lines whose order does not come, found in the stream.

An outer join of the two topics on event time: a line waits in the state until an order of its id comes
whose time lies within the bound, before or after; once both topics have passed the last time at which that could
be, the line comes out, once, as an orphan. Both watermarks bound the state: it holds the lines and orders of twice the bound
plus the lateness allowed, whatever the length of the stream. A topic that stands still holds the other back.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermill.session import ROCKSDB_PROVIDER, conf_scope
from ordermill.streaming.envelopes import accepted


def orphans(orders: DataFrame, details: DataFrame, bound: timedelta, lateness: timedelta) -> DataFrame:
    """Lines without an order from ``bound`` before to ``bound`` after them.

    ``orders`` and ``details`` are judged messages; ``seq`` is their time. ``lateness`` is how far a message of a topic may come behind
    the latest one of that topic; later ones are not considered. Columns: order_id, product_id, quantity, seen_at.
    """
    delay = f"{int(lateness.total_seconds())} seconds"
    span = F.expr(f"INTERVAL {int(bound.total_seconds())} SECOND")
    moment = F.timestamp_micros("seq")
    heads = accepted(orders).select(F.col("after.id").alias("_id"), moment.alias("_ordered_at")).withWatermark("_ordered_at", delay)
    lines = accepted(details).select("after.order_id", "after.product_id", "after.quantity", moment.alias("seen_at"))
    lines = lines.withWatermark("seen_at", delay)
    near = F.col("_ordered_at").between(F.col("seen_at") - span, F.col("seen_at") + span)
    joined = lines.join(heads, (F.col("order_id") == F.col("_id")) & near, "left_outer")
    return joined.where("_id IS NULL").select("order_id", "product_id", "quantity", "seen_at")


def run_available(orphaned: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what has arrived so far; return all orphans known by now."""
    spark = orphaned.sparkSession
    with conf_scope(spark, {"spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER}):
        writer = orphaned.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(orphaned.schema).parquet(path)
