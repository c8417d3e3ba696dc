"""The completion stream: two change topics in, completed orders and dead letters out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ordermill.config import ORDER_DETAILS_TOPIC, ORDERS_TOPIC
from ordermill.session import ROCKSDB_PROVIDER, conf_scope
from ordermill.sinks.topics import kafka_sink
from ordermill.sources.topics import kafka_topic
from ordermill.streaming import completion, envelopes


def completion_from_messages(
    orders: DataFrame, details: DataFrame, trigger_on: str = "detail"
) -> tuple[DataFrame, DataFrame]:
    """Streaming frames of completed orders and of unusable messages."""
    judged_orders = envelopes.order_events(orders)
    judged_details = envelopes.detail_events(details)
    completed = completion.completed_orders(
        completion.completion_events(judged_orders, judged_details), trigger_on
    )
    rejected = envelopes.dead_letters(judged_orders).unionByName(envelopes.dead_letters(judged_details))
    return completed, rejected


def run_completion(
    spark: SparkSession, root: str, trigger_on: str = "detail", interval: str = "1 second"
) -> list[StreamingQuery]:
    """Start both queries on Kafka; state, progress and dead letters live under ``root``.

    The Kafka sink may repeat a message after a failure; messages are keyed by order id,
    so a reader can drop repeats. ``completion.start`` writes files exactly once instead.
    """
    completed, rejected = completion_from_messages(
        kafka_topic(spark, ORDERS_TOPIC), kafka_topic(spark, ORDER_DETAILS_TOPIC), trigger_on
    )
    with conf_scope(spark, {"spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER}):
        emit = kafka_sink(completed, f"{root}/checkpoints/completed").trigger(processingTime=interval).start()
    letters = (
        rejected.writeStream.format("parquet")
        .option("path", f"{root}/dead_letters")
        .option("checkpointLocation", f"{root}/checkpoints/dead_letters")
        .trigger(processingTime="1 minute")
        .start()
    )
    return [emit, letters]
