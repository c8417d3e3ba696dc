"""Publishing rows as JSON messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ordermill.config import COMPLETED_TOPIC, KAFKA_BROKERS


def as_messages(frame: DataFrame, key: str) -> DataFrame:
    """``key, value``: the whole row as JSON, keyed so that repeats can be compacted."""
    return frame.select(
        F.col(key).cast("string").alias("key"),
        F.to_json(F.struct(*frame.columns)).alias("value"),
    )


def kafka_sink(
    frame: DataFrame,
    checkpoint: str,
    topic: str = COMPLETED_TOPIC,
    brokers: Sequence[str] = KAFKA_BROKERS,
    key: str = "order_id",
) -> DataStreamWriter:
    return (
        as_messages(frame, key)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", ",".join(brokers))
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )
