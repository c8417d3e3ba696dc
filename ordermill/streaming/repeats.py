"""Messages that a topic carries once, though its writer may repeat them.

A sink that delivers at least once repeats messages after a failure, and an order may complete anew once its mark has
expired. A repeat within the lifetime of that mark is dropped; one that comes after it is a message of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermill.config import EMITTED_TTL_SECONDS


def once(messages: DataFrame, lifetime_seconds: int = EMITTED_TTL_SECONDS, key: str = "key") -> DataFrame:
    """A stream of messages without repeats of a key within the lifetime; ``seq`` is their time.

    The state holds the keys of the lifetime before the watermark, which lags the newest message by as much. So a repeat is surely dropped
    up to the lifetime, and surely kept if the watermark had passed it in an earlier batch.
    """
    timed = messages.withColumn("_published_at", F.timestamp_micros("seq"))
    waited = timed.withWatermark("_published_at", f"{lifetime_seconds} seconds")
    return waited.dropDuplicatesWithinWatermark([key]).drop("_published_at")
