"""Latest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(
    frame: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]
) -> DataFrame:
    """One row per key, the first in ``newest_first`` order.

    Give enough order columns to leave no ties, or the survivor is arbitrary.
    ``row_number() = 1`` is planned with a group limit below the shuffle, so each
    map task sends at most one row per key however often the key occurs.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))
    return frame.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
