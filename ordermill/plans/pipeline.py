"""All layers in sequence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession

from ordermill.config import Layout
from ordermill.plans.bronze import TableReader, run_bronze
from ordermill.plans.gold import run_gold
from ordermill.plans.silver import run_silver


def run_all(
    spark: SparkSession,
    read: TableReader,
    layout: Layout,
    stamp: Column | None = None,
    detail_ties: Sequence[str] = ("id",),
) -> dict[str, dict[str, int]]:
    """Rows written per layer and table."""
    bronze = run_bronze(read, layout, stamp)
    return {
        "bronze": {name: result.rows for name, result in bronze.items()},
        "silver": run_silver(spark, layout, stamp, detail_ties=detail_ties),
        "gold": run_gold(spark, layout, stamp),
    }
