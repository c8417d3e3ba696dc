"""Silver and gold brought up to date with new bronze rows only.

Silver tables are keyed tables: a load costs the buckets of the orders in it. The order fact keeps its day
folders: of these only the days that a changed order is in, or was in, are written again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.operators.latest import latest_per_key
from ordermill.plans import gold, silver
from ordermill.sinks.datasets import finish_replacement, replace_partitions, write_dataset
from ordermill.sinks.keyed import KeyedTable
from ordermill.sources.datasets import find_dataset

Clean = Callable[[DataFrame, Column | None], DataFrame]

DAY = "order_date_id"


def silver_table(spark: SparkSession, path: str, rows: DataFrame, key: str = "order_id", **options) -> KeyedTable:
    """A silver table with the columns of ``rows``, in buckets by ``key``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return KeyedTable(spark, path, schema, key, **options)


def apply_load(table: KeyedTable, cleaned: DataFrame, keys: Sequence[str], ties: Sequence[str] = ()) -> bool:
    """Merge the cleaned rows of a load; of a key's rows the one of the newest load stays."""
    order = silver.newest_load_first(cleaned, ties)

    def step(current: DataFrame) -> DataFrame:
        return latest_per_key(current.unionByName(cleaned), list(keys), order)

    return table.change(cleaned, step)


def changed_orders(loads: Sequence[DataFrame]) -> DataFrame:
    """The distinct order ids of some loads."""
    ids = loads[0].select("order_id")
    for load in loads[1:]:
        ids = ids.unionByName(load.select("order_id"))
    return ids.distinct()


def refresh_fact_orders(
    path: str,
    orders: KeyedTable,
    details: KeyedTable,
    changed: DataFrame,
    stamp: Column | None = None,
) -> list[int]:
    """Recompute the changed orders in the fact below ``path``; return the days written.

    Only the silver buckets of the changed orders are read, and of the fact only the days concerned.
    """
    spark = orders.spark
    finish_replacement(spark, path)
    changed = changed.persist()
    try:
        mine = [t.read_for(changed).join(changed, "order_id", "left_semi") for t in (orders, details)]
        fresh = gold.fact_orders(*mine, stamp).persist()
        days = {r[0] for r in fresh.select(DAY).distinct().collect()}  # bounded: one row per day
        fact = find_dataset(spark, path)
        if fact is None:
            write_dataset(fresh, path, "overwrite", (DAY,))
            return sorted(days)
        left = fact.select("order_id", DAY).join(changed, "order_id", "left_semi")
        days |= {r[0] for r in left.select(DAY).distinct().collect()}
        kept = fact.where(F.col(DAY).isin(*days)).join(changed, "order_id", "left_anti") if days else fact.limit(0)
        replace_partitions(kept.select(*fresh.columns).unionByName(fresh), path, DAY, days)
        fresh.unpersist()
        return sorted(days)
    finally:
        changed.unpersist()
