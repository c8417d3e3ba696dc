"""Silver, gold and the maintained sums follow the bronze loads that came since the last run.

Where ``run_silver`` and ``run_gold`` rebuild, this job costs what changed: the silver buckets of the orders and lines in the new loads, the days
of the fact that these orders are or were in, the groups they count in, and the dimension buckets with changed members. Order lines
carry no update time and come in full with each load, so those that silver has already are left out by a digest first.

The job notes the newest load it has taken in. One that died goes through the same loads again under the same number, and
every step either repeats itself harmlessly or knows that it has been done.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.config import Layout
from ordermill.operators import members
from ordermill.operators.drift import read_loads
from ordermill.plans import gold, silver
from ordermill.plans.increment import apply_load, changed_orders, refresh_fact_orders, silver_table
from ordermill.plans.maintained import SegmentMonths
from ordermill.sinks.keyed import DEFAULT_BUCKETS, KeyedTable
from ordermill.sources.datasets import read_text, write_text

log = logging.getLogger(__name__)

LOADED = "bronze_ingestion_time"
#: Columns that differ from load to load without a change of the row.
LOAD_COLUMNS = (LOADED, "silver_processed_time", "year", "month", "day")


def not_stored(rows: DataFrame, stored: KeyedTable, keys: Sequence[str]) -> DataFrame:
    """Rows that the table lacks or has with other values; load columns do not count."""
    own = [c for c in rows.columns if c not in LOAD_COLUMNS and c not in keys]

    def digest(frame: DataFrame) -> Column:
        text = F.to_json(F.struct(*[frame[c] for c in own]), {"ignoreNullFields": "false"})
        return F.md5(text.cast("binary"))

    there = stored.read()
    known = there.select(*[F.col(k).alias(f"_{k}") for k in keys], digest(there).alias("_there"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_here") == F.col("_there")]
    return rows.withColumn("_here", digest(rows)).join(known, same, "left_anti").drop("_here")


def run_refresh(
    spark: SparkSession,
    layout: Layout,
    stamp: Column | None = None,
    calendar: tuple[date, date] = (gold.CALENDAR_START, gold.CALENDAR_END),
    detail_ties: Sequence[str] = ("id",),
    quantity_policy: str = "constant",
    buckets: int = DEFAULT_BUCKETS,
) -> dict[str, object]:
    """Days of the fact that were written, and how the customers changed; empty if no load is new."""
    note = f"{layout.silver}/_refreshed"
    done = json.loads(read_text(spark, note) or '{"load": -1, "until": null}')
    bronze = {name: read_loads(spark, layout.bronze_table(name)) for name in ("orders", "order_details", "customers")}
    newest = F.unix_micros(F.max(LOADED).cast("timestamp"))
    until = max(frame.agg(newest).first()[0] or 0 for frame in bronze.values())
    if done["until"] is not None and until <= done["until"]:
        return {}

    def fresh(name: str) -> DataFrame:
        rows, at = bronze[name], F.unix_micros(F.col(LOADED).cast("timestamp"))
        return rows if done["until"] is None else rows.where((at > done["until"]) & (at <= until))

    heads = silver.clean_orders(fresh("orders"), stamp)
    lines = silver.clean_order_details(fresh("order_details"), stamp, quantity_policy, detail_ties)
    root = f"{layout.silver}/keyed"
    orders = silver_table(spark, f"{root}/orders", heads, buckets=buckets)
    details = silver_table(spark, f"{root}/order_details", lines, buckets=buckets)
    heads, lines = heads.persist(), not_stored(lines, details, ("order_id", "product_id")).persist()
    customers = gold.dim_customer(silver.clean_customers(bronze["customers"], stamp), stamp)
    dimension = members.dimension(spark, layout.dimension("dim_customer_kept"), customers, "customer_id", buckets)

    def apply() -> None:
        apply_load(orders, heads, ["order_id"])
        apply_load(details, lines, ["order_id", "product_id"], detail_ties)

    number = done["load"] + 1
    sums = SegmentMonths(spark, layout.fact("segment_months"), gold.dim_date(spark, *calendar), buckets)
    # A run that died may have moved silver already, and its lines are stored ones now: the load's own files tell its orders.
    changed = sums.ids_of(number, changed_orders([heads, lines]))
    sums.follow(number, orders, details, changed, apply, members.members(dimension), customers)
    days = refresh_fact_orders(layout.fact("fact_orders_kept"), orders, details, changed, stamp)
    counts = members.refresh(dimension, customers, stamp)
    write_text(spark, note, json.dumps({"load": number, "until": until}))
    for frame in (heads, lines):
        frame.unpersist()
    log.info("refresh %d: %d days, customers %s", number, len(days), counts)
    return {"days": days, "customers": counts}
