"""The stored facts: what a plan reads and shuffles."""

import os
import re
from datetime import date, datetime

from conftest import rows
from pyspark.sql import functions as F

from ordermill.plans import bucketed, gold, reports, silver
from ordermill.sinks.datasets import write_dataset

FACT = "order_id INT, payment_method_id INT, quantity_ordered BIGINT, order_date_id INT"


def test_only_the_folders_of_the_quarter_are_read(spark, folder):
    days = [20240101, 20240315, 20240401, 20240630, 20240701, 20241231]
    fact = spark.createDataFrame([(n, n % 2, n, day) for n, day in enumerate(days * 3)], FACT)
    write_dataset(fact, f"{folder}/fact", partition_by=("order_date_id",))
    write_dataset(gold.dim_date(spark, date(2024, 1, 1), date(2024, 12, 31)), f"{folder}/dates")
    for day in (20240315, 20240701):  # to read these would fail
        for name in os.listdir(f"{folder}/fact/order_date_id={day}"):
            if name.endswith(".parquet"):
                os.remove(f"{folder}/fact/order_date_id={day}/.{name}.crc")
                with open(f"{folder}/fact/order_date_id={day}/{name}", "w") as file:
                    file.write("no parquet")
    star = spark.read.schema(FACT).parquet(f"{folder}/fact"), spark.read.parquet(f"{folder}/dates")
    found = reports.quarter_sales(*star, 2024, 2)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    expected = fact.where("order_date_id BETWEEN 20240401 AND 20240630").withColumn("month", F.expr("order_date_id div 100 % 100").cast("int"))
    counted = expected.groupBy("month", "payment_method_id").agg(F.count("*"), F.sum("quantity_ordered"))
    assert rows(found.drop("month_name")) == rows(counted)


ORDERS = "id BIGINT, customer_id INT, payment_method_id INT, num_products INT, timestamp TIMESTAMP, bronze_ingestion_time TIMESTAMP"
DETAILS = "order_id BIGINT, product_id INT, quantity INT, id INT, bronze_ingestion_time TIMESTAMP"


def test_lines_stored_by_order_are_not_shuffled(spark, folder):
    """Also with an order that has most of the lines."""
    loads = [datetime(2024, 1, 1), datetime(2024, 1, 2)]
    heads = [(n, n, 1, 1, datetime(2024, 3, 1), at) for n in range(40) for at in loads]
    lines = [(0, p, 2, p, loads[0]) for p in range(3_000)] + [(n % 40, n % 7, 1, n, loads[n % 2]) for n in range(800)]
    orders, details = spark.createDataFrame(heads, ORDERS), spark.createDataFrame(lines, DETAILS)
    plain = gold.fact_orders(silver.clean_orders(orders, F.lit(loads[0])), silver.clean_order_details(details, F.lit(loads[0])), F.lit(loads[0]))
    stored = (
        bucketed.store_by_order(orders, f"{folder}/orders", "id", 4),
        bucketed.store_by_order(details, f"{folder}/details", "order_id", 4, ("product_id",)),
    )
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")  # as with tables too large to broadcast
    try:
        fact = bucketed.fact_orders(*stored, F.lit(loads[0]))
        assert rows(fact) == rows(plain)
        plan = fact._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    assert len(re.findall(r"Bucketed: true", plan)) >= 2 and "Exchange" not in plan
    assert len([n for n in os.listdir(f"{folder}/details") if n.endswith(".parquet")]) == 4
