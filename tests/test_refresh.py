"""The refresh job against a rebuild of silver and gold."""

from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ordermill.config import Layout
from ordermill.plans import bronze, gold, increment, maintained, refresh, silver
from ordermill.plans.checks import run_checks

ORDERS = "id STRING, timestamp TIMESTAMP, customer_id INT, payment_method_id INT, num_products INT"
DETAILS = "id INT, order_id STRING, product_id INT, quantity INT"
CUSTOMERS = "id INT, name STRING, phone_number STRING, tier STRING, updated_at TIMESTAMP"
CALENDAR = (date(2024, 1, 1), date(2024, 12, 31))


def day(n, month=1):
    return datetime(2024, month, n)


def sources(spark, step):
    """The source tables as they are at three times."""
    orders = [("a", day(1), 1, 1, 2), ("b", day(1), 2, 2, 1), ("c", day(2), 2, 2, 0)]
    lines = [(1, "a", 7, 2), (2, "a", 8, 1), (3, "b", 7, 1)]
    people = [(1, "A", "1", "gold", day(1)), (2, "B", "2", "base", day(1))]
    if step > 0:  # an order moves to another day and customer, one is new, a line is new, a customer changes segment
        orders += [("b", day(20, 2), 1, 1, 1), ("d", day(21, 2), 9, 1, 1)]
        lines += [(4, "c", 9, 1)]
        people += [(2, "B", "2", "gold", day(3))]
    if step > 1:
        people += [(3, "C", "3", "base", day(5))]
    return {
        "orders": spark.createDataFrame(orders, ORDERS),
        "order_details": spark.createDataFrame(lines, DETAILS),
        "customers": spark.createDataFrame(people, CUSTOMERS),
        "payment_method": spark.createDataFrame([(1, "cash", None)], "id INT, method_name STRING, bank STRING"),
    }


def run(spark, layout, stamp):
    return refresh.run_refresh(spark, layout, stamp, CALENDAR, buckets=4)


@pytest.mark.parametrize("dies", [None, "days", "members"])
def test_refresh_equals_a_rebuild(spark, folder, monkeypatch, dies):
    layout = Layout.under(folder)
    for step in range(3):
        loaded = F.lit(datetime(2024, 6, 1 + step))
        bronze.run_bronze(sources(spark, step).__getitem__, layout, loaded)
        if dies and step == 1:
            with monkeypatch.context() as patch:
                if dies == "days":
                    patch.setattr(refresh, "refresh_fact_orders", lambda *_: 1 / 0)
                else:
                    patch.setattr(refresh.members, "refresh", lambda *_: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    run(spark, layout, loaded)
        found = run(spark, layout, loaded)
        assert run(spark, layout, loaded) == {}
        if step == 1:
            left = [] if dies == "members" else [20240101]  # where b was, which a run that got this far has written
            assert found["days"] == [*left, 20240102, 20240220, 20240221]
            assert found["customers"] == {"new": 0, "changed": 1, "vanished": 0, "equal": 1}
        if step == 2:
            assert found == {"days": [], "customers": {"new": 1, "changed": 0, "vanished": 0, "equal": 2}}

    silver.run_silver(spark, layout, loaded)
    heads, lines = (spark.read.parquet(layout.silver_table(n)) for n in ("orders", "order_details"))
    fact = gold.fact_orders(heads, lines, loaded)
    kept = spark.read.parquet(layout.fact("fact_orders_kept"))
    names = [c for c in fact.columns if c != "fact_created_at"]
    assert rows(kept, *names) == rows(fact, *names)
    customers = gold.dim_customer(spark.read.parquet(layout.silver_table("customers")), loaded)
    months = maintained.customer_months(fact, gold.dim_date(spark, *CALENDAR))
    sums = maintained.SegmentMonths(spark, layout.fact("segment_months"), gold.dim_date(spark, *CALENDAR), 4)
    assert rows(sums.read()) == rows(maintained.segment_months(months, customers).drop("month_id"))
    assert run_checks(spark, layout) == 2  # the customer of order d and the method of b are not known
    assert {r.column for r in spark.read.parquet(f"{layout.silver}/_profiles/orders").collect()} == set(heads.columns)


def test_lines_that_are_stored_already_are_left_out(spark, folder):
    lines = spark.createDataFrame([("a", 1, 2, None), ("a", None, 1, "x"), ("b", 2, 1, "y")], "order_id STRING, product_id INT, quantity INT, note STRING")
    table = increment.silver_table(spark, folder, lines.withColumn("bronze_ingestion_time", F.lit(day(1))), buckets=2)
    increment.apply_load(table, lines.withColumn("bronze_ingestion_time", F.lit(day(1))), ["order_id", "product_id"])
    later = spark.createDataFrame([("a", 1, 2, None), ("a", None, 1, "x"), ("b", 2, 1, None), ("c", 2, 1, "y")], lines.schema)
    found = refresh.not_stored(later.withColumn("bronze_ingestion_time", F.lit(day(2))), table, ("order_id", "product_id"))
    assert rows(found, "order_id", "note") == [("b", None), ("c", "y")]
