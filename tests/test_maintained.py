"""Sums kept by differences against sums taken anew."""

import random
from datetime import date, datetime

import pytest
from conftest import rows

from ordermill.operators.maintained import accumulated, differences, totals
from ordermill.plans import gold, increment, maintained
from ordermill.sinks.keyed import KeyedTable

ORDERS = "order_id BIGINT, customer_id BIGINT, payment_method_id INT, num_products INT, timestamp TIMESTAMP, bronze_ingestion_time TIMESTAMP"
DETAILS = "order_id BIGINT, product_id BIGINT, quantity INT, id INT, bronze_ingestion_time TIMESTAMP"
CUSTOMERS = "customer_id BIGINT, customer_segment STRING"
CALENDAR = (date(2024, 1, 1), date(2024, 6, 30))


def test_differences_lead_from_one_table_to_the_other(spark):
    draw = random.Random(1)
    shape = "g STRING, n BIGINT, v BIGINT"

    def table():
        return spark.createDataFrame([(draw.choice(["a", "b", "c", None]), 1, draw.randint(-3, 3)) for _ in range(12)], shape)

    def sums(frame):
        return totals(frame, ["g"], ["n", "v"])

    for _ in range(4):
        before, after = table(), table()
        changes = differences(before, after, ["g"], ["n", "v"])
        assert rows(accumulated(sums(before), changes, ["g"], ["n", "v"])) == rows(sums(after))
    nothing = differences(before, before, ["g"], ["n", "v"])
    assert nothing.count() == 0
    assert accumulated(sums(before), differences(before, before.limit(0), ["g"], ["n", "v"]), ["g"], ["n", "v"]).count() == 0


def loads(spark):
    """Three loads of orders and lines; later ones move orders between days, customers and out of the calendar."""
    draw = random.Random(2)
    found = []
    for load in range(3):
        at = datetime(2025, 1, 1 + load)
        ids = draw.sample(range(60), 40 if load == 0 else 12)
        heads = [(i, draw.choice([1, 2, 3, 9, None]), 1, 2, datetime(2024, draw.randint(1, 8), draw.randint(1, 28)), at) for i in ids]
        lines = {(draw.randint(0, 59), draw.randint(1, 5)) for _ in range(80 if load == 0 else 15)}
        items = [(i, p, draw.randint(1, 4), n, at) for n, (i, p) in enumerate(sorted(lines))]
        found.append((spark.createDataFrame(heads, ORDERS), spark.createDataFrame(items, DETAILS)))
    return found


def segments(spark, load):
    named = {1: "A", 2: "B" if load % 2 else "A", 3: "C"} | ({9: "D"} if load > 1 else {})
    return spark.createDataFrame(list(named.items()), CUSTOMERS)


def table(spark, folder, frame, name):
    return increment.silver_table(spark, f"{folder}/{name}", frame, buckets=4)


@pytest.mark.parametrize("dies_at", [None, "apply", "by_segment", "segments"])
def test_sums_follow_every_load(spark, folder, monkeypatch, dies_at):
    """Also if a load dies in one of its steps and is run again."""
    dates = gold.dim_date(spark, *CALENDAR)
    found = loads(spark)
    orders, details = table(spark, folder, found[0][0], "orders"), table(spark, folder, found[0][1], "details")
    kept = maintained.SegmentMonths(spark, f"{folder}/sums", dates, buckets=4)
    for load, (heads, items) in enumerate(found):
        changed = increment.changed_orders([heads, items])

        def apply():
            increment.apply_load(orders, heads, ["order_id"])
            if dies_at == "apply" and load == 2 and not tried:
                raise OSError("lost")
            increment.apply_load(details, items, ["order_id", "product_id"], ("id",))

        def follow():
            kept.follow(load, orders, details, changed, apply, segments(spark, load - 1), segments(spark, load))

        tried = False
        if load == 2 and dies_at:
            with monkeypatch.context() as patch:
                if dies_at == "by_segment":
                    patch.setattr(kept, "_segment_differences", lambda *_: 1 / 0)
                elif dies_at == "segments":
                    change = KeyedTable.change
                    patch.setattr(KeyedTable, "change", lambda self, *a: 1 / 0 if self is kept.segments else change(self, *a))
                with pytest.raises((OSError, ZeroDivisionError)):
                    follow()
        tried = True
        follow()
        if load == 2:
            follow()  # once more changes nothing
    months = maintained.customer_months(gold.fact_orders(orders.read(), details.read()), dates)
    assert rows(kept.months.read()) == rows(months)
    assert rows(kept.read()) == rows(maintained.segment_months(months, segments(spark, load)).drop("month_id"))
    assert kept.read().where("customer_segment IS NULL").count() > 0 and kept.read().where("month IS NULL").count() > 0
