import os
import shutil
from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ordermill.config import CUSTOMERS, ORDER_DETAILS, ORDERS
from ordermill.operators.ingest import MARK_FILE, current_mark, first_present, ingest
from ordermill.sinks.datasets import write_dataset
from ordermill.sources.datasets import dataset_exists, find_dataset, newest_partitions

SCHEMA = "id STRING, timestamp TIMESTAMP, num_products INT"


def load(day):
    return F.lit(datetime(2024, 5, day))


def at(day, hour=0):
    return datetime(2024, 1, day, hour)


def orders(spark, *data):
    return spark.createDataFrame(data, SCHEMA)


def test_missing_target_is_loaded_in_full(spark, folder):
    target = f"{folder}/orders"
    result = ingest(orders(spark, ("a", at(1), 1), ("b", None, 2)), target, ORDERS, load(1))
    assert (result.action, result.rows) == ("full", 2)
    assert rows(spark.read.parquet(target), "id", "bronze_source", "year", "month", "day") == [
        ("a", "mysql.project_db.orders", 2024, 1, 1),
        ("b", "mysql.project_db.orders", None, None, None),
    ]


def test_increment_is_strictly_above_the_mark(spark, folder):
    target = f"{folder}/orders"
    ingest(orders(spark, ("a", at(1), 1), ("b", at(2), 1)), target, ORDERS, load(1))
    later = orders(
        spark, ("a", at(1), 9), ("b", at(2), 9), ("tie", at(2), 1), ("c", at(2, 1), 1), ("d", at(3), 1), ("n", None, 1)
    )
    result = ingest(later, target, ORDERS, load(2))
    assert (result.action, result.rows) == ("increment", 2)
    assert rows(result.frame, "id", "num_products") == [("a", 1), ("b", 1), ("c", 1), ("d", 1)]


def test_overlap_reads_a_margin_again(spark, folder):
    target = f"{folder}/orders"
    ingest(orders(spark, ("a", at(1), 1), ("b", at(2), 1)), target, ORDERS, load(1))
    later = orders(spark, ("a", at(1), 1), ("b", at(2), 1), ("tie", at(2), 1))
    result = ingest(later, target, ORDERS, load(2), overlap=timedelta(hours=1))
    assert rows(result.frame, "id") == [("a",), ("b",), ("b",), ("tie",)]


def test_nothing_new_writes_nothing(spark, folder):
    target = f"{folder}/orders"
    source = orders(spark, ("a", at(1), 1))
    ingest(source, target, ORDERS, load(1))
    before = sorted(spark.read.parquet(target).inputFiles())
    result = ingest(source, target, ORDERS, load(2))
    assert (result.action, result.rows) == ("unchanged", 0)
    assert sorted(spark.read.parquet(target).inputFiles()) == before
    assert rows(result.frame, "id") == [("a",)]


def test_target_with_only_null_times_is_loaded_in_full(spark, folder):
    target = f"{folder}/orders"
    ingest(orders(spark, ("old", None, 1)), target, ORDERS, load(1))
    result = ingest(orders(spark, ("a", at(1), 1), ("b", None, 1)), target, ORDERS, load(2))
    assert (result.action, result.rows) == ("full", 2)
    assert rows(result.frame, "id") == [("a",), ("b",)]


def test_source_without_a_mark_replaces_the_target(spark, folder):
    target = f"{folder}/details"
    source = spark.createDataFrame([(1, "a"), (2, "a")], "id INT, order_id STRING")
    ingest(source, target, ORDER_DETAILS, load(1))
    result = ingest(source.where("id = 2"), target, ORDER_DETAILS, load(2))
    assert (result.action, result.rows) == ("reload", 1)
    assert rows(result.frame, "id", "year", "month", "day") == [(2, 2024, 5, 2)]


def test_customers_are_partitioned_by_load_date(spark, folder):
    target = f"{folder}/customers"
    schema = "id INT, updated_at TIMESTAMP"
    ingest(spark.createDataFrame([(1, at(1))], schema), target, CUSTOMERS, load(1))
    result = ingest(spark.createDataFrame([(1, at(1)), (2, at(4))], schema), target, CUSTOMERS, load(2))
    assert rows(result.frame, "id", "month", "day") == [(1, 5, 1), (2, 5, 2)]


def test_empty_source_leaves_no_readable_target(spark, folder):
    target = f"{folder}/orders"
    source = orders(spark, ("a", at(1), 1)).where("id = 'none'")
    result = ingest(source, target, ORDERS, load(1))
    assert (result.action, result.rows, result.frame.count()) == ("full", 0, 0)
    assert not dataset_exists(spark, target)


def test_mark_column_by_presence(spark):
    frame = spark.createDataFrame([], "updated_at TIMESTAMP, created_at TIMESTAMP")
    assert first_present(frame, ORDERS.high_water_candidates) == "created_at"
    assert first_present(frame, ("timestamp",)) is None


def test_mark_reads_only_the_newest_days(spark, folder):
    target = f"{folder}/orders"
    data = [(str(d), at(d), 1) for d in range(1, 13)]
    ingest(orders(spark, *data), target, ORDERS, load(1))
    leaves = newest_partitions(spark, target, ("year", "month", "day"), 2)
    assert [leaf.rsplit("/", 1)[1] for leaf in leaves] == ["day=12", "day=11"]
    os.remove(f"{target}/{MARK_FILE}")
    assert current_mark(spark, target, "timestamp", ORDERS) == micros(12)


def micros(day):
    return str(int(at(day).replace(tzinfo=timezone.utc).timestamp() * 1_000_000))


def test_a_load_that_dies_in_its_commit_is_read_again(spark, folder):
    """Files of a later day were published, those of an earlier one were not, and the mark was not moved."""
    target = f"{folder}/orders"
    ingest(orders(spark, ("a", at(1), 1)), target, ORDERS, load(1))
    source = orders(spark, ("a", at(1), 1), ("b", at(2), 1), ("c", at(3), 1))
    before = open(f"{target}/{MARK_FILE}").read()
    assert before == f"timestamp={micros(1)}"
    ingest(source, target, ORDERS, load(2))
    shutil.rmtree(f"{target}/year=2024/month=1/day=2")
    open(f"{target}/{MARK_FILE}", "w").write(before)
    shutil.rmtree(f"{target}/.{MARK_FILE}.crc", ignore_errors=True)
    if os.path.exists(f"{target}/.{MARK_FILE}.crc"):
        os.remove(f"{target}/.{MARK_FILE}.crc")
    result = ingest(source, target, ORDERS, load(3))
    assert (result.action, result.rows) == ("increment", 2)
    assert {r.id for r in result.frame.collect()} == {"a", "b", "c"}
    assert open(f"{target}/{MARK_FILE}").read() == f"timestamp={micros(3)}"


def test_rows_of_one_load_day_are_not_sent_to_one_task(spark, folder, capsys):
    """Partition columns taken from the load time are constants; a shuffle on them would have one reducer."""
    frame = spark.range(1000).select("id", F.lit(2024).alias("year"), F.lit(2).alias("month"), F.lit(1).alias("day"))
    frame.hint("rebalance").explain()
    assert "hashpartitioning" not in capsys.readouterr().out
    assert write_dataset(frame, f"{folder}/t", "overwrite", ("year", "month", "day"), one_folder=True) == 1000


def test_ingest_reads_the_target_only_when_asked(spark, folder):
    target = f"{folder}/orders"
    ingest(orders(spark, ("a", at(1), 1)), target, ORDERS, load(1))
    result = ingest(orders(spark, ("a", at(1), 1), ("b", at(2), 1)), target, ORDERS, load(2))
    shutil.rmtree(target)
    assert result.rows == 1


def test_other_read_failures_are_raised(spark, folder):
    path = f"{folder}/broken.parquet"
    with open(path, "w") as handle:
        handle.write("not parquet")
    with pytest.raises(Exception):
        find_dataset(spark, path)


def test_mark_bound_is_pushed_to_the_source(spark, folder, capsys):
    from ordermill.operators.ingest import newer_than

    path = f"{folder}/source"
    orders(spark, ("a", at(1), 1)).write.parquet(path)
    newer_than(spark.read.parquet(path), "timestamp", "1704110400000000").explain()
    plan = capsys.readouterr().out
    assert "GreaterThan(timestamp,2024-01-01" in plan
