"""Profiles that add up, conversions, columns that drift, members that change."""

from datetime import datetime
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ordermill.config import CUSTOMERS
from ordermill.operators import conversions, drift, members, profile
from ordermill.operators.ingest import ingest
from ordermill.sources.datasets import read_text


def numbers(spark, first, last):
    return spark.range(first, last).select(
        "id", (F.col("id") % 1_000).alias("k"), F.when(F.col("id") % 4 != 0, F.col("id").cast("string")).alias("s"), F.lit(None).cast("int").alias("empty")
    )


def test_merged_profiles_are_those_of_all_rows(spark, folder):
    columns = ["id", "k", "s", "empty"]
    for load, (first, last) in enumerate(((0, 30_000), (20_000, 50_000), (50_000, 50_000))):
        profile.profile(numbers(spark, first, last), columns).write.parquet(f"{folder}/load={load}")
    stored = spark.read.parquet(folder).drop("load")
    found = {r.column: r for r in profile.summary(profile.merged(stored), [0.0, 0.5, 1.0]).collect()}
    assert [(found[c].rows, found[c].nulls) for c in columns] == [(60_000, 0), (60_000, 0), (60_000, 15_000), (60_000, 60_000)]
    for column, distinct in (("id", 50_000), ("k", 1_000), ("s", 37_500), ("empty", 0)):
        assert abs(found[column].distinct_estimate - distinct) <= profile.DISTINCT_BOUND * distinct
    low, middle, high = found["id"].quantiles
    assert (low, high) == (0, 49_999) and abs(middle - 25_000) <= 60_000 * profile.RANK_BOUND
    assert found["s"].quantiles is None and found["empty"].quantiles is None
    assert all(len(r.distinct) < 20_000 for r in profile.merged(stored).collect())


def test_a_load_is_profiled_in_one_pass(spark, folder):
    numbers(spark, 0, 100).write.parquet(f"{folder}/t")
    plan = profile.profile(spark.read.parquet(f"{folder}/t"), ["id", "k", "s"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_conversions_keep_every_row(spark):
    text = spark.createDataFrame(
        [("a", "1", "2024-02-30", "x"), ("b", " 7 ", "2024-02-29", None), ("c", "", None, "y"), ("d", "1x", "soon", "z"), ("e", "99999999999", " ", "")],
        "name STRING, n STRING, day STRING, `odd name` STRING")
    judged = conversions.converted(text, {"n": "int", "day": "date"})
    assert rows(judged.select("name", "n", F.col("day").cast("string"), "odd name")) == [
        ("a", 1, None, "x"), ("b", 7, "2024-02-29", None), ("c", None, None, "y"), ("d", None, None, "z"), ("e", None, None, "")]
    assert rows(conversions.failures(judged, ["name"])) == [
        ("a", "day", "2024-02-30"), ("d", "day", "soon"), ("d", "n", "1x"), ("e", "n", "99999999999")]
    assert rows(conversions.usable(judged), "name") == [("b",), ("c",)]
    assert rows(conversions.conversion_checks(judged, "t", ["n", "day"])) == [("converts:day", "t", 2), ("converts:n", "t", 2)]
    assert conversions.failures(conversions.converted(text.limit(0), {"n": "int"}), ["name"]).count() == 0


def kinds(ddl):
    return StructType.fromDDL(ddl)


def test_schemas_are_reconciled_by_name():
    old = kinds("a INT, b STRING, c DECIMAL(10,2), d FLOAT, e DATE")
    new = kinds("e TIMESTAMP_NTZ, d DOUBLE, f BOOLEAN, c DECIMAL(12,2), a BIGINT")
    assert drift.reconciled(old, new).simpleString() == kinds(
        "a BIGINT, b STRING, c DECIMAL(12,2), d DOUBLE, e TIMESTAMP_NTZ, f BOOLEAN").simpleString()
    for narrower in ("a SMALLINT", "a STRING", "b INT", "c DECIMAL(10,1)", "c DECIMAL(11,4)", "d INT", "e STRING"):
        with pytest.raises(drift.NarrowingError, match=narrower.split()[0]):
            drift.reconciled(old, kinds(narrower))


STAMPS = [datetime(2024, 1, d) for d in (1, 2, 3, 4)]


def test_loads_whose_columns_drift_are_read_together(spark, folder):
    def load(data, schema, day):
        frame = spark.createDataFrame([(*r, STAMPS[day]) for r in data], f"{schema}, updated_at TIMESTAMP")
        return ingest(frame, f"{folder}/t", CUSTOMERS, F.lit(STAMPS[day]))

    load([(1, "a", Decimal("1.50"))], "id INT, name STRING, sum DECIMAL(5,2)", 0)
    before = read_text(spark, f"{folder}/t/_schema")
    with pytest.raises(drift.NarrowingError):
        load([("x", "b")], "id STRING, name STRING", 1)
    assert read_text(spark, f"{folder}/t/_schema") == before and spark.read.parquet(f"{folder}/t").count() == 1
    load([(5_000_000_000, True)], "id BIGINT, vip BOOLEAN", 1)
    found = load([(7, "c", Decimal("12345678.25"))], "id BIGINT, name STRING, sum DECIMAL(12,2)", 2)
    assert found.action == "increment"
    expected = [(1, "a", Decimal("1.50"), None), (7, "c", Decimal("12345678.25"), None), (5_000_000_000, None, None, True)]
    assert rows(found.frame, "id", "name", "sum", "vip") == sorted(expected, key=repr)
    assert load([(7, "c", Decimal("1.00"))], "id BIGINT, name STRING, sum DECIMAL(12,2)", 2).action == "unchanged"
    # a dataset from before schemas were kept
    from ordermill.sources.datasets import delete_folder

    delete_folder(spark, f"{folder}/t/_schema")
    spark.createDataFrame([(1, STAMPS[0])], "id BIGINT, updated_at TIMESTAMP").selectExpr(
        "*", "updated_at bronze_ingestion_time", "'s' bronze_source", "2024 year", "1 month", "1 day").write.partitionBy("year", "month", "day").parquet(f"{folder}/old")
    ingest(spark.createDataFrame([(2, 3, STAMPS[1])], "id BIGINT, n INT, updated_at TIMESTAMP"), f"{folder}/old", CUSTOMERS, F.lit(STAMPS[1]))
    assert rows(drift.read_loads(spark, f"{folder}/old"), "id", "n") == [(1, None), (2, 3)]


MEMBERS = "customer_id BIGINT, name STRING, tier STRING"


def test_only_changed_members_are_written(spark, folder):
    first = spark.createDataFrame([(n, f"n{n}", None if n % 5 == 0 else "A") for n in range(40)], MEMBERS)
    table = members.dimension(spark, folder, first, "customer_id", buckets=8)
    at = [F.lit(s) for s in STAMPS]
    assert members.refresh(table, first, at[0]) == {"new": 40, "changed": 0, "vanished": 0, "equal": 0}
    files = set(table.read().inputFiles())
    assert members.refresh(table, first, at[1]) == {"new": 0, "changed": 0, "vanished": 0, "equal": 40}
    assert set(table.read().inputFiles()) == files
    # 5 takes the value of its null: told apart from 6, which loses its own
    second = first.where("customer_id != 7").withColumn(
        "tier", F.expr("CASE customer_id WHEN 5 THEN 'A' WHEN 6 THEN NULL ELSE tier END")).unionByName(
        spark.createDataFrame([(100, "new", "B")], MEMBERS))
    assert members.refresh(table, second, at[2]) == {"new": 1, "changed": 2, "vanished": 1, "equal": 37}
    assert len(files & set(table.read().inputFiles())) >= 4
    found = {r.customer_id: r for r in members.members(table).collect()}
    assert set(found) == set(range(40)) - {7} | {100}
    assert (found[5].tier, found[6].tier) == ("A", None)
    assert [(found[n].dim_created_at, found[n].dim_updated_at) for n in (1, 5, 100)] == [
        (STAMPS[0], STAMPS[0]), (STAMPS[0], STAMPS[2]), (STAMPS[2], STAMPS[2])]
    # a member that comes back is new
    assert members.refresh(table, first, at[3])["new"] == 1
