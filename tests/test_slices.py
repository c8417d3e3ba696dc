"""Slices of a topic that a stream takes one after the other, and folders that move."""

from pyspark.sql import functions as F

from conftest import rows
from ordermill.operators.completion import replay_completion
from ordermill.sinks import datasets
from ordermill.sinks.datasets import write_dataset
from ordermill.sinks.keyed import KeyedTable
from ordermill.workload.changes import _in_slices, _in_turn


def test_slices_hold_every_message_once_in_order(spark, folder):
    messages = spark.range(0, 1000, 1, 8).select(F.col("id").cast("string").alias("value"), F.col("id").alias("seq"))
    parts = _in_slices(messages, [100, 400, 400], f"{folder}/slices")
    assert [p.count() for p in parts] == [100, 300, 0, 600]
    assert [p.agg(F.min("seq"), F.max("seq")).first()[:] for p in parts] == [(0, 99), (100, 399), (None, None), (400, 999)]


def test_a_slice_is_landed_by_several_tasks_and_taken_as_one_batch(spark, folder):
    messages = spark.range(0, 400_000, 1, 8).select(F.sha2(F.col("id").cast("string"), 512).alias("value"), F.col("id").alias("seq"))
    parts, sizes, files = _in_slices(messages, [200_000], f"{folder}/slices"), [], []

    def run():
        files.append(len(spark.read.parquet(f"{folder}/in").inputFiles()))
        stream = spark.readStream.schema("value STRING, seq BIGINT").parquet(f"{folder}/in")
        writer = stream.writeStream.foreachBatch(lambda batch, number: sizes.append((number, batch.count())))
        writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    _in_turn(spark, [{f"{folder}/in": part} for part in parts], run)
    assert sizes == [(0, 200_000), (1, 200_000)]
    assert 1 < files[0] < files[1] - 1  # one task each, before


def test_a_change_writes_its_rows_once(spark, folder, monkeypatch):
    """The folders written beside the table are the ones that end up in it: putting them in place runs no job."""
    table = KeyedTable(spark, f"{folder}/table", "k STRING, v INT", "k", buckets=2)
    new = spark.createDataFrame([(f"k{n}", n) for n in range(50)], "k STRING, v INT")
    finish, jobs = datasets.finish_replacement, []

    def counted(*where):
        known = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
        finish(*where)
        jobs.append(len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - known))

    monkeypatch.setattr(datasets, "finish_replacement", counted)
    for _ in range(2):
        table.change(new, lambda old: old.unionByName(new).distinct())
    assert jobs == [0, 0]
    assert rows(table.read()) == sorted(((f"k{n}", n) for n in range(50)), key=repr)


def test_a_load_into_one_folder_is_not_shuffled(spark, folder):
    frame = spark.range(0, 1000, 1, 4).select("id", F.lit(2024).alias("year"))
    assert write_dataset(frame, f"{folder}/t", "overwrite", ("year",), one_folder=True) == 1000
    assert len(spark.read.parquet(f"{folder}/t").inputFiles()) == 4


def test_places_in_cells_are_compared_without_a_lambda(spark):
    orders = spark.createDataFrame([("a", 1, 1, 1, 1)], "order_id STRING, customer_id INT, payment_method_id INT, num_products INT, seq BIGINT")
    details = spark.createDataFrame([("a", 4, 2)], "order_id STRING, product_id INT, seq BIGINT")
    plan = replay_completion(orders, details)
    assert "lambdafunction" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert rows(plan, "order_id", "product_ids") == [("a", ["4"])]


def test_landed_messages_are_small_on_disk(spark, folder):
    import glob

    from pyarrow.parquet import ParquetFile

    messages = spark.range(0, 1000, 1, 2).select(F.col("id").cast("string").alias("value"), F.col("id").alias("seq"))
    _in_turn(spark, [{f"{folder}/in": part} for part in _in_slices(messages, [500], f"{folder}/slices")], lambda: None)
    files = glob.glob(f"{folder}/in/*.parquet") + glob.glob(f"{folder}/slices/*.parquet")
    assert files and {ParquetFile(f).metadata.row_group(0).column(0).compression for f in files if ParquetFile(f).metadata.num_row_groups} == {"ZSTD"}
