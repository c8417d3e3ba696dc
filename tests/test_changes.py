import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ordermill import schemas
from ordermill.operators import quality
from ordermill.sinks.keyed import KeyedTable
from ordermill.sources.topics import MESSAGE, landed_topic
from ordermill.streaming.envelopes import decode
from ordermill.streaming.replication import (
    judged_changes,
    live_rows,
    merged,
    net_changes,
    replica_schema,
    replicate,
)


def change(op, pos, before=None, after=None, file="bin.000001"):
    def image(value):
        return None if value is None else {"id": value[0], "num_products": value[1]}

    source = {"db": "d", "table": "orders", "file": file, "pos": pos}
    return json.dumps({"payload": {"before": image(before), "after": image(after), "op": op, "source": source}})


def test_net_changes_follow_the_log_not_the_arrival(spark):
    data = [
        (change("u", 20, ("a", 1), ("a", 2)), 1), (change("c", 10, None, ("a", 1)), 2),
        (change("c", 10, None, ("b", 1)), 3), (change("d", 5, ("b", 1), file="bin.000002"), 4),
        (change("d", 10, ("c", 1)), 5), (change("c", 20, None, ("c", 7)), 6), ("{", 7), (None, 8),
    ]
    decoded = decode(spark.createDataFrame(data, MESSAGE), schemas.ORDER_IMAGE)
    judged = judged_changes(decoded, "id")
    net = net_changes(judged, "id")
    assert rows(net, "id", "num_products", "_deleted") == [("a", 2, False), ("b", 1, True), ("c", 7, False)]
    assert rows(judged.where("rejected IS NOT NULL"), "seq", "rejected") == [(7, "corrupt"), (8, "no_key")]
    place = "1L _log, 5L _pos, 0L _seq, false _deleted"
    current = spark.createDataFrame([("b", 1), ("z", 9)], "id STRING, num_products INT").selectExpr(
        "id", "null customer_id", "null store_id", "null payment_method_id", "num_products", "null timestamp", *place.split(", "))
    assert rows(live_rows(merged(current, net, "id")), "id", "num_products") == [("a", 2), ("c", 7), ("z", 9)]


def test_log_files_are_ordered_by_number(spark):
    data = [(change("u", 1, ("a", 1), ("a", 2), file="mysql-bin.1000000"), 1), (change("u", 9, None, ("a", 1), file="mysql-bin.999999"), 2)]
    judged = judged_changes(decode(spark.createDataFrame(data, MESSAGE), schemas.ORDER_IMAGE), "id")
    assert rows(net_changes(judged, "id"), "num_products") == [(2,)]


def test_each_message_is_parsed_once(spark, capsys):
    from ordermill.streaming.envelopes import accepted, order_events

    messages = spark.range(3).selectExpr("CAST(id AS STRING) AS value", "id AS seq")
    accepted(order_events(messages)).explain()
    assert capsys.readouterr().out.count("from_json(") == 1


def replica(spark, folder):
    return KeyedTable(spark, f"{folder}/replica", replica_schema(schemas.ORDER_IMAGE), "id", buckets=8)


def run_stream(spark, folder, table, topic, *messages):
    data = [(m, n) for n, m in enumerate(messages)]
    spark.createDataFrame(data, MESSAGE).coalesce(1).write.mode("append").parquet(f"{folder}/{topic}")
    writer = replicate(landed_topic(spark, f"{folder}/{topic}"), table, schemas.ORDER_IMAGE, f"{folder}/{topic}-checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return rows(live_rows(table.read()), "id", "num_products")


def test_replica_follows_the_stream_over_restarts(spark, folder):
    table = replica(spark, folder)

    def run(*messages):
        return run_stream(spark, folder, table, "in", *messages)

    assert run(change("r", 1, None, ("a", 1)), change("c", 2, None, ("b", 1))) == [("a", 1), ("b", 1)]
    assert run(change("u", 3, ("a", 1), ("a", 5)), change("d", 4, ("b", 1))) == [("a", 5)]
    # what the log had earlier changes nothing, in whatever batch it arrives
    assert run(change("u", 2, None, ("a", 3)), change("u", 3, None, ("b", 7))) == [("a", 5)]
    assert run(change("c", 5, None, ("b", 8))) == [("a", 5), ("b", 8)]


def test_another_stream_goes_on_where_the_first_ended(spark, folder):
    table = replica(spark, folder)
    for n in range(3):
        run_stream(spark, folder, table, "first", change("c", n + 1, None, (f"k{n}", n)))
    got = [run_stream(spark, folder, table, "second", change("c", n + 10, None, (f"n{n}", n)), "{torn") for n in range(3)]
    assert got[-1] == [("k0", 0), ("k1", 1), ("k2", 2), ("n0", 0), ("n1", 1), ("n2", 2)]
    assert rows(spark.read.parquet(table.dead_letters()), "rejected", "value") == [("corrupt", "{torn")] * 3


def keyed(spark, folder):
    return KeyedTable(spark, f"{folder}/t", "k STRING, v INT", "k", buckets=8)


def put(spark, table, data, **batch):
    new = spark.createDataFrame(data, "k STRING, v INT")
    return table.change(new, lambda old: old.join(new, "k", "left_anti").unionByName(new), **batch)


def files(table):
    return set(table.read().inputFiles())


def test_a_change_rewrites_the_buckets_of_its_keys_only(spark, folder):
    table = keyed(spark, folder)
    assert table.read().count() == 0 and not put(spark, table, [])
    put(spark, table, [(f"k{n}", n) for n in range(200)])
    before = files(table)
    assert len(before) == 8
    assert put(spark, table, [("k7", 1000)])
    assert len(files(table) - before) == 1 and len(before - files(table)) == 1
    assert rows(table.read().where("k = 'k7'")) == [("k7", 1000)] and table.read().count() == 200
    part = table.read_for(spark.createDataFrame([("k7",)], "k STRING"))
    assert part.select(F.input_file_name()).distinct().count() == 1


def test_a_batch_is_applied_once_per_stream(spark, folder):
    table = keyed(spark, folder)
    assert put(spark, table, [("s", 1)], stream="one", batch=0)
    assert not put(spark, table, [("s", 2)], stream="one", batch=0)
    assert put(spark, table, [("t", 1)], stream="two", batch=0)
    assert not put(spark, table, [], stream="two", batch=1)
    assert not put(spark, table, [("t", 2)], stream="two", batch=1)
    assert rows(table.read()) == [("s", 1), ("t", 1)]


def test_a_bucket_that_loses_its_last_row_is_gone(spark, folder):
    table = keyed(spark, folder)
    put(spark, table, [(f"k{n}", n) for n in range(50)])
    everything = spark.createDataFrame([(f"k{n}",) for n in range(50)], "k STRING")
    table.change(everything, lambda old: old.where("v < 1"))
    assert rows(table.read()) == [("k0", 0)] and len(files(table)) == 1
    table.change(everything, lambda old: old.where("false"))
    assert table.read().count() == 0


def test_a_writer_that_died_is_taken_up_again(spark, folder, monkeypatch):
    from ordermill.sinks import datasets

    table = keyed(spark, folder)
    put(spark, table, [(f"k{n}", n) for n in range(100)])
    old = rows(table.read())

    def dies(old):
        raise OSError("disk")

    with pytest.raises(OSError):
        table.change(spark.createDataFrame([("k1", 2)], "k STRING, v INT"), dies)
    assert rows(table.read()) == old  # before anything was noted: the old rows

    finish = datasets.finish_replacement

    def dies_within(spark, path):  # folders are taken away, their successors not there yet
        datasets.delete_folder(spark, f"{path}/_bucket=3")
        raise OSError("lost")

    monkeypatch.setattr(datasets, "finish_replacement", dies_within)
    with pytest.raises(OSError):
        put(spark, table, [(f"k{n}", -n) for n in range(100)], stream="s", batch=0)
    monkeypatch.setattr(datasets, "finish_replacement", finish)
    # the stream brings the batch again: the noted rows are put in place, then the batch is applied
    put(spark, table, [(f"k{n}", -n) for n in range(100)], stream="s", batch=0)
    assert rows(table.read()) == sorted([(f"k{n}", -n) for n in range(100)], key=repr)
    datasets.finish_replacement(spark, table.rows)
    assert table.read().count() == 100


# --- two tables along one log ---

def logged(topic, op, log, pos, partition=0, before=None, after=None):
    names = ("id", "num_products") if topic == "orders" else ("order_id", "product_id", "quantity")

    def image(value):
        return None if value is None else dict(zip(names, value))

    source = {"db": "d", "table": topic, "file": f"bin.{log:06d}", "pos": pos}
    return topic, json.dumps({"payload": {"before": image(before), "after": image(after), "op": op, "source": source}}), pos, partition


def joint(spark, folder, batches, partitions=(1, 2)):
    """Both copies after each batch: (orders, details)."""
    from ordermill.streaming.replication import orders_and_details, replicate_jointly

    orders = KeyedTable(spark, f"{folder}/orders", replica_schema(schemas.ORDER_IMAGE), "id", buckets=4)
    details = KeyedTable(spark, f"{folder}/details", replica_schema(schemas.DETAIL_IMAGE), "order_id", buckets=4)
    members, found = orders_and_details(orders, details, partitions), []
    for messages in batches:
        frame = spark.createDataFrame(messages, "topic STRING, value STRING, seq BIGINT, partition INT")
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = replicate_jointly(landed_topic(spark, f"{folder}/in", 1, more="topic STRING"), members, f"{folder}/state", f"{folder}/checkpoint")
        stream.trigger(availableNow=True).start().awaitTermination()
        found.append((rows(live_rows(orders.read()), "id", "num_products"), rows(live_rows(details.read()), "order_id", "product_id", "quantity")))
    return found


def test_copies_stand_at_the_place_that_all_partitions_have_reached(spark, folder):
    batches = [
        [logged("orders", "c", 1, 10, after=("a", 2)), logged("orders", "c", 1, 40, after=("b", 1))],
        [logged("order_details", "c", 1, 11, 0, after=("a", 1, 5))],  # the other partition of the details is not known yet
        [logged("order_details", "c", 1, 12, 1, after=("a", 2, 6)), logged("order_details", "c", 1, 41, 1, after=("b", 9, 1))],
        [logged("order_details", "u", 2, 5, 0, after=("a", 1, 50)), logged("orders", "u", 2, 4, after=("a", 3))],
        [logged("order_details", "d", 2, 6, 1, before=("b", 9, 1)), logged("orders", "d", 2, 7, before=("b", 1))],
        [logged("order_details", "c", 2, 9, 0, after=("a", 3, 1)), logged("order_details", "c", 2, 8, 1, after=("a", 4, 1)),
         logged("orders", "u", 2, 30, after=("a", 4))],
    ]
    got = joint(spark, folder, batches)
    assert got == [
        ([], []),
        ([], []),
        ([("a", 2)], [("a", 1, 5)]),  # the cut is 1/11
        ([("a", 2), ("b", 1)], [("a", 1, 5), ("a", 2, 6), ("b", 9, 1)]),  # 1/41: the partition of b's line has gone no further
        ([("a", 3), ("b", 1)], [("a", 1, 50), ("a", 2, 6), ("b", 9, 1)]),  # 2/5
        ([("a", 3)], [("a", 1, 50), ("a", 2, 6), ("a", 4, 1)]),  # 2/8: both deletions are before it
    ]


def test_a_repeated_batch_and_messages_without_use(spark, folder):
    from ordermill.streaming.replication import Progress

    first = [logged("orders", "c", 1, 10, after=("a", 2)), ("orders", "{torn", 3, 0), logged("orders", "c", 1, 30, after=(None, 2)),
             logged("order_details", "c", 1, 11, 0, after=("a", 1, 5)), logged("order_details", "c", 1, 25, 1, after=("a", None, 5))]
    again = first + [logged("order_details", "c", 1, 31, 0, after=("b", 1, 1))]
    got = joint(spark, folder, [first, again])
    assert got == [([("a", 2)], [("a", 1, 5)])] * 2
    assert spark.read.parquet(f"{folder}/orders/_dead_letters").count() == 4
    progress = Progress({}, None, {})
    progress.advance(0, {"orders/0": [1, 5]}, 2)
    assert progress.cut is None and progress.passed() == []
    progress.advance(1, {"order_details/0": [1, 3]}, 2)
    progress.advance(1, {"order_details/0": [1, 3]}, 2)
    assert progress.cut == [1, 3] and progress.passed() == ["1"]


def test_no_detail_lacks_its_order_at_any_time(spark, folder, monkeypatch):
    """Also between the changes of the two copies."""
    seen = []
    change = KeyedTable.change

    def watched(self, *arguments, **options):
        done = change(self, *arguments, **options)
        known = {r.id for r in live_rows(KeyedTable(spark, f"{folder}/orders", replica_schema(schemas.ORDER_IMAGE), "id", 4).read()).collect()}
        lines = live_rows(KeyedTable(spark, f"{folder}/details", replica_schema(schemas.DETAIL_IMAGE), "order_id", 4).read()).collect()
        seen.append({r.order_id for r in lines} - known)
        return done

    monkeypatch.setattr(KeyedTable, "change", watched)
    joint(spark, folder, [
        [logged("order_details", "c", 1, 11, 0, after=("a", 1, 5)), logged("order_details", "c", 1, 12, 1, after=("a", 2, 5)),
         logged("orders", "c", 1, 10, after=("a", 2)), logged("orders", "c", 1, 50, after=("z", 1))],
        [logged("order_details", "d", 2, 1, 0, before=("a", 1, 5)), logged("order_details", "d", 2, 2, 1, before=("a", 2, 5)),
         logged("orders", "d", 2, 3, before=("a", 2))],
        [logged("order_details", "c", 2, 9, p, after=("z", p, 5)) for p in (0, 1)] + [logged("orders", "u", 2, 9, after=("z", 2))],
    ])
    assert len(seen) == 12 and not any(seen)


def test_quality_checks(spark):
    child = spark.createDataFrame([(1, 10), (1, 99), (2, None), (3, 99)], "id INT, parent INT")
    parent = spark.createDataFrame([(10,)], "id INT")
    report = quality.report([
        quality.not_null(child, "child", ["id", "parent"]),
        quality.unique_key(child, "child", ["id"]),
        quality.foreign_keys(child, "child", {"parent": (parent, "id"), "id": (parent, "id")}),
    ])
    assert rows(report) == [
        ("foreign_key:id", "child", 4), ("foreign_key:parent", "child", 2), ("not_null:id", "child", 0), ("not_null:parent", "child", 1),
        ("unique:id", "child", 1)]
    assert rows(quality.orphan_rows(child, "parent", parent, "id"), "id") == [(1,), (3,)]
    assert rows(quality.row_counts({"child": child})) == [("child", 4)]
    with pytest.raises(quality.EmptyTableError):
        quality.expect_not_empty(child.where(F.lit(False)), "child")


def test_quality_of_empty_tables(spark):
    empty = spark.createDataFrame([], "id INT, parent INT")
    report = quality.report([quality.unique_key(empty, "t", ["id"]), quality.foreign_key(empty, "t", "parent", empty, "id")])
    assert [r.violations for r in report.collect()] == [0, 0]
