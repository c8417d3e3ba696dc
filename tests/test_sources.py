import pytest
from conftest import rows

from ordermill import schemas
from ordermill.config import CUSTOMERS, PAYMENT_METHOD, JdbcConnection, Layout
from ordermill.sinks.topics import as_messages
from ordermill.plans.bronze import csv_dead_letters, load_csv
from ordermill.sources.csvfiles import read_csv, usable
from ordermill.sources.relational import ReadSplit, jdbc_options
from ordermill.sources.topics import kafka_options


def test_csv_schema_by_position_quotes_and_null_word(spark, folder):
    path = f"{folder}/payment.csv"
    with open(path, "w") as handle:
        handle.write('id,method_name,bank\n1,cash,null\n2,"bank, transfer",ACB\n')
    frame = read_csv(spark, path, schemas.PAYMENT_METHOD)
    assert rows(usable(frame)) == [(1, "cash", None), (2, "bank, transfer", "ACB")]
    # no update time: a second load replaces the first, where silver reads
    layout = Layout.under(f"{folder}/lake")
    for _ in range(2):
        load_csv(spark, path, schemas.PAYMENT_METHOD, PAYMENT_METHOD, layout)
    assert spark.read.parquet(layout.bronze_table("payment_method")).count() == 2


def test_csv_rows_that_do_not_fit_are_set_aside(spark, folder):
    path, layout = f"{folder}/customers.csv", Layout.under(f"{folder}/lake")
    with open(path, "w") as handle:
        handle.write('id,name,phone_number,tier,updated_at\n1,"A\nB",01,gold,2024-01-01 10:00:00\nxx,C,02,gold,2024-01-01 10:00:00\n')
    result = load_csv(spark, path, schemas.CUSTOMERS, CUSTOMERS, layout)
    assert rows(result.frame, "id", "name") == [(1, "A\nB")]
    assert rows(spark.read.parquet(csv_dead_letters(layout, CUSTOMERS)), "value") == [("xx,C,02,gold,2024-01-01 10:00:00",)]
    # a header in another order is refused instead of being read by position
    with open(path, "w") as handle:
        handle.write("name,id,phone_number,tier,updated_at\nA,1,01,gold,2024-01-01 10:00:00\n")
    with pytest.raises(Exception, match="(?i)header"):
        load_csv(spark, path, schemas.CUSTOMERS, CUSTOMERS, layout)


def test_csv_customers(spark, folder):
    path = f"{folder}/customers.csv"
    with open(path, "w") as handle:
        handle.write("id,name,phone_number,tier,updated_at\n1,A,0123,gold,2024-01-01 10:00:00\n")
    (row,) = read_csv(spark, path, schemas.CUSTOMERS).collect()
    assert (row.id, row.phone_number, row.updated_at.hour) == (1, "0123", 10)


def test_connection_from_environment(monkeypatch):
    for name in ("MYSQL_HOST", "MYSQL_USER", "MYSQL_PASSWORD", "MYSQL_DATABASE"):
        monkeypatch.delenv(name, raising=False)
    with pytest.raises(KeyError):
        JdbcConnection.from_env()
    monkeypatch.setenv("MYSQL_PASSWORD", "secret")
    assert JdbcConnection.from_env().url == "jdbc:mysql://mysql:3306/project_db"
    monkeypatch.setenv("MYSQL_HOST", "db")
    monkeypatch.setenv("MYSQL_DATABASE", "shop")
    connection = JdbcConnection.from_env()
    assert connection.url == "jdbc:mysql://db:3306/shop"
    assert "secret" not in repr(connection)


def test_jdbc_options_with_and_without_split():
    connection = JdbcConnection("jdbc:x", "u", "p", "d")
    assert jdbc_options(connection, "orders")["dbtable"] == "orders"
    split = jdbc_options(connection, "orders", ReadSplit("timestamp", "2024-01-01", "2025-01-01", 16))
    assert (split["partitionColumn"], split["numPartitions"]) == ("timestamp", "16")


def test_kafka_options_start_at_the_beginning_and_are_bounded():
    options = kafka_options("t", ("a:1", "b:2"), 10)
    assert options["kafka.bootstrap.servers"] == "a:1,b:2"
    assert (options["startingOffsets"], options["maxOffsetsPerTrigger"]) == ("earliest", "10")


def test_messages_are_keyed_json(spark):
    frame = spark.createDataFrame([("o1", "7", "1", ["2", "3"])], schemas.COMPLETED_ORDER)
    assert rows(as_messages(frame, "order_id")) == [
        ("o1", '{"order_id":"o1","customer_id":"7","payment_method_id":"1","product_ids":["2","3"]}')]


def test_jobs_pass_their_options_on():
    import run

    options = run.parse(["bronze", "--split", "orders:timestamp:2024-01-01:2025-01-01:16", "--overlap-minutes", "30"])
    assert dict(options.split)["orders"] == ReadSplit("timestamp", "2024-01-01", "2025-01-01", 16)
    assert options.overlap_minutes == 30
    options = run.parse(["gold", "--calendar", "1995-01-01", "2001-12-31", "--normalize-payments"])
    assert options.calendar[1].year == 2001 and options.normalize_payments
    assert set(run.JOBS) >= {"replicate", "books-stream", "quality", "pricing", "csv"}
