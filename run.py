"""Job entry point: ``spark-submit run.py <job> --root <uri>``.

Jobs: bronze, silver, gold, all, refresh, pricing, quality, completion, replicate, books, books-stream, csv.
"""

from __future__ import annotations

import argparse
import logging
from datetime import date, timedelta

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ordermill import schemas
from ordermill.config import CUSTOMERS, ORDER_DETAILS_TOPIC, ORDERS_TOPIC, PAYMENT_METHOD, Layout
from ordermill.plans.books import books_table, run_books
from ordermill.plans.bronze import load_csv, relational_reader, run_bronze
from ordermill.plans.checks import run_checks
from ordermill.plans.gold import CALENDAR_END, CALENDAR_START, run_gold, run_pricing
from ordermill.plans.realtime import run_completion
from ordermill.plans.refresh import run_refresh
from ordermill.plans.silver import run_silver
from ordermill.session import build_session
from ordermill.sinks.keyed import KeyedTable
from ordermill.sources.pages import read_pages, stream_pages
from ordermill.sources.relational import ReadSplit
from ordermill.sources.topics import kafka_topic
from ordermill.streaming.catalogue import ingest_pages
from ordermill.streaming.replication import orders_and_details, replica_schema, replicate_jointly


def split(text: str) -> tuple[str, ReadSplit]:
    """``table:column:lower:upper:partitions``"""
    table, column, lower, upper, partitions = text.split(":")
    return table, ReadSplit(column, lower, upper, int(partitions))


def parse(arguments: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=tuple(JOBS))
    parser.add_argument("--root", help="folder above the layers; default: one bucket per layer")
    parser.add_argument("--split", type=split, action="append", default=[], metavar="TABLE:COLUMN:LOWER:UPPER:PARTITIONS",
                        help="bronze, all: read a table through several connections; LOWER and UPPER without colons")
    parser.add_argument("--overlap-minutes", type=float, help="bronze, all: read this much below the mark again")
    parser.add_argument("--quantity", choices=("constant", "preserve"), default="constant", help="silver, all, refresh")
    parser.add_argument("--normalize-payments", action="store_true", help="gold, all: payment types whatever their case")
    parser.add_argument("--calendar", nargs=2, type=date.fromisoformat, default=(CALENDAR_START, CALENDAR_END),
                        metavar=("FIRST", "LAST"), help="gold, all, refresh")
    parser.add_argument("--pages", help="books, books-stream: folder of landed catalogue pages")
    parser.add_argument("--csv", help="csv: file to load")
    parser.add_argument("--table", choices=tuple(CSV_TABLES), help="csv: table it belongs to")
    parser.add_argument("--single-line", action="store_true", help="csv: no quoted line breaks; files can be shared by tasks")
    parser.add_argument("--topic-partitions", type=int, nargs=2, default=(1, 1), metavar=("ORDERS", "DETAILS"),
                        help="replicate: partitions of the two topics")
    parser.add_argument("--trigger-on", choices=("detail", "both"), default="detail")
    return parser.parse_args(arguments)


def bronze(spark: SparkSession, layout: Layout, options: argparse.Namespace) -> None:
    overlap = None if options.overlap_minutes is None else timedelta(minutes=options.overlap_minutes)
    run_bronze(relational_reader(spark, splits=dict(options.split)), layout, overlap=overlap)


def silver(spark: SparkSession, layout: Layout, options: argparse.Namespace) -> None:
    run_silver(spark, layout, quantity_policy=options.quantity)


def gold(spark: SparkSession, layout: Layout, options: argparse.Namespace) -> None:
    run_gold(spark, layout, calendar=tuple(options.calendar), normalize_payments=options.normalize_payments)


def everything(spark: SparkSession, layout: Layout, options: argparse.Namespace) -> None:
    for job in (bronze, silver, gold):
        job(spark, layout, options)


def refresh(spark: SparkSession, layout: Layout, options: argparse.Namespace) -> None:
    """What changed since the last run, instead of silver and gold anew."""
    run_refresh(spark, layout, calendar=tuple(options.calendar), quantity_policy=options.quantity)


def pricing(spark: SparkSession, layout: Layout, options: argparse.Namespace) -> None:
    run_pricing(spark, layout, catalogue(spark, layout).read())


def quality(spark: SparkSession, layout: Layout, options: argparse.Namespace) -> None:
    run_checks(spark, layout)


def completion(spark: SparkSession, layout: Layout, options: argparse.Namespace) -> None:
    for query in run_completion(spark, layout.bronze, options.trigger_on):
        query.awaitTermination()


def replication(spark: SparkSession, layout: Layout, options: argparse.Namespace) -> None:
    """Orders and details, both at the place in the log that all partitions of their topics have reached."""
    orders, details = (
        KeyedTable(spark, f"{layout.bronze}/replica/{name}", replica_schema(image), key)
        for name, image, key in (("orders", schemas.ORDER_IMAGE, "id"), ("order_details", schemas.DETAIL_IMAGE, "order_id"))
    )
    topics = (ORDERS_TOPIC, ORDER_DETAILS_TOPIC)
    members = orders_and_details(orders, details, tuple(options.topic_partitions))
    streams = [kafka_topic(spark, topic).withColumn("topic", F.lit(name)) for topic, name in zip(topics, members)]
    state = f"{layout.bronze}/replica/_joint"
    writer = replicate_jointly(streams[0].unionByName(streams[1]), members, state, f"{layout.bronze}/checkpoints/replica_joint")
    writer.trigger(processingTime="10 seconds").start().awaitTermination()


def catalogue(spark: SparkSession, layout: Layout) -> KeyedTable:
    return books_table(spark, f"{layout.bronze}/books")


def books(spark: SparkSession, layout: Layout, options: argparse.Namespace) -> None:
    run_books(catalogue(spark, layout), read_pages(spark, options.pages))


def books_stream(spark: SparkSession, layout: Layout, options: argparse.Namespace) -> None:
    """Only pages that landed since the last run."""
    writer = ingest_pages(stream_pages(spark, options.pages), catalogue(spark, layout), f"{layout.bronze}/checkpoints/books")
    writer.trigger(availableNow=True).start().awaitTermination()


def csv(spark: SparkSession, layout: Layout, options: argparse.Namespace) -> None:
    schema, spec = CSV_TABLES[options.table]
    load_csv(spark, options.csv, schema, spec, layout, multi_line=not options.single_line)


CSV_TABLES = {"customers": (schemas.CUSTOMERS, CUSTOMERS), "payment_method": (schemas.PAYMENT_METHOD, PAYMENT_METHOD)}
JOBS = {
    "bronze": bronze,
    "silver": silver,
    "gold": gold,
    "all": everything,
    "refresh": refresh,
    "pricing": pricing,
    "quality": quality,
    "completion": completion,
    "replicate": replication,
    "books": books,
    "books-stream": books_stream,
    "csv": csv,
}


def main(arguments: list[str] | None = None) -> None:
    options = parse(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    layout = Layout.under(options.root) if options.root else Layout()
    spark = build_session(f"ordermill-{options.job}")
    try:
        JOBS[options.job](spark, layout, options)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
