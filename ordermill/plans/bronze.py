"""Bronze layer: the four source tables, ingested incrementally."""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession

from ordermill.config import SOURCE_TABLES, JdbcConnection, Layout, TableSpec
from ordermill.operators.ingest import IngestResult, ingest
from ordermill.sources.csvfiles import read_csv, rejected, usable
from ordermill.sources.relational import ReadSplit, read_table

log = logging.getLogger(__name__)

TableReader = Callable[[str], DataFrame]


def relational_reader(
    spark: SparkSession,
    connection: JdbcConnection | None = None,
    splits: dict[str, ReadSplit] | None = None,
) -> TableReader:
    """Reads tables over JDBC, those in ``splits`` through several connections."""
    return lambda table: read_table(spark, table, connection, (splits or {}).get(table))


def run_bronze(
    read: TableReader,
    layout: Layout,
    load_time: Column | None = None,
    overlap: timedelta | None = None,
) -> dict[str, IngestResult]:
    results = {}
    for spec in SOURCE_TABLES:
        target = layout.bronze_table(spec.name)
        results[spec.name] = ingest(read(spec.name), target, spec, load_time, overlap)
        log.info("bronze %s: %s, %d rows", spec.name, results[spec.name].action, results[spec.name].rows)
    return results


def load_csv(
    spark: SparkSession,
    path: str,
    schema: str,
    spec: TableSpec,
    layout: Layout,
    load_time: Column | None = None,
    multi_line: bool = True,
) -> IngestResult:
    """A CSV file as the source of a bronze table; rows that do not parse go below its dead letters."""
    rows = read_csv(spark, path, schema, multi_line)
    rejected(rows).write.mode("append").parquet(csv_dead_letters(layout, spec))
    return ingest(usable(rows), layout.bronze_table(spec.name), spec, load_time)


def csv_dead_letters(layout: Layout, spec: TableSpec) -> str:
    return f"{layout.bronze}/_dead_letters/csv/{spec.name}"
