"""High-water-mark ingestion into a partitioned Parquet dataset."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampType

from ordermill.config import TableSpec
from ordermill.functions.calendar import ymd_columns
from ordermill.operators.drift import keep_schema, kept_schema, read_loads, reconciled
from ordermill.sinks.datasets import YMD, write_measured
from ordermill.sources.datasets import find_dataset, holds_files, newest_partitions, read_text, write_text


MARK_FILE = "_mark"


@dataclass(frozen=True)
class IngestResult:
    action: str  # full | increment | unchanged | reload
    rows: int
    read: Callable[[], DataFrame]

    @property
    def frame(self) -> DataFrame:
        """The target as it is now; listed and read only when asked for."""
        return self.read()


def first_present(frame: DataFrame, candidates: tuple[str, ...]) -> str | None:
    return next((name for name in candidates if name in frame.columns), None)


def add_load_columns(source: DataFrame, spec: TableSpec, load_time: Column) -> DataFrame:
    """Load time, source label and the year/month/day partition columns."""
    partition_column = first_present(source, spec.partition_candidates)
    moment = load_time if partition_column is None else F.col(partition_column)
    return source.withColumns(
        {
            "bronze_ingestion_time": load_time,
            "bronze_source": F.lit(spec.source_label),
            **ymd_columns(moment),
        }
    )


def _text(moment: Column, kind: DataType) -> Column:
    """A mark as text that reads the same in any time zone."""
    return (F.unix_micros(moment) if isinstance(kind, TimestampType) else moment).cast("string")


def _literal(text: str, kind: DataType) -> Column:
    return F.timestamp_micros(F.lit(int(text))) if isinstance(kind, TimestampType) else F.lit(text).cast(kind)


def current_mark(spark: SparkSession, path: str, mark: str, spec: TableSpec) -> str | None:
    """Largest value of the mark column, as text; None when there is none.

    The last finished load has left it beside the data. Where none has, it is taken from the
    data: from the two newest days if the partitions are days of the mark itself (two, so that a changed
    session time zone cannot hide the largest value), from one column of the dataset otherwise.
    """
    recorded = read_text(spark, f"{path}/{MARK_FILE}")
    if recorded is not None:
        name, _, value = recorded.partition("=")
        if name == mark:
            return value or None
    leaves = newest_partitions(spark, path, YMD, 2)
    scope = None
    if leaves:
        scope = spark.read.option("basePath", path).parquet(*leaves)
        if first_present(scope, spec.partition_candidates) != mark:
            scope = None
    scope = find_dataset(spark, path) if scope is None else scope
    if scope is None or mark not in scope.columns:
        return None
    return scope.agg(_text(F.max(mark), scope.schema[mark].dataType)).first()[0]


def newer_than(source: DataFrame, mark: str, value: str, overlap: timedelta | None = None) -> DataFrame:
    """Rows strictly above the mark; with ``overlap`` a margin below it is read again.

    The bound is a literal of the column's own type, so it reaches the source.
    """
    bound = _literal(value, source.schema[mark].dataType)
    if overlap is None:
        return source.where(F.col(mark) > bound)
    margin = F.make_dt_interval(secs=F.lit(overlap.total_seconds()).cast("decimal(18,6)"))
    return source.where(F.col(mark) >= bound - margin)


def ingest(
    source: DataFrame,
    path: str,
    spec: TableSpec,
    load_time: Column | None = None,
    overlap: timedelta | None = None,
) -> IngestResult:
    """Bring ``path`` up to date with ``source``.

    Missing target, or one without any mark value: full load. Source with a mark
    column: append the rows above the target's largest mark. Source without one:
    reload everything. A load may bring new columns, lack old ones or widen some (``drift``).
    """
    spark = source.sparkSession
    load_time = F.current_timestamp() if load_time is None else load_time
    mark = first_present(source, spec.high_water_candidates)
    exists = holds_files(spark, path)

    rows, action, value = source, "full", None
    if exists and mark is None:
        action = "reload"
    elif exists:
        value = current_mark(spark, path, mark, spec)
        if value is not None:
            rows, action = newer_than(source, mark, value, overlap), "increment"

    loaded = add_load_columns(rows, spec, load_time)
    # Refuses a load that does not fit before anything is written.
    schema = loaded.schema if action in ("full", "reload") else reconciled(kept_schema(spark, path), loaded.schema)
    mode = "append" if action == "increment" else "overwrite"
    measures = {} if mark is None else {"mark": _text(F.max(mark), source.schema[mark].dataType)}
    # Partitioned by the load time, all rows of a load fall into one folder.
    one_folder = first_present(source, spec.partition_candidates) is None
    # An empty increment adds no file, so the source is not probed before the write.
    seen = write_measured(loaded, path, mode, YMD, one_folder, **measures)
    if action != "increment" or seen["rows"]:
        keep_schema(spark, path, schema)
    if mark is not None:
        # Only a finished write moves the mark: a load that dies half-way is read again from the old one,
        # and what it has left twice is one row per key again in silver.
        newest = seen["mark"] if action != "increment" or seen["rows"] else value
        write_text(spark, f"{path}/{MARK_FILE}", f"{mark}={value if newest is None else newest}" if newest or value else f"{mark}=")
    if action == "increment" and seen["rows"] == 0:
        action = "unchanged"

    def read() -> DataFrame:
        # Read back: the caller's next step must not run the source query again.
        return loaded.limit(0) if find_dataset(spark, path) is None else read_loads(spark, path)

    return IngestResult(action, seen["rows"], read)
