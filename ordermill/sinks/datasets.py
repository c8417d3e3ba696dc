"""Parquet writers that count what they write in the same pass."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ordermill.session import conf_scope
from ordermill.sources.datasets import delete_folder, move_folder, read_text, write_text

YMD = ("year", "month", "day")


def write_dataset(
    frame: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition_by: tuple[str, ...] = (),
    one_folder: bool = False,
    only_partitions: bool = False,
) -> int:
    """Write and return the row count, without running the plan a second time."""
    return write_measured(frame, path, mode, partition_by, one_folder, only_partitions)["rows"]


def write_measured(
    frame: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition_by: tuple[str, ...] = (),
    one_folder: bool = False,
    only_partitions: bool = False,
    **measures: Column,
) -> dict:
    """Write and return ``rows`` and further aggregates of what was written.

    Partitioned writes are rebalanced on the partition columns: rows of a folder
    meet in one task (one file), while a folder holding a large share of the rows is
    split by AQE into pieces of the advisory size. Small shuffle partitions are not merged there: that
    would not save a file, only put many folders into one task. ``one_folder`` says that all rows have the same
    partition values: they are then written where they are, one file per task, since a shuffle would move every row and save no folder.
    ``only_partitions`` overwrites the folders that have rows and leaves the others.
    """
    seen = Observation()
    spread, settings = frame, {}
    if partition_by and not one_folder:
        spread = frame.hint("rebalance", *[F.col(c) for c in partition_by])
        settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    # Observed on top: below the hint an empty plan would lose the metric.
    writer = spread.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in measures.items()]).write.mode(mode)
    writer = writer.option("partitionOverwriteMode", "dynamic" if only_partitions else "static")
    with conf_scope(frame.sparkSession, settings):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return seen.get


def replace_partitions(frame: DataFrame, path: str, column: str, replaced: Iterable[int]) -> None:
    """Put the rows of ``frame`` in the place of the folders ``column=value`` for the values ``replaced``.

    The frame may be built from what is below ``path``; all its rows have one of the values, and a value that
    it has no row of loses its folder. The rows are written beside the dataset first and noted as due; a
    writer that dies in the overwrite leaves that note, and ``finish_replacement`` does it again.
    """
    spark, staged = frame.sparkSession, f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    filled = set()
    if write_dataset(frame, staged, partition_by=(column,)):
        filled = {row[0] for row in spark.read.parquet(staged).select(column).distinct().collect()}  # folder names only
    note = {"staged": staged if filled else None, "column": column, "filled": sorted(filled), "emptied": sorted(set(replaced) - filled)}
    write_text(spark, _due(path), json.dumps(note))
    finish_replacement(spark, path)


def finish_replacement(spark: SparkSession, path: str) -> None:
    """Do a noted replacement, if there is one; again changes nothing."""
    found = read_text(spark, _due(path))
    if found is None:
        return
    note = json.loads(found)
    for value in note.get("filled") or []:  # the rows are written once: a folder moves as it lies, one that has moved is not there any more
        move_folder(spark, f"{note['staged']}/{note['column']}={value}", f"{path}/{note['column']}={value}")
    for value in note["emptied"]:
        delete_folder(spark, f"{path}/{note['column']}={value}")
    delete_folder(spark, _due(path))
    if note["staged"]:
        delete_folder(spark, note["staged"])


def _due(path: str) -> str:
    return f"{path.rstrip('/')}-due"
