"""Landed catalogue pages: one JSON page ``{"start": n, "docs": [...]}`` per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ordermill import schemas


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return _options(spark.read).json(path)


def stream_pages(spark: SparkSession, path: str, max_files_per_batch: int = 1000) -> DataFrame:
    """New page files as a stream; the checkpoint is the resume point."""
    return (
        _options(spark.readStream)
        .option("maxFilesPerTrigger", max_files_per_batch)
        .json(path)
    )


def _options(reader):
    return (
        reader.schema(schemas.CATALOGUE_PAGE)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
    )
