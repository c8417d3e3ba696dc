"""CSV files with a header, checked against a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT_COLUMN = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Rows as the schema has them and, in ``_corrupt_record``, the text of those that do not fit it.

    Comma-separated, double-quoted; the bare word ``null`` is a missing value. The header must name the
    schema's columns in order, or reading fails. Quoted values may hold line breaks unless ``multi_line`` is
    off, which lets several tasks share a file.
    """
    return (
        spark.read.schema(f"{schema}, {CORRUPT_COLUMN} STRING")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
        .option("header", True)
        .option("enforceSchema", False)
        .option("multiLine", multi_line)
        .option("sep", ",")
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "null")
        .csv(path)
    )


def usable(rows: DataFrame) -> DataFrame:
    return rows.where(f"{CORRUPT_COLUMN} IS NULL").drop(CORRUPT_COLUMN)


def rejected(rows: DataFrame) -> DataFrame:
    """Rows that could not be parsed: their text as ``value``, and what could be made of it.

    Spark reads the text only together with other columns, so write these before selecting from them.
    """
    bad = rows.where(f"{CORRUPT_COLUMN} IS NOT NULL")
    return bad.select(F.col(CORRUPT_COLUMN).alias("value"), F.struct(*[c for c in rows.columns if c != CORRUPT_COLUMN]).alias("parsed"))
