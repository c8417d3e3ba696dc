"""Source columns that come, go or widen between loads.

The schema of all loads is kept beside the data. A load is compared with it by name before anything is written: a new column is
added, a missing one is null in this load, a wider type widens the column, and a narrower or different one is refused. Files stay
as they were written; reading with the kept schema widens the older ones and fills what they lack.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    ByteType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    ShortType,
    StructField,
    StructType,
    TimestampNTZType,
)

from ordermill.sources.datasets import find_dataset, read_text, write_text

SCHEMA_FILE = "_schema"

#: From each type, those that hold all its values and that Parquet files of it can be read as.
WIDER = {
    ByteType: (ShortType, IntegerType, LongType, DoubleType),
    ShortType: (IntegerType, LongType, DoubleType),
    IntegerType: (LongType, DoubleType),
    FloatType: (DoubleType,),
    DateType: (TimestampNTZType,),
}


class NarrowingError(ValueError):
    """A load has columns that the dataset's types do not allow."""


def widens(old: DataType, new: DataType) -> bool:
    if isinstance(old, DecimalType) and isinstance(new, DecimalType):
        return new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
    return type(new) in WIDER.get(type(old), ())


def reconciled(stored: StructType, incoming: StructType) -> StructType:
    """The schema of old and new loads together: stored columns in their order, then new ones."""
    known, refused, fields = {f.name: f for f in incoming}, [], []
    for field in stored:
        new = known.pop(field.name, None)
        if new is None or new.dataType == field.dataType:
            kind = field.dataType
        elif widens(field.dataType, new.dataType):
            kind = new.dataType
        else:
            refused.append(f"{field.name}: {field.dataType.simpleString()} to {new.dataType.simpleString()}")
            continue
        fields.append(StructField(field.name, kind, True))
    if refused:
        raise NarrowingError("; ".join(refused))
    return StructType(fields + [StructField(f.name, f.dataType, True) for f in known.values()])


def kept_schema(spark: SparkSession, path: str) -> StructType | None:
    """The schema of a dataset: the kept one, or that of files written before one was kept; None without a dataset."""
    text = read_text(spark, f"{path}/{SCHEMA_FILE}")
    if text is not None:
        return StructType.fromJson(json.loads(text))
    found = find_dataset(spark, path)
    return None if found is None else found.schema


def keep_schema(spark: SparkSession, path: str, schema: StructType) -> None:
    write_text(spark, f"{path}/{SCHEMA_FILE}", schema.json())


def read_loads(spark: SparkSession, path: str) -> DataFrame:
    """All loads of a dataset under its schema."""
    schema = kept_schema(spark, path)
    return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
