"""Date and time columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ymd_columns(moment: Column) -> dict[str, Column]:
    """Partition columns ``year, month, day`` of a timestamp."""
    return {
        "year": F.year(moment),
        "month": F.month(moment),
        "day": F.dayofmonth(moment),
    }


def date_id(moment: Column) -> Column:
    """``yyyyMMdd`` as an integer, by arithmetic instead of format-and-parse."""
    return F.year(moment) * 10000 + F.month(moment) * 100 + F.dayofmonth(moment)
