"""Sums kept up to date by differences.

A row that changes takes its old contribution back and adds its new one; a group without rows is dropped. So a
load costs the rows it changes and the groups they are in, not the table the sums are taken over. Sums of sums
are kept the same way: their input changes by the groups that the first level changed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals(rows: DataFrame, group: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sums per group. A null in a measure adds nothing."""
    return rows.groupBy(*group).agg(*[F.coalesce(F.sum(m), F.lit(0)).cast("bigint").alias(m) for m in measures])


def differences(before: DataFrame, after: DataFrame, group: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """What to add to the sums over ``before`` to have those over ``after``; groups that stay as they are have no row."""
    taken = before.select(*group, *[(-F.col(m)).alias(m) for m in measures])
    changed = reduce(Column.__or__, [F.col(m) != 0 for m in measures])
    return totals(taken.unionByName(after.select(*group, *measures)), group, measures).where(changed)


def accumulated(current: DataFrame, changes: DataFrame, group: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """The sums after some differences. The first measure counts rows: a group that has none left is gone."""
    return totals(current.unionByName(changes), group, measures).where(F.col(measures[0]) != 0)
