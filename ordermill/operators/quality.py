"""Data-quality checks, each a frame ``(check, table, violations)``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EmptyTableError(RuntimeError):
    pass


def expect_not_empty(frame: DataFrame, name: str) -> DataFrame:
    if frame.isEmpty():
        raise EmptyTableError(f"{name} has no rows")
    return frame


def not_null(frame: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Null counts of all columns in one pass."""
    counts = frame.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(
        *[F.struct(F.lit(f"not_null:{c}").alias("check"), F.col(c).alias("violations")) for c in columns]
    )
    return counts.select(F.explode(pairs).alias("p")).select(
        "p.check", F.lit(table).alias("table"), "p.violations"
    )


def unique_key(frame: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key; repeats are counted before the shuffle."""
    sizes = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(
        F.lit(f"unique:{','.join(keys)}").alias("check"), F.lit(table).alias("table"), "violations"
    )


def orphan_rows(child: DataFrame, foreign_key: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-null foreign key has no parent."""
    present = child.where(F.col(foreign_key).isNotNull())
    parents = parent.select(F.col(key).alias(foreign_key))
    return present.join(parents, foreign_key, "left_anti")


def foreign_key(
    child: DataFrame, table: str, foreign_key: str, parent: DataFrame, key: str
) -> DataFrame:
    """Number of orphan rows, joining one row per distinct foreign key."""
    sizes = child.groupBy(foreign_key).agg(F.count(F.lit(1)).alias("n"))
    orphans = orphan_rows(sizes, foreign_key, parent, key)
    return orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
        F.lit(f"foreign_key:{foreign_key}").alias("check"), F.lit(table).alias("table"), "violations"
    )


def foreign_keys(child: DataFrame, table: str, parents: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Orphan rows of several foreign keys, the child read once.

    Every row gives one (column, value) pair per key, counted before the shuffle; what meets the parents is one row
    per distinct value.
    """
    names = list(parents)
    kind = "string"
    pairs = F.array(*[F.struct(F.lit(n).alias("c"), F.col(n).cast(kind).alias("v")) for n in names])
    sizes = child.select(F.explode(pairs).alias("p")).select("p.c", "p.v").where("v IS NOT NULL").groupBy("c", "v").agg(
        F.count(F.lit(1)).alias("n")
    )
    known = reduce(
        DataFrame.unionByName,
        [p.select(F.lit(n).alias("c"), F.col(key).cast(kind).alias("v")) for n, (p, key) in parents.items()],
    )
    orphans = sizes.join(known, ["c", "v"], "left_anti").agg(
        *[F.coalesce(F.sum(F.when(F.col("c") == n, F.col("n"))), F.lit(0)).alias(n) for n in names]
    )
    rows = F.array(*[F.struct(F.lit(f"foreign_key:{n}").alias("check"), F.col(n).alias("violations")) for n in names])
    return orphans.select(F.explode(rows).alias("p")).select("p.check", F.lit(table).alias("table"), "p.violations")


def report(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, row_count)`` of each table."""
    return reduce(
        DataFrame.unionByName,
        [
            frame.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table"), "row_count")
            for name, frame in tables.items()
        ],
    )
