"""Typed columns from text, with what does not convert set aside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAILED = "_failed"


def converted(frame: DataFrame, types: dict[str, str]) -> DataFrame:
    """``frame`` with text columns as other types, and in ``_failed`` the columns and texts that were none; those are null.

    A null or empty text is a null, not a failure. One pass; no row is lost.
    """
    def text(name: str):
        return F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))

    failures = [
        F.when(
            text(name).isNotNull() & text(name).try_cast(kind).isNull(),
            F.struct(F.lit(name).alias("column"), F.col(f"`{name}`").alias("text")),
        )
        for name, kind in types.items()
    ]
    columns = [text(c).try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in frame.columns]
    return frame.select(*columns, F.array_compact(F.array(*failures)).alias(FAILED))


def usable(judged: DataFrame) -> DataFrame:
    """Rows all of whose columns converted."""
    return judged.where(F.size(FAILED) == 0).drop(FAILED)


def failures(judged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per failed conversion: the row's keys, ``column`` and ``text``."""
    return judged.where(F.size(FAILED) > 0).select(*keys, F.explode(FAILED).alias("_one")).select(*keys, "_one.column", "_one.text")


def conversion_checks(judged: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """``(check, table, violations)`` of each column, those without failures too."""
    counts = judged.agg(*[F.count_if(F.array_contains(F.col(f"{FAILED}.column"), c)).alias(c) for c in columns])
    checks = F.array(*[F.struct(F.lit(f"converts:{c}").alias("check"), F.col(f"`{c}`").alias("violations")) for c in columns])
    return counts.select(F.explode(checks).alias("_one")).select("_one.check", F.lit(table).alias("table"), "_one.violations")
