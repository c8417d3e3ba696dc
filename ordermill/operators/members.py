"""Dimension members refreshed by what changed (SCD type 1).

A member is compared by a digest of its attributes, kept with it: an outer join of keys and digests tells new, changed, vanished
and equal members apart, and only the buckets that hold one of the first three are written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.sinks.keyed import DEFAULT_BUCKETS, KeyedTable

DIGEST = "_digest"
CREATED, UPDATED = "dim_created_at", "dim_updated_at"
NEW, CHANGED, VANISHED, EQUAL = "new", "changed", "vanished", "equal"


def with_digest(members: DataFrame, key: str) -> DataFrame:
    """The attributes and their digest, without the stamps."""
    attributes = [c for c in members.columns if c not in (key, CREATED, UPDATED)]
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in attributes]), {"ignoreNullFields": "false"})
    return members.select(key, *attributes, F.md5(text.cast("binary")).alias(DIGEST))


def compared(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``(key, change)`` of every member of either side; both have the key once, and digests."""
    old = current.select(key, F.col(DIGEST).alias("_old"))
    new = incoming.select(key, F.col(DIGEST).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), NEW).when(F.col("_new").isNull(), VANISHED)
        .when(F.col("_old") != F.col("_new"), CHANGED).otherwise(EQUAL)
    )
    return old.join(new, key, "full").select(key, change.alias("change"))


def dimension(spark: SparkSession, path: str, members: DataFrame, key: str, buckets: int = DEFAULT_BUCKETS) -> KeyedTable:
    """A dimension table with the columns of ``members``."""
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema if f.name not in (CREATED, UPDATED)]
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}
    stamps = [f"{c} {kinds.get(c, 'timestamp')}" for c in (CREATED, UPDATED)]
    return KeyedTable(spark, path, ", ".join([*columns, f"{DIGEST} string", *stamps]), key, buckets)


def refresh(table: KeyedTable, incoming: DataFrame, stamp: Column | None = None) -> dict[str, int]:
    """Bring the dimension to ``incoming``; return how many members were new, changed, vanished and equal.

    Changed members keep their creation time. Without changes nothing is written. A refresh that died is made good by
    the next one.
    """
    key, now = table.key, F.current_timestamp() if stamp is None else stamp
    members = with_digest(incoming, key)
    changes = compared(table.read(), members, key).persist()
    try:
        counts = dict.fromkeys((NEW, CHANGED, VANISHED, EQUAL), 0)
        counts |= {row[0]: row[1] for row in changes.groupBy("change").count().collect()}  # four rows
        due = changes.where(F.col("change") != EQUAL)
        fresh = members.join(due.where(F.col("change") != VANISHED).select(key), key, "left_semi")

        def step(rows: DataFrame) -> DataFrame:
            born = rows.select(key, F.col(CREATED).alias("_born"))
            put = fresh.join(born, key, "left").withColumns({CREATED: F.coalesce("_born", now), UPDATED: now}).drop("_born")
            return rows.join(due.select(key), key, "left_anti").unionByName(put.select(*rows.columns))

        table.change(due, step)
        return counts
    finally:
        changes.unpersist()


def members(table: KeyedTable, columns: Sequence[str] | None = None) -> DataFrame:
    """The dimension as its readers see it."""
    stored = table.read().drop(DIGEST)
    return stored if columns is None else stored.select(*columns)
