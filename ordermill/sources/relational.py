"""Relational source tables over JDBC."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ordermill.config import JdbcConnection


@dataclass(frozen=True)
class ReadSplit:
    """Splits one table read into ``partitions`` range queries on ``column``."""

    column: str
    lower: str
    upper: str
    partitions: int


def jdbc_options(
    connection: JdbcConnection,
    table: str,
    split: ReadSplit | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    options = {
        "url": connection.url,
        "driver": connection.driver,
        "user": connection.user,
        "password": connection.password,
        "dbtable": table,
        "fetchsize": str(fetch_size),
    }
    if split is not None:
        options |= {
            "partitionColumn": split.column,
            "lowerBound": split.lower,
            "upperBound": split.upper,
            "numPartitions": str(split.partitions),
        }
    return options


def read_table(
    spark: SparkSession,
    table: str,
    connection: JdbcConnection | None = None,
    split: ReadSplit | None = None,
) -> DataFrame:
    """A whole table; filters and columns used later are pushed into its query.

    Without ``split`` the table arrives through one connection in one task, so a
    large table should be given one.
    """
    options = jdbc_options(connection or JdbcConnection.from_env(), table, split)
    return spark.read.format("jdbc").options(**options).load()
