"""Every registered query against the same question in SQL."""

import duckdb
import pytest

import __spark_entry__ as spark_entry
from ordermill.workload.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def comparable(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    cursor = duck.execute(ORACLES[name])
    described = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(described) == columns
    assert {c: TYPES[t] for c, t in frame.dtypes} == described

    names = list(described)
    expected = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    actual = [tuple(r) for r in frame.select(*[f"`{c}`" for c in columns]).collect()]
    assert sorted(map(comparable, actual), key=repr) == sorted(map(comparable, expected), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(spark_entry.queries()) and set(ORACLES) <= set(spark_entry.oracle_sql())


def test_entry_has_rows(spark):
    assert spark_entry.entry(spark).count() > 0
