"""Small tables and checks that the tests of the corpus operators share."""

import re

import duckdb

DATA = "/root/testdata"
SF = f"{DATA}/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Names that operators use inside; as extra columns of a table they must not disturb.
CLASHES = ("_row", "_words", "_key", "_weight", "_digest", "_tag", "size", "fp", "tag", "row", "leaf", "count", "n", "train", "rank")
LONG_WORDS = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
EDGE = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n\r\x0b\x0c ", None, None),
    (4, "One word", "en", "b"),
    (5, "the quick brown fox jumps over the lazy dog " * 3, "en", "b"),
    (5, "the quick brown fox jumps over the lazy dog " * 3, "en", "b"),
    (6, LONG_WORDS, "en", "c"),
    (7, "x" * 120_000, "de", "c"),
    (8, "a  b   c\n\na  b   c\nété \U0001f44d あ", "fr", None),
    (None, "no id at all here, only a text of several words", "en", "b"),
    (10, "12 34 !! ?? ...", "es", "a"),
]


def frame(spark, rows, extra=CLASHES):
    """Documents with further columns of clashing names."""
    ddl = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(rows, ddl)
    for k, name in enumerate(extra):
        docs = docs.selectExpr("*", f"'{name}' as `{name}`" if k % 2 else f"{k} as `{name}`")
    return docs


def edge(spark):
    return frame(spark, EDGE)


def none(spark):
    return frame(spark, [])


def words(text):
    return WORD.findall(text or "")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def texts(sf_dir=SF):
    rows = duckdb.execute(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    return dict(rows)


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def sql_rows(sql, sf_dir=SF, **tables):
    """Rows of a SQL text over a folder of tables, columns in order of their names."""
    connection = duckdb.connect()
    for name in ("documents", "labels", "embeddings", "conversations", "benchmark"):
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(r[k] for k in order) for r in cursor.fetchall()), key=repr)
