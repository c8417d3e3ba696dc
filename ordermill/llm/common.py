"""What the corpus operators share: word rules, batch sizes and written intermediate tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.session import scratch_dir

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts at the same six bytes.
GAP = r"[\x20\x09-\x0D]+"

#: Rows handed to a Python worker at once. Texts may be long, so Spark's default of 10,000 is too many.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def document_text(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, the text as UTF-8 bytes, a null as no bytes, and further columns."""
    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, *more)


def whole_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """Every row as one struct ``_row`` beside further columns, so that no name of the table can clash with these."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *more)


def digest(docs: DataFrame) -> Column:
    """A 64-bit digest of a whole row."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def filtered(docs: DataFrame, wanted, *arguments: Column) -> DataFrame:
    """The rows for which ``wanted`` says so: a function of the ``arguments`` as Arrow arrays that returns a mask.

    Rows pass through the Python worker whole, so no join is needed to find them again.
    """
    names = [f"_{k}" for k in range(len(arguments))]
    rows = whole_rows(docs, *[a.alias(n) for a, n in zip(arguments, names)])
    shape = rows.select("_row").schema

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                mask = pa.array(wanted(*part.columns[1:]), pa.bool_())
                yield part.select([0]).filter(mask)

    return rows.mapInArrow(chosen, shape).select("_row.*")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small for the rest of the session; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def written(frame: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table in the shared scratch folder.

    This cuts the lineage: what follows reads files that outlive any executor, and a
    costly step runs once however often its rows are used.
    """
    spark = frame.sparkSession
    path = scratch_dir(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def one_text(rows: DataFrame, *carried: str) -> DataFrame:
    """One row per doc_id and ``carried`` columns, with the text of the least digest: repeated ids bring no more rows, and reruns agree."""
    return rows.groupBy("doc_id", *carried).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def crc32_mod(column: str, modulus: int) -> Column:
    """CRC-32 of an id written as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def by_bytes(items: Iterable[bytes], limit: int) -> Iterator[list[bytes]]:
    """Runs of consecutive items of at most ``limit`` bytes, or one longer item."""
    run: list[bytes] = []
    size = 0
    for item in items:
        if run and size + len(item) > limit:
            yield run
            run, size = [], 0
        run.append(item)
        size += len(item)
    if run:
        yield run


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
