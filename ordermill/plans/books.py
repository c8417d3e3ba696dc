"""Catalogue ingestion: raw documents to the ``books`` table."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill import schemas
from ordermill.functions.catalogue import joined_head, steady_price, work_key
from ordermill.operators.quality import expect_not_empty
from ordermill.operators.upsert import collapse_batch, number_rows, upsert
from ordermill.sinks.keyed import KeyedTable, settings_for, tasks_for

log = logging.getLogger(__name__)

# Columns a known work takes from a new document, and column widths.
UPDATED_COLUMNS = ("title", "author_name", "first_publish_year", "unit_price")
TEXT_CHARS = 500
LANGUAGE_CHARS = 200


def page_documents(pages: DataFrame) -> DataFrame:
    """One row per document with its place: page offset, then position in the page."""
    return pages.select(
        F.coalesce("start", F.lit(0)).alias("page_start"), F.posexplode("docs").alias("position", "doc")
    )


def unreadable_pages(pages: DataFrame) -> DataFrame:
    return pages.where("docs IS NULL")


def normalize(documents: DataFrame) -> DataFrame:
    """Documents (column ``doc``) as book rows; other columns are kept for ordering."""
    doc = F.col("doc")
    year = doc["first_publish_year"]
    cover = doc["cover_i"]
    extra = [c for c in documents.columns if c != "doc"]
    rows = documents.withColumn("work_key", work_key(doc["key"])).where("work_key != ''")
    return rows.select(
        *extra,
        "work_key",
        F.coalesce(F.substring(doc["title"], 1, TEXT_CHARS), F.lit("")).alias("title"),
        joined_head(doc["author_name"], TEXT_CHARS).alias("author_name"),
        joined_head(doc["author_key"], TEXT_CHARS).alias("author_key"),
        F.when(year != 0, year).alias("first_publish_year"),
        joined_head(doc["isbn"], TEXT_CHARS).alias("isbn"),
        joined_head(doc["language"], LANGUAGE_CHARS).alias("language"),
        F.coalesce(F.when(cover != 0, cover.cast("string")), F.lit("")).alias("cover_id"),
        steady_price(F.col("work_key")).alias("unit_price"),
    )


def books_table(spark: SparkSession, path: str, **options) -> KeyedTable:
    """The catalogue by work key."""
    return KeyedTable(spark, path, schemas.BOOKS, "work_key", **options)


def collapse(batch: DataFrame) -> DataFrame:
    """One row per work of a batch, as inserting its rows in page order would leave it."""
    places = [F.col("page_start"), F.col("position")]
    return collapse_batch(batch, "work_key", places, UPDATED_COLUMNS).drop("page_start", "position")


def upsert_books(current: DataFrame, collapsed: DataFrame, last_id: int = 0, stamp: Column | None = None) -> DataFrame:
    """``current`` after a collapsed batch; ids of new works go on from ``last_id``.

    New works get an id and a creation time; known ones change four columns only. ``current`` needs no other works
    than those of the batch.
    """
    fresh = collapsed.select("work_key").join(current.select("work_key"), "work_key", "left_anti")
    ids = number_rows(fresh, "work_key", "id", last_id)
    created = F.current_timestamp() if stamp is None else stamp
    incoming = collapsed.join(ids, "work_key", "left").withColumn("created_at", created)
    return upsert(current, incoming, "work_key", UPDATED_COLUMNS)


def apply_pages(table: KeyedTable, pages: DataFrame, stream: str | None = None, batch: int | None = None) -> bool:
    """Upsert one batch of pages into the table; False if that changed nothing."""
    readable = pages.where("docs IS NOT NULL")
    # With one task's worth of documents nothing below is shuffled.
    found = readable.agg(F.sum(F.size("docs"))).first()[0] or 0
    with settings_for(found, table.spark, pages.sparkSession):
        collapsed = collapse(normalize(page_documents(readable).coalesce(tasks_for(found)))).persist()
        try:
            return table.amend(
                collapsed, lambda rows: upsert_books(rows, collapsed, table.largest("id") or 0), stream, batch, watched="id"
            )
        finally:
            collapsed.unpersist()


def set_aside(pages: DataFrame, path: str) -> None:
    """Write the text of pages that cannot be read."""
    unreadable_pages(pages).select("start", "_corrupt_record").drop("start").write.mode("overwrite").parquet(path)


def run_books(table: KeyedTable, pages: DataFrame) -> None:
    """Ingest pages, set unreadable ones aside, then fail if the table is empty."""
    load = uuid.uuid4().hex
    set_aside(pages, f"{table.dead_letters()}/load={load}")
    changed = apply_pages(table, pages)
    expect_not_empty(table.read(), "books")
    log.info("books: %s", "changed" if changed else "no page with works")
