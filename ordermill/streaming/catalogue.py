"""Catalogue pages as a stream into the ``books`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ordermill.plans.books import apply_pages, set_aside
from ordermill.sinks.keyed import KeyedTable, stream_id


def ingest_pages(
    pages: DataFrame, table: KeyedTable, checkpoint: str, dead_letter_path: str | None = None
) -> DataStreamWriter:
    """Upsert each micro-batch; progress is kept only once a batch is written."""
    rejects = dead_letter_path or table.dead_letters()

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            stream = stream_id(batch)
            set_aside(batch, f"{rejects}/stream={stream}/batch={batch_id}")
            apply_pages(table, batch, stream, batch_id)
        finally:
            batch.unpersist()

    return pages.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint)
