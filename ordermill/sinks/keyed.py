"""A Parquet table of rows by key, in folders of hash buckets.

A change reads the buckets that hold its keys and replaces their folders, so one
changed row costs its bucket, not the table. Small changes of a stream need not cost their buckets: ``amend`` writes the changed rows only, beside
the buckets, and every ``SETTLE_AFTER`` of them the buckets take them in. A stream notes its last batch beside the rows when they are in place, and
a batch that comes again changes nothing. One writer at a time; a reader that must not see a change half done
waits for the writer, as with any plain folder of files.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.operators.latest import latest_per_key
from ordermill.session import conf_scope
from ordermill.sinks.datasets import finish_replacement, replace_partitions, write_measured
from ordermill.sources.datasets import delete_folder, folder_exists, read_text, write_text

#: Rows per bucket should stay in the millions; the number is fixed when a table is created.
DEFAULT_BUCKETS = 256
BUCKET = "_bucket"
#: So many amendments lie beside the buckets at most; keys of an amendment up to the second number are broadcast.
SETTLE_AFTER = 32
BROADCAST_KEYS = 500_000
#: Rows of a change per task, where a task's rows can be chosen: small changes then need no shuffle.
ROWS_PER_TASK = 50_000
ONE_TASK = {
    "spark.sql.adaptive.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.codegen.wholeStage": "false",  # code made for one batch takes longer to compile than its rows do without
    "spark.sql.shuffle.partitions": "1",
}
AMENDMENT = "_amendment"


def tasks_for(rows: int) -> int:
    return -(-max(rows, 1) // ROWS_PER_TASK)


@contextmanager
def settings_for(rows: int, *sessions: SparkSession) -> Iterator[None]:
    """While rows fit one task there is nothing to plan anew between stages."""
    with ExitStack() as stack:
        for session in sessions if tasks_for(rows) == 1 else ():
            stack.enter_context(conf_scope(session, ONE_TASK))
        yield


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = DEFAULT_BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self.rows, self.recent = f"{self.path}/rows", f"{self.path}/recent"

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def read_for(self, keys: DataFrame) -> DataFrame:
        """The rows of the buckets that hold some keys; the frame needs the key column."""
        return self._in(self._touched(keys)).drop(BUCKET)

    def dead_letters(self) -> str:
        """Folder for input that could not be applied."""
        return f"{self.path}/_dead_letters"

    def change(
        self,
        changes: DataFrame,
        step: Callable[[DataFrame], DataFrame],
        stream: str | None = None,
        batch: int | None = None,
    ) -> bool:
        """Replace the rows in the buckets of ``changes`` by ``step(rows)``; False if there was nothing to do.

        ``changes`` needs the key column and is read twice. With ``stream`` and ``batch`` a batch that
        the stream has applied before does nothing.
        """
        finish_replacement(self.spark, self.rows)
        if self._has(stream, batch):
            return False
        self.settle()
        if (note := self._note())["largest"]:
            self._write_note(note | {"largest": {}})
        touched = self._touched(changes)
        if touched:
            after = step(self._in(touched).drop(BUCKET)).withColumn(BUCKET, self._bucket())
            replace_partitions(after, self.rows, BUCKET, touched)
        self._applied(stream, batch)
        return bool(touched)

    def amend(
        self,
        changes: DataFrame,
        step: Callable[[DataFrame], DataFrame],
        stream: str | None = None,
        batch: int | None = None,
        watched: str | None = None,
    ) -> bool:
        """Write ``step(rows)``, where ``rows`` are those of the keys of ``changes``; False if there was nothing to do.

        For tables with one row per key. The step may change and add rows of these keys, not take any out. ``changes`` has the key column and is read
        several times. ``watched`` is a column whose largest value ever written is noted (``largest``).
        """
        finish_replacement(self.spark, self.rows)
        if self._has(stream, batch):
            return False
        counted = changes.groupBy(self._bucket().alias(BUCKET)).count().collect()  # bounded: a row per bucket
        if counted:
            counts = {r[BUCKET]: r["count"] for r in counted}
            with settings_for(sum(counts.values()), self.spark, changes.sparkSession):
                self._amend(changes, step, counts, watched)
        self._applied(stream, batch)
        if len(self._note()["live"]) >= SETTLE_AFTER:
            self.settle()
        return bool(counted)

    def _amend(self, changes: DataFrame, step: Callable[[DataFrame], DataFrame], counts: dict[int, int], watched: str | None) -> None:
        note, keys, count = self._note(), changes.select(self.key), sum(counts.values())
        if count <= BROADCAST_KEYS:
            keys = F.broadcast(keys)
        stored = self._layers(note).where(F.col(BUCKET).isin(list(counts))).join(keys, self.key, "left_semi")
        known = self._newest(stored.repartition(1) if tasks_for(count) == 1 else stored).drop(BUCKET, AMENDMENT).persist()
        try:
            after = step(known).withColumns({BUCKET: self._bucket(), AMENDMENT: F.lit(note["next"])})
            measures = {"largest": F.max(watched)} if watched else {}
            seen = write_measured(after, f"{self.recent}/{note['next']}", **measures)
        finally:
            known.unpersist()
        if watched:
            found = [n for n in (note["largest"].get(watched), seen["largest"]) if n is not None]
            note["largest"][watched] = max(found) if found else None
        self._write_note(note | {"next": note["next"] + 1, "live": note["live"] + [note["next"]]})

    def settle(self) -> None:
        """Bring what lies beside the buckets into them; done again after a crash it changes nothing."""
        note = self._note()
        if not note["live"]:
            return
        touched = [r[0] for r in self._amendments(note).select(BUCKET).distinct().collect()]  # bounded: a row per bucket
        after = self._newest(self._layers(note).where(F.col(BUCKET).isin(touched))).drop(AMENDMENT)
        replace_partitions(after, self.rows, BUCKET, touched)
        self._write_note(note | {"live": []})
        for number in note["live"]:
            delete_folder(self.spark, f"{self.recent}/{number}")

    def largest(self, column: str):
        """The largest value of a watched column; of a table that has not noted it, the largest that is stored."""
        noted = self._note()["largest"].get(column)
        return self.read().agg(F.max(column)).first()[0] if noted is None else noted

    def _has(self, stream: str | None, batch: int | None) -> bool:
        return stream is not None and batch <= int(read_text(self.spark, f"{self.path}/_applied/{stream}") or -1)

    def _applied(self, stream: str | None, batch: int | None) -> None:
        if stream is not None:
            write_text(self.spark, f"{self.path}/_applied/{stream}", str(batch))

    def _note(self) -> dict:
        """The number of the next amendment, those beside the buckets, and the largest values of watched columns."""
        found = read_text(self.spark, f"{self.path}/_amendments")
        return json.loads(found) if found else {"next": 0, "live": [], "largest": {}}

    def _write_note(self, note: dict) -> None:
        write_text(self.spark, f"{self.path}/_amendments", json.dumps(note))

    def _amendments(self, note: dict) -> DataFrame:
        schema = f"{self.schema}, {BUCKET} INT, {AMENDMENT} INT"
        return self.spark.read.schema(schema).parquet(*[f"{self.recent}/{number}" for number in note["live"]])

    def _layers(self, note: dict) -> DataFrame:
        """Rows of the buckets and of the amendments; of one key the latest counts."""
        settled = self._settled().withColumn(AMENDMENT, F.lit(-1))
        return settled.unionByName(self._amendments(note)) if note["live"] else settled

    def _newest(self, rows: DataFrame) -> DataFrame:
        return latest_per_key(rows, [self.key, BUCKET], [F.col(AMENDMENT).desc()])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _touched(self, keys: DataFrame) -> list[int]:
        """Bounded: one number per bucket."""
        return [r[0] for r in keys.select(self._bucket().alias(BUCKET)).distinct().collect()]

    def _stored(self) -> DataFrame:
        note = self._note()
        return self._newest(self._layers(note)).drop(AMENDMENT) if note["live"] else self._settled()

    def _settled(self) -> DataFrame:
        schema = f"{self.schema}, {BUCKET} INT"
        if not folder_exists(self.spark, self.rows):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.rows)

    def _in(self, buckets: list[int]) -> DataFrame:
        return self._stored().where(F.col(BUCKET).isin(buckets))


def stream_id(batch: DataFrame) -> str:
    """The id of the streaming query that a micro-batch belongs to; a new checkpoint gives a new one."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
