"""Change-event, completion, catalogue and quality queries."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill import schemas
from ordermill.operators import completion, conversions, profile, quality
from ordermill.plans import books, checks
from ordermill.session import conf_scope, scratch_dir
from ordermill.sinks.keyed import KeyedTable
from ordermill.sinks.topics import as_messages
from ordermill.sources import samples
from ordermill.sources.pages import read_pages, stream_pages
from ordermill.sources.scan import scanned_pages
from ordermill.sources.topics import landed_topic
from ordermill.streaming import catalogue, envelopes, inspection, orphans, repeats, replication
from ordermill.streaming import completion as live
from ordermill.workload import model as m
from ordermill.workload.registry import query

# Long enough that nothing expires while a replay runs, however slow the machine.
REPLAY_LIFE = live.Lifetimes(86_400, 86_400, 86_400)


# --- change events ----------------------------------------------------------

@query(
    f"""SELECT 'c' AS op, CAST(o_orderkey AS BIGINT) AS pos, CAST(o_orderkey AS VARCHAR) AS id,
      CAST(o_custkey AS INTEGER) AS customer_id, {m.PAYMENT_ID} AS payment_method_id,
      {m.PAYMENT_ID} AS num_products, epoch_ms(o_orderdate) AS "timestamp" FROM orders"""
)
def cdc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = envelopes.decode(samples.order_messages(spark, sf_dir), schemas.ORDER_IMAGE)
    return decoded.select("op", "pos", "after.*").drop("store_id")


@query(
    f"""SELECT CAST(o_orderkey AS BIGINT) AS seq,
      CASE {m.PAYMENT_ID} WHEN 1 THEN 'corrupt' WHEN 2 THEN 'no_after' WHEN 3 THEN 'no_after'
                          WHEN 4 THEN 'null_field' END AS rejected
    FROM orders WHERE {m.PAYMENT_ID} < 5"""
)
def cdc_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = envelopes.order_events(samples.broken_order_messages(spark, sf_dir))
    return envelopes.dead_letters(judged).select("seq", "rejected")


_REPLICA = f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS INTEGER) AS customer_id,
      CASE o_orderstatus WHEN 'P' THEN {m.PAYMENT_ID} % 5 + 1 ELSE {m.PAYMENT_ID} END AS payment_method_id
    FROM orders WHERE o_orderstatus <> 'F'"""


@query(_REPLICA)
def cdc_apply_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create, update and delete events applied to an empty copy."""
    decoded = envelopes.decode(samples.order_change_messages(spark, sf_dir), schemas.ORDER_IMAGE)
    changes = replication.net_changes(replication.judged_changes(decoded, "id"), "id")
    return replication.live_rows(changes).select("id", "customer_id", "payment_method_id")


def _land(messages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Small row groups, so that one landed file can be decoded by several tasks."""
    messages.write.mode(mode).option("parquet.block.size", 4 << 20).option("compression", "zstd").parquet(path)


def _dealt(messages: DataFrame, number: Column, count: int, path: str) -> list[DataFrame]:
    """Messages by ``number``, set down by all tasks in one pass."""
    numbered = messages.withColumn("_slice", number.cast("int"))
    numbered.write.option("parquet.block.size", 4 << 20).option("compression", "zstd").parquet(path)
    stored = messages.sparkSession.read.schema(numbered.schema).parquet(path)
    return [stored.where(F.col("_slice") == n).drop("_slice") for n in range(count)]


def _in_slices(messages: DataFrame, bounds: list, path: str, by: str = "seq") -> list[DataFrame]:
    """Messages by stretches of the event order, in that order."""
    number = sum((F.when(F.col(by) >= bound, 1).otherwise(0) for bound in bounds), F.lit(0))
    return _dealt(messages.where(F.col(by).isNotNull()), number, len(bounds) + 1, path)


def _in_turn(spark: SparkSession, steps: list[dict[str, DataFrame]], run: Callable[[], DataFrame | None]) -> DataFrame | None:
    """Land each step, in as many files as it has tasks, and let the stream go on: it takes a step as one micro-batch.

    Batches without data come after the last step only.
    """
    found = None
    for number, parts in enumerate(steps, 1):
        for path, rows in parts.items():
            _land(rows, path, "append")
        settings = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"} if number < len(steps) else {}
        with conf_scope(spark, settings):
            found = run()
    return found


def _replica(spark: SparkSession, folder: str) -> KeyedTable:
    return KeyedTable(spark, f"{folder}/table", replication.replica_schema(schemas.ORDER_IMAGE), "id", buckets=16)


def _apply(spark: SparkSession, folder: str, topic: str, table: KeyedTable) -> None:
    """Apply what has landed of a topic; each topic has a checkpoint of its own."""
    writer = replication.replicate(landed_topic(spark, f"{folder}/{topic}"), table, schemas.ORDER_IMAGE, f"{folder}/{topic}-checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()


@query(_REPLICA)
def cdc_replicate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events landed as files and applied by a stream."""
    folder = scratch_dir(spark, "replica")
    _land(samples.order_change_messages(spark, sf_dir), f"{folder}/in")
    replica = _replica(spark, folder)
    _apply(spark, folder, "in", replica)
    return replication.live_rows(replica.read()).select("id", "customer_id", "payment_method_id")


def _replicated_twice(spark: SparkSession, sf_dir: str) -> KeyedTable:
    """A stream over several micro-batches, then another one, with a new checkpoint, on the same table."""
    folder = scratch_dir(spark, "replica")
    replica = _replica(spark, folder)
    topics = {"first": (samples.order_change_messages(spark, sf_dir), 4), "second": (samples.later_change_messages(spark, sf_dir), 3)}
    for topic, (messages, batches) in topics.items():
        parts = _dealt(messages, F.pmod(F.xxhash64("value", "seq"), F.lit(batches)), batches, f"{folder}/{topic}-dealt")
        _in_turn(spark, [{f"{folder}/{topic}": part} for part in parts], lambda topic=topic: _apply(spark, folder, topic, replica))
    return replica


@query(
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS INTEGER) AS customer_id,
      {m.PAYMENT_ID} % 5 + 1 AS payment_method_id FROM orders WHERE o_orderstatus <> 'F'"""
)
def cdc_replicate_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes dealt over micro-batches without regard to their order; later, late and stale ones by a second stream."""
    replica = _replicated_twice(spark, sf_dir)
    return replication.live_rows(replica.read()).select("id", "customer_id", "payment_method_id")


@query(
    f"""SELECT CAST(o_orderkey AS BIGINT) AS seq, CASE {m.PAYMENT_ID} WHEN 1 THEN 'no_key' ELSE 'corrupt' END AS rejected
    FROM orders WHERE {m.PAYMENT_ID} < 3"""
)
def replica_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second stream could not apply."""
    replica = _replicated_twice(spark, sf_dir)
    return spark.read.parquet(replica.dead_letters()).select("seq", "rejected")


# How far each partition of the joint log has arrived: file and share of its orders. Details with odd order ids are last.
_ARRIVED = {("orders", 0): (3, 1.0), ("order_details", 0): (3, 0.9), ("order_details", 1): (3, 0.6)}


def _lagging(log: DataFrame, orders: int) -> DataFrame:
    """What has arrived of a joint log."""
    arrived = F.lit(False)
    for (topic, partition), (file, share) in _ARRIVED.items():
        within = F.struct("log", "pos") < F.struct(F.lit(file).cast("bigint"), F.lit(int(orders * share)).cast("bigint") * samples.LOG_STRIDE)
        arrived = arrived | ((F.col("topic") == topic) & (F.col("partition") == partition) & within)
    return log.where(arrived)


def _joint_log_slices(spark: SparkSession, sf_dir: str, folder: str, slices: int) -> list[DataFrame]:
    """Equal stretches of the log, in the order of the log; a topic's partitions arrive unevenly."""
    orders = samples.table(spark, sf_dir, "orders").agg(F.max("o_orderkey") + 1).first()[0]
    place = F.col("log") * F.lit(orders).cast("bigint") * samples.LOG_STRIDE + F.col("pos")
    log = _lagging(samples.joint_log(spark, sf_dir), orders).withColumn("place", place)
    bounds = log.agg(F.percentile_approx("place", [k / slices for k in range(1, slices)], 10_000)).first()[0] or []
    found = _in_slices(log, bounds, f"{folder}/slices", "place")
    return [part.select("topic", "value", "seq", "partition") for part in found]


_JOINT_CUT = f"""WITH o AS (SELECT *, {m.PAYMENT_ID} AS pay, o_orderkey * {samples.LOG_STRIDE} AS pos FROM orders),
    l AS (SELECT l_orderkey, l_partkey, CAST(sum(CAST(l_quantity AS INTEGER)) AS INTEGER) AS n, o_orderstatus,
        l_orderkey * {samples.LOG_STRIDE} + 1 + l_partkey AS pos
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
    log AS (SELECT 'orders' AS topic, 0 AS part, 3 AS file, pos + {samples.LOG_STRIDE} - 1 AS pos FROM o WHERE o_orderstatus = 'F'
      UNION ALL SELECT 'order_details', l_orderkey % 2, 3, pos FROM l WHERE o_orderstatus = 'F'),
    lag AS (SELECT count(*) AS orders FROM orders),
    arrived AS (SELECT topic, part, max(pos) AS pos FROM log, lag WHERE pos < {samples.LOG_STRIDE} * CAST(floor(orders * CASE
        WHEN topic = 'orders' THEN 1.0 WHEN part = 0 THEN 0.9 ELSE 0.6 END) AS BIGINT) GROUP BY ALL),
    cut AS (SELECT min(pos) AS pos FROM arrived)
    SELECT 'orders' AS "table", CAST(o_orderkey AS VARCHAR) AS order_id, CAST(NULL AS INTEGER) AS product_id,
      CASE o_orderstatus WHEN 'P' THEN pay % 5 + 1 ELSE pay END AS value
    FROM o, cut WHERE o_orderstatus <> 'F' OR o.pos + {samples.LOG_STRIDE} - 1 > cut.pos
    UNION ALL SELECT 'order_details', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS INTEGER),
      CASE o_orderstatus WHEN 'P' THEN n + 1 ELSE n END
    FROM l, cut WHERE o_orderstatus <> 'F' OR l.pos > cut.pos"""


@query(_JOINT_CUT)
def cdc_joint_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines replicated from two topics whose partitions have come unequally far along one log.

    Both copies stand at the last place that all partitions have reached.
    """
    folder = scratch_dir(spark, "joint")
    parts = _joint_log_slices(spark, sf_dir, folder, slices=4)
    orders = _replica(spark, f"{folder}/orders")
    details = KeyedTable(spark, f"{folder}/details", replication.replica_schema(schemas.DETAIL_IMAGE), "order_id", buckets=8)
    members = replication.orders_and_details(orders, details, partitions=(1, 2))

    def run() -> None:
        messages = landed_topic(spark, f"{folder}/in", more="topic STRING")
        writer = replication.replicate_jointly(messages, members, f"{folder}/state", f"{folder}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()

    _in_turn(spark, [{f"{folder}/in": part} for part in parts], run)
    held = replication.live_rows(orders.read()).select(
        F.lit("orders").alias("table"), F.col("id").alias("order_id"), F.lit(None).cast("int").alias("product_id"),
        F.col("payment_method_id").alias("value"),
    )
    lines = replication.live_rows(details.read())
    return held.unionByName(lines.select(F.lit("order_details").alias("table"), "order_id", "product_id", F.col("quantity").alias("value")))


# --- completion -------------------------------------------------------------

def _as_row(completed: DataFrame) -> DataFrame:
    """The product list as text, for comparison."""
    return completed.withColumn("product_ids", F.array_join("product_ids", ","))


@query(
    f"""WITH {m.SQL_ORDERS}, totals AS (
      SELECT l_orderkey, count(DISTINCT l_partkey) AS arrived,
        array_to_string(list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))), ',') AS product_ids
      FROM lineitem GROUP BY l_orderkey)
    SELECT CAST(id AS VARCHAR) AS order_id, CAST(customer_id AS VARCHAR) AS customer_id,
      CAST(payment_method_id AS VARCHAR) AS payment_method_id, product_ids
    FROM src_orders JOIN totals ON l_orderkey = id WHERE arrived = num_products"""
)
def completed_orders_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = samples.orders(spark, sf_dir).withColumnRenamed("id", "order_id")
    details = samples.order_details(spark, sf_dir)
    return _as_row(completion.complete_orders(orders, details))


def _replay_sql(moment: str) -> str:
    """``moment``: the place at which an order is emitted, over the running counts ``r``.

    ``first_n`` and ``first_seq`` are those of an earlier announcement, which only some queries read.
    """
    return f"""WITH o AS (
      SELECT o_orderkey AS id, o_custkey AS customer_id, {m.PAYMENT_ID} AS n, epoch_us(o_orderdate) AS oseq,
        {m.PAYMENT_ID} % 5 + 1 AS first_n, epoch_us(o_orderdate) - {samples.ANNOUNCED_AHEAD} AS first_seq
      FROM orders),
    d AS (SELECT l_orderkey AS id, l_partkey AS product_id,
        epoch_us(l_shipdate) + 1 + l_linenumber * 8000000000 + l_partkey AS seq FROM lineitem),
    f AS (SELECT *, row_number() OVER (PARTITION BY id, product_id ORDER BY seq) AS nth FROM d),
    r AS (SELECT id, seq, sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END)
        OVER (PARTITION BY id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS k FROM f),
    e AS ({moment})
    SELECT CAST(o.id AS VARCHAR) AS order_id, CAST(any_value(customer_id) AS VARCHAR) AS customer_id,
      CAST(any_value(n) AS VARCHAR) AS payment_method_id,
      array_to_string(list_sort(list(DISTINCT CAST(product_id AS VARCHAR))), ',') AS product_ids
    FROM e JOIN o ON o.id = e.id JOIN d ON d.id = e.id AND d.seq <= e.eseq GROUP BY o.id"""


_ON_DETAIL = """SELECT r.id, min(r.seq) AS eseq FROM r JOIN o ON o.id = r.id
      WHERE r.seq > oseq AND k = n GROUP BY r.id"""

# Either a detail completes the order, or the set was full when the order came.
_ON_BOTH = f"""SELECT id, min(eseq) AS eseq FROM ({_ON_DETAIL} UNION ALL
      SELECT r.id, any_value(oseq) FROM r JOIN o ON o.id = r.id WHERE r.seq < oseq
      GROUP BY r.id HAVING max(k) = any_value(n)) GROUP BY id"""


def _replayed(spark: SparkSession, sf_dir: str, trigger_on: str) -> DataFrame:
    orders = samples.completion_orders(spark, sf_dir)
    details = samples.completion_details(spark, sf_dir)
    return _as_row(completion.replay_completion(orders, details, trigger_on))


@query(_replay_sql(_ON_DETAIL))
def completed_orders_first_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir, "detail")


@query(_replay_sql(_ON_BOTH))
def completed_orders_first_reach_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir, "both")


def _streamed(spark: SparkSession, sf_dir: str, trigger_on: str) -> DataFrame:
    folder = scratch_dir(spark, "completion")
    _land(samples.order_messages(spark, sf_dir), f"{folder}/orders")
    _land(samples.detail_messages(spark, sf_dir), f"{folder}/details")
    events = live.completion_events(
        envelopes.order_events(landed_topic(spark, f"{folder}/orders")),
        envelopes.detail_events(landed_topic(spark, f"{folder}/details")),
    )
    completed = live.completed_orders(events, trigger_on, REPLAY_LIFE)
    return live.run_available(spark, completed, f"{folder}/out", f"{folder}/checkpoint")


@query(_replay_sql(_ON_DETAIL))
def completed_orders_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_row(_streamed(spark, sf_dir, "detail"))


@query(_replay_sql(_ON_BOTH))
def completed_orders_stream_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_row(_streamed(spark, sf_dir, "both"))


# Of the two announcements of an order the later one counts from its place on. The parts of an order that tell who ordered
# are the same in both, so the number of products the order was emitted with is that of its moment.
_ON_LATEST = """SELECT r.id, min(r.seq) AS eseq FROM r JOIN o ON o.id = r.id
      WHERE (r.seq > oseq AND k = n) OR (r.seq BETWEEN first_seq AND oseq AND k = first_n) GROUP BY r.id"""


@query(_replay_sql(_ON_LATEST))
def completion_from_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of all events folded as a batch; a stream starts from the state this leaves and takes the second
    half in several micro-batches. Every order is announced with another size before it is updated."""
    folder = scratch_dir(spark, "completion")
    orders, details = samples.announced_twice(spark, sf_dir), samples.completion_details(spark, sf_dir)
    shares = [k / 12 for k in range(6, 12)]
    cut, *bounds = details.agg(F.percentile_approx("seq", shares, 10_000)).first()[0]  # six places
    past = F.col("seq") < cut

    before = orders.where(past), details.where(past)
    emitted = completion.replay_completion(*before)
    completion.open_orders(*before).write.parquet(f"{folder}/history")
    parts = (
        _in_slices(samples.order_messages(spark, sf_dir, twice=True).where(~past), bounds, f"{folder}/order-slices"),
        _in_slices(samples.detail_messages(spark, sf_dir).where(~past), bounds, f"{folder}/detail-slices"),
    )

    def run() -> DataFrame:
        events = live.completion_events(
            envelopes.order_events(landed_topic(spark, f"{folder}/orders")),
            envelopes.detail_events(landed_topic(spark, f"{folder}/details")),
        )
        completed = live.completed_orders(events, life=REPLAY_LIFE, history=spark.read.parquet(f"{folder}/history"))
        return live.run_available(spark, completed, f"{folder}/out", f"{folder}/checkpoint")

    streamed = _in_turn(spark, [{f"{folder}/orders": heads, f"{folder}/details": items} for heads, items in zip(*parts)], run)
    return _as_row(emitted.unionByName(streamed))


@query(
    f"""SELECT order_id AS "key", '{{"order_id":"' || order_id || '","customer_id":"' || customer_id
      || '","payment_method_id":"' || payment_method_id || '","product_ids":["'
      || replace(product_ids, ',', '","') || '"]}}' AS "value"
    FROM ({_replay_sql(_ON_DETAIL)})"""
)
def completed_order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed orders as the JSON messages that are published."""
    orders = samples.completion_orders(spark, sf_dir)
    details = samples.completion_details(spark, sf_dir)
    completed = completion.replay_completion(orders, details)
    return as_messages(completed, "order_id")


@query(
    f"""WITH completed AS ({_replay_sql(_ON_DETAIL)}),
    messages AS (SELECT order_id AS "key", '{{"order_id":"' || order_id || '","customer_id":"' || customer_id
      || '","payment_method_id":"' || payment_method_id || '","product_ids":["'
      || replace(product_ids, ',', '","') || '"]}}' AS "value" FROM completed)
    SELECT "key", "value", wave FROM messages, (VALUES (0), (1)) AS w(wave)"""
)
def completed_messages_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published messages of a replay, each repeated after 100 seconds; a year later all come again, with a repeat after 200."""
    folder = scratch_dir(spark, "repeats")
    completed = completion.replay_completion(samples.completion_orders(spark, sf_dir), samples.completion_details(spark, sf_dir))
    second, year = 1_000_000, 366 * 24 * samples.HOUR
    own = as_messages(completed, "order_id").withColumn("seq", F.col("key").cast("bigint") * second)
    own.write.parquet(f"{folder}/messages")
    own = spark.read.parquet(f"{folder}/messages")
    steps = []
    for start, repeat in ((0, 100), (year, 200)):
        first = own.withColumn("seq", F.col("seq") + start)
        both = first.unionByName(first.withColumn("seq", F.col("seq") + repeat * second))
        bounds = both.agg(F.percentile_approx("seq", [0.5], 10_000)).first()[0] or []
        steps += _in_slices(both, bounds, f"{folder}/slices-{start}")
        for hours in (4_000, 4_001):  # time goes on before the next year's messages
            steps.append(own.limit(1).select(F.lit(None).cast("string").alias("key"), "value", F.lit(start + hours * samples.HOUR).alias("seq")))

    def run() -> DataFrame:
        published = landed_topic(spark, f"{folder}/in", more="key STRING")
        out = repeats.once(published).where("key IS NOT NULL").select("key", "value", (F.col("seq") >= year).cast("int").alias("wave"))
        writer = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{folder}/out")

    return _in_turn(spark, [{f"{folder}/in": step} for step in steps], run)


@query(
    _replay_sql(_ON_DETAIL).split("SELECT CAST(o.id AS VARCHAR) AS order_id")[0]
    + """ SELECT CAST(o.id AS VARCHAR) AS order_id, CAST(any_value(customer_id) AS VARCHAR) AS customer_id,
      CAST(any_value(n) AS VARCHAR) AS payment_method_id, any_value(n) AS num_products,
      array_to_string(list_sort(list(DISTINCT CAST(product_id AS VARCHAR)) FILTER (product_id IS NOT NULL)), ',') AS product_ids
    FROM o LEFT JOIN d ON d.id = o.id WHERE o.id NOT IN (SELECT id FROM e) GROUP BY o.id"""
)
def open_orders_in_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are not complete, read from the checkpoint of a stream that was stopped in the middle and started again."""
    folder = scratch_dir(spark, "completion")
    topics = {"orders": samples.order_messages(spark, sf_dir), "details": samples.detail_messages(spark, sf_dir)}
    middle = samples.completion_details(spark, sf_dir).agg(F.percentile_approx("seq", 0.5, 10_000)).first()[0]
    for half in (F.col("seq") < middle, F.col("seq") >= middle):
        for name, messages in topics.items():
            messages.where(half).write.option("parquet.block.size", 4 << 20).mode("append").parquet(f"{folder}/{name}")
        events = live.completion_events(
            envelopes.order_events(landed_topic(spark, f"{folder}/orders")),
            envelopes.detail_events(landed_topic(spark, f"{folder}/details")),
        )
        live.run_available(spark, live.completed_orders(events, life=REPLAY_LIFE), f"{folder}/out", f"{folder}/checkpoint")
    return _as_row(inspection.open_orders(spark, f"{folder}/checkpoint"))


@query(
    """WITH o AS (SELECT o_orderkey, o_orderdate + INTERVAL 1 HOUR * (CASE WHEN o_orderstatus = 'O' THEN 0
        WHEN substr(o_orderpriority, 1, 1) < '3' THEN 12 ELSE 72 END) AS ordered_at FROM orders WHERE o_orderstatus <> 'F'),
    l AS (SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_orderkey, CAST(l_partkey AS INTEGER) AS product_id,
        CAST(l_quantity AS INTEGER) AS quantity, o_orderdate + INTERVAL 1 HOUR * l_linenumber AS seen_at
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    SELECT order_id, product_id, quantity, seen_at FROM l LEFT JOIN o ON o_orderkey = l_orderkey
      AND ordered_at BETWEEN seen_at - INTERVAL 1 DAY AND seen_at + INTERVAL 1 DAY WHERE o_orderkey IS NULL"""
)
def stream_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose order comes not within a day of them, found over several micro-batches; late orders within it are matched."""
    folder = scratch_dir(spark, "orphans")
    parts = dict(zip(("orders", "details"), samples.arrival_messages(spark, sf_dir)))
    shares = [k / 4 for k in range(1, 4)]
    bounds, last = parts["details"].agg(F.percentile_approx("seq", shares, 10_000), F.max("seq")).first()
    steps = {}
    for topic, messages in parts.items():
        steps[topic] = _in_slices(messages, bounds, f"{folder}/{topic}-slices")
        # What tells both topics that time has gone on: messages of no use, a year later.
        steps[topic].append(messages.limit(1).select("value", F.lit(last + 366 * 24 * samples.HOUR).alias("seq")))

    def run() -> DataFrame:
        judged = (
            envelopes.order_events(landed_topic(spark, f"{folder}/orders")),
            envelopes.detail_events(landed_topic(spark, f"{folder}/details")),
        )
        found = orphans.orphans(*judged, bound=timedelta(days=1), lateness=timedelta(days=1))
        return orphans.run_available(found, f"{folder}/out", f"{folder}/checkpoint")

    out = _in_turn(spark, [{f"{folder}/orders": heads, f"{folder}/details": lines} for heads, lines in zip(*steps.values())], run)
    # the last message of the lines has no order either, but its time has not passed
    return out.withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz"))


# --- catalogue --------------------------------------------------------------

_PRICE = "CAST(5 + (('0x' || substr(md5(work_key), 1, 8))::BIGINT % 4501) / 100.0 AS DOUBLE)"

_PART_BOOKS = f"""part_docs AS (
      SELECT 'OL' || CAST(p_partkey AS VARCHAR) || 'W' AS work_key, p_name AS title,
        replace(p_type, ' ', ', ') AS author_name, p_brand AS author_key,
        CAST(p_size + 1970 AS INTEGER) AS first_publish_year,
        lpad(CAST(p_partkey AS VARCHAR), 13, '9') AS isbn, 'eng, None' AS language,
        CASE p_partkey % 3 WHEN 0 THEN '' ELSE CAST(p_partkey % 3 AS VARCHAR) END AS cover_id
      FROM part),
    part_books AS (SELECT *, {_PRICE} AS unit_price FROM part_docs)"""

_TEXT_BOOKS = f"""SELECT *, {_PRICE} AS unit_price FROM (
      SELECT 'D' || CAST(doc_id AS VARCHAR) AS work_key, substr("text", 1, 500) AS title,
        substr(array_to_string(list_slice(string_split("text", ' '), 1, 5), ', '), 1, 500) AS author_name,
        '' AS author_key, CAST(NULL AS INTEGER) AS first_publish_year, substr(source, 1, 500) AS isbn,
        lang AS language, CASE n_chars WHEN 0 THEN '' ELSE CAST(n_chars AS VARCHAR) END AS cover_id
      FROM documents)"""


def _comparable(rows: DataFrame) -> DataFrame:
    return rows.withColumn("unit_price", F.col("unit_price").cast("double"))


@query(f"WITH {_PART_BOOKS} SELECT * FROM part_books")
def books_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books.normalize(samples.part_documents(spark, sf_dir))
    return _comparable(rows.drop("page_start", "position"))


@query(_TEXT_BOOKS)
def books_normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as titles and author lists, cut to the column widths."""
    rows = books.normalize(samples.text_documents(spark, sf_dir))
    return _comparable(rows.drop("page_start", "position"))


def _second_crawl(documents: DataFrame) -> DataFrame:
    """Documents seen again in a later page with every column changed, and new works."""
    doc = F.col("doc")
    moved = documents.withColumn("page_start", F.col("page_start") + 1_000_000_000)
    changed = moved.withColumn(
        "doc",
        doc.withField("title", F.upper(doc["title"])).withField("isbn", F.array(F.lit("0"))),
    )
    added = moved.withColumn(
        "doc", doc.withField("key", F.replace(doc["key"], F.lit("OL"), F.lit("NEW")))
    )
    return changed.unionByName(added)


_UPSERTED = f"""WITH {_PART_BOOKS}, fresh AS (
      SELECT * REPLACE (replace(work_key, 'OL', 'NEW') AS work_key) FROM part_docs)
    SELECT work_key, upper(title) AS title, author_name, author_key, first_publish_year, isbn, language,
      cover_id, unit_price FROM part_books
    UNION ALL SELECT work_key, title, author_name, author_key, first_publish_year, isbn, language, cover_id,
      {_PRICE} FROM fresh"""


@query(_UPSERTED)
def books_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first crawl, then a second that changes known works and adds others."""
    documents = samples.part_documents(spark, sf_dir)
    empty = spark.createDataFrame([], schemas.BOOKS)
    first = books.upsert_books(empty, books.collapse(books.normalize(documents)))
    second = books.upsert_books(first, books.collapse(books.normalize(_second_crawl(documents))))
    return _comparable(second.drop("id", "created_at"))


@query(
    f"""SELECT CAST(count(*) AS BIGINT) AS books, CAST(count(*) AS BIGINT) AS distinct_ids,
      CAST(1 AS BIGINT) AS first_id, CAST(count(*) AS BIGINT) AS last_id FROM ({_UPSERTED})"""
)
def books_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids given over two crawls run from one without gaps or repeats."""
    documents = samples.part_documents(spark, sf_dir)
    table = books.books_table(spark, scratch_dir(spark, "books"), buckets=16)
    for crawl in (documents, _second_crawl(documents)):
        books.apply_pages(table, samples.pages_of(crawl))
    return table.read().agg(
        F.count(F.lit(1)).alias("books"),
        F.count_distinct("id").alias("distinct_ids"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
    )


@query(f"WITH {_PART_BOOKS} SELECT * FROM part_books")
def books_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed JSON pages of 100 documents streamed into the table."""
    folder = scratch_dir(spark, "books")
    table = books.books_table(spark, f"{folder}/table", buckets=16)
    _stream_pages(spark, folder, samples.part_pages(spark, sf_dir), table)
    return _comparable(quality.expect_not_empty(table.read(), "books").drop("id", "created_at"))


def _stream_pages(spark: SparkSession, folder: str, pages: DataFrame, table: KeyedTable, files_per_batch: int = 1000) -> None:
    pages.write.json(f"{folder}/pages")
    writer = catalogue.ingest_pages(stream_pages(spark, f"{folder}/pages", files_per_batch), table, f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()


@query(_UPSERTED)
def books_batch_then_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first crawl as a batch, in several changes of the table, then a second one as a stream of several micro-batches."""
    folder = scratch_dir(spark, "books")
    documents = samples.part_documents(spark, sf_dir)
    table = books.books_table(spark, f"{folder}/table", buckets=16)
    for part in range(3):
        pages = samples.pages_of(documents.where(F.col("page_start") / 100 % 3 == part))
        books.apply_pages(table, pages)
    _stream_pages(spark, folder, samples.pages_of(_second_crawl(documents)).repartition(3), table, files_per_batch=1)
    return _comparable(table.read().drop("id", "created_at"))


@query("""SELECT '{broken ' || CAST(p_partkey AS VARCHAR) AS "value" FROM part WHERE p_partkey % 100 = 0""")
def pages_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that cannot be read are set aside by a batch load; the others are in the table."""
    folder = scratch_dir(spark, "books")
    samples.part_pages(spark, sf_dir).select(F.to_json(F.struct("start", "docs")).alias("value")).write.text(f"{folder}/pages")
    torn = samples.table(spark, sf_dir, "part").where("p_partkey % 100 = 0")
    torn.select(F.concat(F.lit("{broken "), F.col("p_partkey").cast("string")).alias("value")).write.mode("append").text(f"{folder}/pages")
    table = books.books_table(spark, f"{folder}/table", buckets=16)
    books.run_books(table, read_pages(spark, f"{folder}/pages"))
    return spark.read.parquet(table.dead_letters()).select(F.col("_corrupt_record").alias("value"))


@query(f"WITH {_PART_BOOKS} SELECT * FROM part_books")
def books_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed JSON pages read as a batch."""
    folder = scratch_dir(spark, "pages")
    samples.part_pages(spark, sf_dir).write.json(folder)
    rows = books.normalize(books.page_documents(read_pages(spark, folder)))
    return _comparable(rows.drop("page_start", "position"))


def _land_pages(documents: DataFrame, path: str) -> None:
    """One folder per page offset."""
    pages = samples.pages_of(documents).select("start", F.to_json(F.struct("start", "docs")).alias("value"))
    pages.repartition("start").write.mode("append").partitionBy("start").text(path)


@query(f"WITH {_PART_BOOKS} SELECT * FROM part_books")
def catalogue_scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue read by ranges of offsets, one task each."""
    folder = scratch_dir(spark, "scan")
    _land_pages(samples.part_documents(spark, sf_dir), folder)
    rows = books.normalize(books.page_documents(scanned_pages(spark, folder, pages_per_range=4)))
    return _comparable(rows.drop("page_start", "position"))


@query(f"WITH {_PART_BOOKS} SELECT * FROM part_books")
def catalogue_scan_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream that is stopped after half of the pages and started again when all have landed."""
    folder = scratch_dir(spark, "scan")
    documents = samples.part_documents(spark, sf_dir)
    middle = documents.agg(F.max("page_start")).first()[0] / 2
    table = books.books_table(spark, f"{folder}/table", buckets=8)
    for half in (F.col("page_start") < middle, F.col("page_start") >= middle):
        _land_pages(documents.where(half), f"{folder}/pages")
        pages = scanned_pages(spark, f"{folder}/pages", stream=True, pages_per_range=4, pages_per_batch=60, progress=f"{folder}/progress")
        running = catalogue.ingest_pages(pages, table, f"{folder}/checkpoint").trigger(processingTime="0 seconds").start()
        running.processAllAvailable()
        running.stop()
    return _comparable(table.read().drop("id", "created_at"))


# --- quality ----------------------------------------------------------------

@query(
    f"""WITH {m.SQL_ORDERS}, {m.SQL_DETAILS}, {m.SQL_CUSTOMERS}, {m.SQL_PAYMENTS}
    SELECT 'not_null:num_products' AS "check", 'orders' AS "table",
      CAST(count(*) FILTER (num_products IS NULL) AS BIGINT) AS violations FROM src_orders
    UNION ALL SELECT 'not_null:customer_id', 'orders', count(*) FILTER (customer_id IS NULL) FROM src_orders
    UNION ALL SELECT 'not_null:product_id', 'order_details', count(*) FILTER (product_id IS NULL) FROM src_details
    UNION ALL SELECT 'unique:id', 'orders', count(*) - count(DISTINCT id) FROM src_orders
    UNION ALL SELECT 'unique:order_id,product_id', 'order_details',
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT order_id, product_id FROM src_details)) FROM src_details
    UNION ALL SELECT 'foreign_key:customer_id', 'orders', count(*) FROM src_orders
      WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT id FROM src_customers)
    UNION ALL SELECT 'foreign_key:payment_method_id', 'orders', count(*) FROM src_orders
      WHERE payment_method_id IS NOT NULL AND payment_method_id NOT IN (SELECT id FROM src_payments)
    UNION ALL SELECT 'foreign_key:order_id', 'order_details', count(*) FROM src_details
      WHERE order_id IS NOT NULL AND order_id NOT IN (SELECT id FROM src_orders)"""
)
def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.model_checks(
        samples.orders(spark, sf_dir),
        samples.order_details(spark, sf_dir),
        samples.customers(spark, sf_dir),
        samples.payment_method(spark, sf_dir),
        order_key="id",
    )


@query(
    f"""WITH {m.SQL_DETAILS} SELECT d.* FROM src_details d ANTI JOIN (
      SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') ON o_orderkey = order_id"""
)
def orphan_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left without an order once the orders in status F are gone."""
    kept = samples.table(spark, sf_dir, "orders").where("o_orderstatus != 'F'")
    return quality.orphan_rows(samples.order_details(spark, sf_dir), "order_id", kept, "o_orderkey")


@query(
    f"""WITH {m.SQL_PAYMENTS} SELECT 'orders' AS "table", count(*) AS row_count FROM orders
    UNION ALL SELECT 'order_details', count(*) FROM lineitem
    UNION ALL SELECT 'customers', count(*) FROM customer
    UNION ALL SELECT 'payment_method', count(*) FROM src_payments"""
)
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.row_counts(
        {
            "orders": samples.orders(spark, sf_dir),
            "order_details": samples.order_details(spark, sf_dir),
            "customers": samples.customers(spark, sf_dir),
            "payment_method": samples.payment_method(spark, sf_dir),
        }
    )


_PROFILED = ("id", "timestamp", "customer_id", "payment_method_id", "num_products", "bronze_source")
_NUMBERS = ("id", "customer_id", "payment_method_id", "num_products")


@query(
    f"""WITH {m.SQL_ORDERS}, loads AS (SELECT * FROM src_orders UNION ALL
      SELECT id, "timestamp", customer_id, payment_method_id % 5 + 1, num_products FROM src_orders WHERE "timestamp" >= TIMESTAMP '2000-01-01 00:00:00'),
    counted AS (SELECT 'id' AS "column", count(*) AS rows, count(*) - count(id) AS nulls, count(DISTINCT id) AS n FROM loads
      UNION ALL SELECT 'timestamp', count(*), count(*) - count("timestamp"), count(DISTINCT "timestamp") FROM loads
      UNION ALL SELECT 'customer_id', count(*), count(*) - count(customer_id), count(DISTINCT customer_id) FROM loads
      UNION ALL SELECT 'payment_method_id', count(*), count(*) - count(payment_method_id), count(DISTINCT payment_method_id) FROM loads
      UNION ALL SELECT 'num_products', count(*), count(*) - count(num_products), count(DISTINCT num_products) FROM loads
      UNION ALL SELECT 'bronze_source', count(*), 0, CASE WHEN count(*) = 0 THEN 0 ELSE 1 END FROM loads)
    SELECT "column", rows, nulls, n AS distinct_count, true AS distinct_close,
      CASE WHEN "column" IN ('timestamp', 'bronze_source') THEN NULL ELSE true END AS median_close FROM counted"""
)
def dq_profile_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of two loads, merged without reading them again; exact counts beside the estimates, which lie within their bounds."""
    folder = scratch_dir(spark, "profiles")
    loads = m.bronze_orders(spark, sf_dir)
    for number, moment in enumerate((m.FIRST_LOAD, m.SECOND_LOAD)):
        one = loads.where(F.col("bronze_ingestion_time") == m.at(moment))
        profile.profile(one, _PROFILED).write.parquet(f"{folder}/load={number}")
    found = profile.summary(profile.merged(spark.read.parquet(folder).drop("load")), [0.5])

    medians = {r["column"]: r["quantiles"][0] for r in found.where("quantiles IS NOT NULL").collect()}  # one row per column
    bound = F.lit(profile.RANK_BOUND)
    exact = loads.agg(
        *[F.count_distinct(c).alias(c) for c in _PROFILED],
        *[
            ((F.avg((F.col(c) < medians[c]).cast("int")) <= 0.5 + bound) & (F.avg((F.col(c) <= medians[c]).cast("int")) >= 0.5 - bound)).alias(f"{c}_close")
            for c in _NUMBERS
        ],
    )
    facts = [
        F.struct(F.lit(c).alias("column"), F.col(c).alias("n"), (F.col(f"{c}_close") if c in _NUMBERS else F.lit(None).cast("boolean")).alias("median_close"))
        for c in _PROFILED
    ]
    beside = exact.select(F.explode(F.array(*facts)).alias("f")).select("f.*")
    close = F.abs(F.col("distinct_estimate") - F.col("n")) <= F.ceil(F.col("n") * profile.DISTINCT_BOUND)
    return found.join(beside, "column").select(
        "column", "rows", "nulls", F.col("n").alias("distinct_count"), close.alias("distinct_close"), "median_close"
    )


@query(
    """SELECT c_name AS name, 'id' AS "column", CAST(c_custkey AS VARCHAR) || 'x' AS "text" FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_name, 'updated_at', '2024-13-' || CAST(c_custkey % 28 + 1 AS VARCHAR) FROM customer WHERE c_custkey % 5 = 0
    UNION ALL SELECT c_name, 'balance', 'n/a' FROM customer WHERE c_custkey % 7 = 0"""
)
def dq_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of customers that are no id, time or amount, with their column; a missing text is no failure."""
    key = F.col("c_custkey")
    day = (key % 28 + 1).cast("string")
    text = samples.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"),
        F.when(key % 3 == 0, F.concat(key.cast("string"), F.lit("x"))).otherwise(key.cast("string")).alias("id"),
        F.when(key % 5 == 0, F.concat(F.lit("2024-13-"), day)).otherwise(F.concat(F.lit("2024-12-"), day)).alias("updated_at"),
        F.when(key % 7 == 0, F.lit("n/a")).when(key % 11 == 0, F.lit(" ")).otherwise(F.col("c_acctbal").cast("string")).alias("balance"),
    )
    judged = conversions.converted(text, {"id": "int", "updated_at": "timestamp", "balance": "decimal(12,2)"})
    return conversions.failures(judged, ["name"])
