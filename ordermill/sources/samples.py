"""The order model over the sample star-schema tables.

Column mapping only: ids, times and names come straight from the tables, and
attributes the tables lack are derived from a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Payment names by the leading digit of the order priority.
PAYMENT_NAMES = {1: "Credit Card", 2: "Debit Card", 3: "Cash", 4: "credit", 5: "bank transfer"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _payment_id() -> Column:
    return F.substring("o_orderpriority", 1, 1).cast("int")


def order_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without their sizes."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_custkey").alias("customer_id"),
        _payment_id().alias("payment_method_id"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders; ``num_products`` counts the order's lines."""
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count(F.lit(1)).cast("int").alias("num_products")
    )
    return order_heads(spark, sf_dir).join(sizes, "id", "left")


def order_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_shipdate").alias("shipped_at"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_extendedprice").alias("subtotal"),
    )


# Order lines carry no id here; these columns settle which duplicate is newest.
DETAIL_TIES = ("shipped_at", "line_number", "subtotal", "quantity")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers; phone and update time follow from the id."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("555-"), F.lpad(key.cast("string"), 9, "0")).alias("phone_number"),
        F.col("c_mktsegment").alias("tier"),
        F.timestamp_add("SECOND", key, F.lit("2024-01-01").cast("timestamp_ntz")).alias("updated_at"),
    )


def payment_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F
    for number, text in PAYMENT_NAMES.items():
        name = name.when(F.col("id") == number, F.lit(text))
    ids = table(spark, sf_dir, "orders").select(_payment_id().alias("id")).distinct()
    return ids.select("id", name.alias("method_name"), F.lit(None).cast("string").alias("bank"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("unit_price"),
    )


def _micros(moment: str) -> Column:
    return F.unix_micros(F.col(moment).cast("timestamp"))


def completion_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order events. The announced size is the priority digit, so that some orders stay
    short of it, some meet it and some pass it."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        _payment_id().alias("payment_method_id"),
        _payment_id().alias("num_products"),
        _micros("o_orderdate").alias("seq"),
    )


# Microseconds by which the first announcement of an order lies ahead of its update: thirty days.
ANNOUNCED_AHEAD = 30 * 86_400 * 1_000_000


def announced_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order events: each order is announced ahead with another size, then updated to its own."""
    own = completion_orders(spark, sf_dir)
    ahead = own.withColumns({"num_products": F.col("num_products") % 5 + 1, "seq": F.col("seq") - ANNOUNCED_AHEAD})
    return ahead.unionByName(own)


def completion_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item events at their ship day, within a day by line and product."""
    within_day = F.lit(1) + F.col("l_linenumber") * F.lit(8_000_000_000) + F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        (_micros("l_shipdate") + within_day).alias("seq"),
    )


def _message(after: Column, before: Column, op: Column, file: Column, pos: Column, table_name: str) -> Column:
    source = F.struct(
        F.lit("project_db").alias("db"), F.lit(table_name).alias("table"), file.alias("file"), pos.alias("pos")
    )
    payload = F.struct(before.alias("before"), after.alias("after"), op.alias("op"), source.alias("source"))
    return F.to_json(F.struct(payload.alias("payload")), {"ignoreNullFields": "false"})


def _order_image(payment: Column) -> Column:
    return F.struct(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("int").alias("customer_id"),
        F.lit(1).alias("store_id"),
        payment.alias("payment_method_id"),
        _payment_id().alias("num_products"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("timestamp"),
    )


def order_messages(spark: SparkSession, sf_dir: str, twice: bool = False) -> DataFrame:
    """Create events of all orders, in order time; ``twice`` as in ``announced_twice``."""
    image, place = _order_image(_payment_id()), _micros("o_orderdate")
    none, heads = F.when(F.lit(False), image), table(spark, sf_dir, "orders")

    def messages(after: Column, before: Column, op: str, seq: Column) -> DataFrame:
        text = _message(after, before, F.lit(op), F.lit("mysql-bin.000001"), F.col("o_orderkey"), "orders")
        return heads.select(text.alias("value"), seq.alias("seq"))

    if not twice:
        return messages(image, none, "c", place)
    ahead = image.withField("num_products", _payment_id() % 5 + 1)
    return messages(ahead, none, "c", place - ANNOUNCED_AHEAD).unionByName(messages(image, ahead, "u", place))


def order_change_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three log files: all orders created, those in status P re-paid, those in F deleted."""
    heads = table(spark, sf_dir, "orders")
    image = _order_image(_payment_id())
    repaid = _order_image(_payment_id() % 5 + 1)
    none = F.when(F.lit(False), image)
    steps = (
        (heads, image, none, "c", "mysql-bin.000001"),
        (heads.where("o_orderstatus = 'P'"), repaid, image, "u", "mysql-bin.000002"),
        (heads.where("o_orderstatus = 'F'"), none, image, "d", "mysql-bin.000003"),
    )
    frames = [
        rows.select(
            _message(after, before, F.lit(op), F.lit(file), F.col("o_orderkey"), "orders").alias("value"),
            F.col("o_orderkey").alias("seq"),
        )
        for rows, after, before, op, file in steps
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def later_change_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes after ``order_change_messages``: orders in status O re-paid, in a log file whose number has gained a
    digit; the create events of all orders once more, now out of date; and messages nothing can be done with, by priority."""
    heads = table(spark, sf_dir, "orders")
    image, repaid = _order_image(_payment_id()), _order_image(_payment_id() % 5 + 1)
    none = F.when(F.lit(False), image)
    anonymous = image.withField("id", F.lit(None).cast("string"))

    def events(rows: DataFrame, after: Column, before: Column, op: str, file: str) -> DataFrame:
        text = _message(after, before, F.lit(op), F.lit(file), F.col("o_orderkey"), "orders")
        return rows.select(text.alias("value"), F.col("o_orderkey").alias("seq"))

    late = events(heads.where("o_orderstatus = 'O'"), repaid, image, "u", "mysql-bin.1000000")
    stale = events(heads, image, none, "c", "mysql-bin.000001")
    nameless = events(heads.where(_payment_id() == 1), anonymous, none, "c", "mysql-bin.000009")
    torn = heads.where(_payment_id() == 2).select(F.lit("{").alias("value"), F.col("o_orderkey").alias("seq"))
    return late.unionByName(stale).unionByName(nameless).unionByName(torn)


HOUR = 3_600_000_000


def arrival_messages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders and lines by time: a line comes its number of hours after the order date; of the orders those in O come at that date, those in P
    twelve hours later or, from priority 3 on, three days later, and those in F not at all."""
    heads = table(spark, sf_dir, "orders")
    delay = F.when(F.col("o_orderstatus") == "O", 0).when(_payment_id() < 3, 12).otherwise(72)
    order = _order_image(_payment_id())
    text = _message(order, F.when(F.lit(False), order), F.lit("c"), F.lit("mysql-bin.000001"), F.col("o_orderkey"), "orders")
    orders = heads.where("o_orderstatus != 'F'").select(text.alias("value"), (_micros("o_orderdate") + delay * F.lit(HOUR)).alias("seq"))

    lines = table(spark, sf_dir, "lineitem").join(
        heads.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey"
    )
    line = F.struct(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_partkey").cast("int").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )
    text = _message(line, F.when(F.lit(False), line), F.lit("c"), F.lit("mysql-bin.000001"), F.col("l_orderkey"), "order_details")
    return orders, lines.select(text.alias("value"), (_micros("o_orderdate") + F.col("l_linenumber") * F.lit(HOUR)).alias("seq"))


# Places per order in one log file; an order's own change is the first of them, its deletion the last.
LOG_STRIDE = 10_000_000


def joint_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log of three files over orders and lines: ``topic``, ``value``, ``seq``, ``partition``, ``log`` and ``pos``.

    All orders are created, each followed by its lines (one per product, lines with one product added up); orders in status P are re-paid
    and get one more of each product; orders in F go, after their lines. Lines are in two partitions by order.
    """
    heads = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(
        F.sum(F.col("l_quantity").cast("int")).cast("int").alias("n")
    )
    lines = lines.join(heads.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    of_order, of_line = F.col("o_orderkey") * LOG_STRIDE, F.col("l_orderkey") * LOG_STRIDE + 1 + F.col("l_partkey")

    def line_image(quantity: Column) -> Column:
        return F.struct(
            F.col("l_orderkey").cast("string").alias("order_id"),
            F.col("l_partkey").cast("int").alias("product_id"),
            quantity.alias("quantity"),
        )

    order, repaid = _order_image(_payment_id()), _order_image(_payment_id() % 5 + 1)
    line, more = line_image(F.col("n")), line_image(F.col("n") + 1)
    no_order, no_line = F.when(F.lit(False), order), F.when(F.lit(False), line)
    changed, gone = F.col("o_orderstatus") == "P", F.col("o_orderstatus") == "F"
    steps = (
        (heads, "orders", order, no_order, "c", 1, of_order),
        (lines, "order_details", line, no_line, "c", 1, of_line),
        (heads.where(changed), "orders", repaid, order, "u", 2, of_order),
        (lines.where(changed), "order_details", more, line, "u", 2, of_line),
        (lines.where(gone), "order_details", no_line, line, "d", 3, of_line),
        (heads.where(gone), "orders", no_order, order, "d", 3, of_order + LOG_STRIDE - 1),
    )
    frames = []
    for rows, topic, after, before, op, log, pos in steps:
        partition = F.lit(0) if topic == "orders" else F.pmod("l_orderkey", F.lit(2))
        text = _message(after, before, F.lit(op), F.lit(f"mysql-bin.{log:06d}"), pos, topic)
        frames.append(
            rows.select(
                F.lit(topic).alias("topic"),
                text.alias("value"),
                pos.alias("seq"),
                partition.cast("int").alias("partition"),
                F.lit(log).cast("bigint").alias("log"),
                pos.alias("pos"),
            )
        )
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def broken_order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create events spoiled in one of four ways, or not at all, by priority."""
    heads = table(spark, sf_dir, "orders")
    image = _order_image(_payment_id())
    nobody = image.withField("customer_id", F.lit(None).cast("int"))
    where = (F.lit("c"), F.lit("mysql-bin.000001"), F.col("o_orderkey"), "orders")
    none = F.when(F.lit(False), image)
    good = _message(image, none, *where)
    value = (
        F.when(_payment_id() == 1, F.substring(good, F.lit(1), F.length(good) - 3))
        .when(_payment_id() == 2, F.lit(None).cast("string"))
        .when(_payment_id() == 3, F.lit('{"schema": {}}'))
        .when(_payment_id() == 4, _message(nobody, none, *where))
        .otherwise(good)
    )
    return heads.select(value.alias("value"), F.col("o_orderkey").alias("seq"))


def detail_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create events of all order lines, with the places of ``completion_details``."""
    image = F.struct(
        F.col("order_id").cast("string").alias("order_id"), F.col("product_id").cast("int").alias("product_id")
    )
    none = F.when(F.lit(False), image)
    return completion_details(spark, sf_dir).select(
        _message(image, none, F.lit("c"), F.lit("mysql-bin.000001"), F.col("seq"), "order_details").alias("value"),
        "seq",
    )


def part_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue documents of the parts, 100 per page by part number."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        (F.floor(key / 100) * 100).cast("bigint").alias("page_start"),
        (key % 100).cast("int").alias("position"),
        F.struct(
            F.concat(F.lit("/works/OL"), key.cast("string"), F.lit("W")).alias("key"),
            F.col("p_name").alias("title"),
            F.split("p_type", " ").alias("author_name"),
            F.array(F.col("p_brand")).alias("author_key"),
            (F.col("p_size") + 1970).cast("int").alias("first_publish_year"),
            F.array(F.lpad(key.cast("string"), 13, "9")).alias("isbn"),
            F.array(F.lit("eng"), F.lit(None).cast("string")).alias("language"),
            (key % 3).alias("cover_i"),
        ).alias("doc"),
    )


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents as landed pages of up to 100."""
    return pages_of(part_documents(spark, sf_dir))


def pages_of(documents: DataFrame) -> DataFrame:
    placed = F.sort_array(F.collect_list(F.struct("position", "doc")))
    pages = documents.groupBy(F.col("page_start").alias("start")).agg(placed.alias("placed"))
    return pages.select("start", F.col("placed.doc").alias("docs"))


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue documents whose title and author list are whole texts."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_start"),
        F.lit(0).alias("position"),
        F.struct(
            F.concat(F.lit("/works/D"), F.col("doc_id").cast("string")).alias("key"),
            F.col("text").alias("title"),
            F.split("text", " ").alias("author_name"),
            F.array().cast("array<string>").alias("author_key"),
            F.lit(0).alias("first_publish_year"),
            F.array(F.col("source")).alias("isbn"),
            F.array(F.col("lang")).alias("language"),
            F.col("n_chars").alias("cover_i"),
        ).alias("doc"),
    )
