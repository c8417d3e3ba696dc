"""Bronze, silver and gold queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.config import CUSTOMERS, ORDER_DETAILS, ORDERS, PAYMENT_METHOD, Layout
from ordermill.operators import members
from ordermill.operators.drift import NarrowingError
from ordermill.operators.ingest import add_load_columns, ingest
from ordermill.plans import bronze, bucketed, gold, increment, maintained, pipeline, reports, silver
from ordermill.session import scratch_dir
from ordermill.sinks.datasets import write_dataset
from ordermill.sinks.keyed import KeyedTable
from ordermill.sources import samples
from ordermill.sources.csvfiles import read_csv, usable
from ordermill.workload import model as m
from ordermill.workload.registry import query

CUT = "2001-01-01 00:00:00"


# --- bronze -----------------------------------------------------------------

def _bronze_select(source: str, label: str, loaded: str, moment: str | None = None) -> str:
    return f"""SELECT *, TIMESTAMP '{loaded}' AS bronze_ingestion_time,
      'mysql.project_db.{label}' AS bronze_source, {m.ymd(moment or f"TIMESTAMP '{loaded}'")}
      FROM {source}"""


@query(f"WITH {m.SQL_ORDERS} " + _bronze_select("src_orders", "orders", m.FIRST_LOAD, '"timestamp"'))
def bronze_orders_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_dir(spark, "bronze-orders")
    return ingest(samples.orders(spark, sf_dir), target, ORDERS, m.at(m.FIRST_LOAD)).frame


@query(
    f"WITH {m.SQL_ORDERS} "
    + _bronze_select(
        f"""(SELECT * FROM src_orders WHERE "timestamp" < TIMESTAMP '{CUT}')""",
        "orders", m.FIRST_LOAD, '"timestamp"')
    + " UNION ALL "
    + _bronze_select(
        f"""(SELECT * FROM src_orders WHERE "timestamp" > (
              SELECT max("timestamp") FROM src_orders WHERE "timestamp" < TIMESTAMP '{CUT}'))""",
        "orders", m.SECOND_LOAD, '"timestamp"')
)
def bronze_orders_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders before a cut, then whatever is above the target's mark."""
    target = scratch_dir(spark, "bronze-orders")
    source = samples.orders(spark, sf_dir)
    ingest(source.where(F.col("timestamp") < m.at(CUT)), target, ORDERS, m.at(m.FIRST_LOAD))
    return ingest(source, target, ORDERS, m.at(m.SECOND_LOAD)).frame


@query(f"WITH {m.SQL_ORDERS} " + _bronze_select("src_orders", "orders", m.FIRST_LOAD, '"timestamp"'))
def bronze_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second load with nothing new leaves the first."""
    target = scratch_dir(spark, "bronze-orders")
    source = samples.orders(spark, sf_dir)
    ingest(source, target, ORDERS, m.at(m.FIRST_LOAD))
    return ingest(source, target, ORDERS, m.at(m.SECOND_LOAD)).frame


@query(f"WITH {m.SQL_ORDERS} " + _bronze_select("src_orders", "orders", m.SECOND_LOAD, '"timestamp"'))
def bronze_null_hwm_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target without any time value is loaded in full."""
    target = scratch_dir(spark, "bronze-orders")
    source = samples.orders(spark, sf_dir)
    timeless = source.withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))
    ingest(timeless, target, ORDERS, m.at(m.FIRST_LOAD))
    return ingest(source, target, ORDERS, m.at(m.SECOND_LOAD)).frame


@query(f"WITH {m.SQL_DETAILS} " + _bronze_select("src_details", "order_details", m.SECOND_LOAD))
def bronze_details_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No time column: the second load replaces the first."""
    target = scratch_dir(spark, "bronze-details")
    source = samples.order_details(spark, sf_dir)
    ingest(source, target, ORDER_DETAILS, m.at(m.FIRST_LOAD))
    return ingest(source, target, ORDER_DETAILS, m.at(m.SECOND_LOAD)).frame


@query(
    f"WITH {m.SQL_CUSTOMERS} "
    + _bronze_select(
        "(SELECT * FROM src_customers WHERE updated_at <= TIMESTAMP '2024-01-01 00:10:00')",
        "customers", m.FIRST_LOAD)
    + " UNION ALL "
    + _bronze_select(
        "(SELECT * FROM src_customers WHERE updated_at > TIMESTAMP '2024-01-01 00:10:00')",
        "customers", m.SECOND_LOAD)
)
def bronze_customers_loaddate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers: mark on the update time, partitions by load date."""
    target = scratch_dir(spark, "bronze-customers")
    source = samples.customers(spark, sf_dir)
    early = source.where(F.col("updated_at") <= m.at("2024-01-01 00:10:00"))
    ingest(early, target, CUSTOMERS, m.at(m.FIRST_LOAD))
    return ingest(source, target, CUSTOMERS, m.at(m.SECOND_LOAD)).frame


@query(f"WITH {m.SQL_PAYMENTS} " + _bronze_select("src_payments", "payment_method", m.SECOND_LOAD))
def bronze_payment_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_dir(spark, "bronze-payments")
    source = samples.payment_method(spark, sf_dir)
    ingest(source, target, PAYMENT_METHOD, m.at(m.FIRST_LOAD))
    return ingest(source, target, PAYMENT_METHOD, m.at(m.SECOND_LOAD)).frame


@query(f"WITH {m.SQL_CUSTOMERS} SELECT * FROM src_customers")
def csv_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers through a CSV file with a header."""
    folder = scratch_dir(spark, "csv")
    samples.customers(spark, sf_dir).write.option("header", True).csv(folder)
    schema = "id BIGINT, name STRING, phone_number STRING, tier STRING, updated_at TIMESTAMP_NTZ"
    return usable(read_csv(spark, folder, schema))


@query(f"WITH {m.SQL_PAYMENTS} SELECT * FROM src_payments")
def csv_payment_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment methods through a CSV file that spells a missing bank ``null``."""
    folder = scratch_dir(spark, "csv")
    methods = samples.payment_method(spark, sf_dir)
    methods.write.option("header", True).option("nullValue", "null").csv(folder)
    return usable(read_csv(spark, folder, "id INT, method_name STRING, bank STRING"))


@query(
    """SELECT CAST(c_custkey AS VARCHAR) || 'x,"' || c_name || chr(10) || 'again",' || c_mktsegment AS "value"
    FROM customer WHERE c_custkey % 3 = 0"""
)
def csv_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id is no number are set aside as they came; all names are broken over two lines."""
    folder = scratch_dir(spark, "csv")
    key = F.col("c_custkey")
    number = F.when(key % 3 == 0, F.concat(key.cast("string"), F.lit("x"))).otherwise(key.cast("string"))
    name = F.concat("c_name", F.lit("\nagain"))
    rows = samples.table(spark, sf_dir, "customer").select(number.alias("id"), name.alias("name"), F.col("c_mktsegment").alias("tier"))
    rows.write.option("header", True).csv(f"{folder}/in")
    layout = Layout.under(folder)
    bronze.load_csv(spark, f"{folder}/in", "id INT, name STRING, tier STRING", CUSTOMERS, layout, m.at(m.FIRST_LOAD))
    return spark.read.parquet(bronze.csv_dead_letters(layout, CUSTOMERS)).select("value")


def _customer_loads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as the source had them first, and after its columns changed: wider ids, no phone, a new column."""
    first = samples.customers(spark, sf_dir).withColumn("id", F.col("id").cast("int"))
    later = samples.customers(spark, sf_dir).drop("phone_number").withColumns(
        {"id": F.col("id") + 3_000_000_000, "email": F.concat("name", F.lit("@example.com")), "updated_at": F.timestamp_add("DAY", F.lit(30), F.col("updated_at"))}
    )
    return first, later


@query(
    f"""WITH {m.SQL_CUSTOMERS}, loads AS (
      SELECT id, name, phone_number, tier, updated_at, CAST(NULL AS VARCHAR) AS email, TIMESTAMP '{m.FIRST_LOAD}' AS loaded FROM src_customers
      UNION ALL SELECT id + 3000000000, name, NULL, tier, updated_at + INTERVAL 30 DAY, name || '@example.com', TIMESTAMP '{m.SECOND_LOAD}'
      FROM src_customers)
    SELECT id, name, phone_number, tier, updated_at, email, loaded AS bronze_ingestion_time,
      'mysql.project_db.customers' AS bronze_source, {m.ymd("loaded")} FROM loads"""
)
def bronze_schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads read together: the second has wider ids, a column less and a column more; one with narrower ids is refused."""
    target = scratch_dir(spark, "bronze-drift")
    first, later = _customer_loads(spark, sf_dir)
    ingest(first, target, CUSTOMERS, m.at(m.FIRST_LOAD))
    found = ingest(later, target, CUSTOMERS, m.at(m.SECOND_LOAD))
    late = first.withColumn("updated_at", F.timestamp_add("DAY", F.lit(90), F.col("updated_at")))
    try:
        ingest(late, target, CUSTOMERS, m.at(m.STAMP))
    except NarrowingError:
        return found.frame
    raise AssertionError("a narrowing was not refused")


# --- silver -----------------------------------------------------------------

@query(f"WITH {m.SQL_SILVER_ORDERS} SELECT * FROM silver_orders")
def silver_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.silver_orders(spark, sf_dir)


@query(f"WITH {m.sql_silver_details()} SELECT * FROM silver_details")
def silver_order_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.silver_details(spark, sf_dir)


@query(f"WITH {m.sql_silver_details('coalesce(quantity, 1)')} SELECT * FROM silver_details")
def silver_order_details_preserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.silver_details(spark, sf_dir, "preserve")


@query(f"WITH {m.SQL_SILVER_CUSTOMERS} SELECT * FROM silver_customers")
def silver_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.silver_customers(spark, sf_dir)


@query(
    f"""WITH {m.SQL_PAYMENTS}
    SELECT *, TIMESTAMP '{m.SECOND_LOAD}' AS bronze_ingestion_time,
      'mysql.project_db.payment_method' AS bronze_source, 2024 AS year, 2 AS month, 2 AS day,
      TIMESTAMP '{m.STAMP}' AS silver_processed_time FROM src_payments"""
)
def silver_payment_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.silver_payments(spark, sf_dir)


# --- gold -------------------------------------------------------------------

_DIM_STAMPS = f"TIMESTAMP '{m.STAMP}' AS dim_created_at, TIMESTAMP '{m.STAMP}' AS dim_updated_at"


@query(
    f"""WITH {m.SQL_SILVER_CUSTOMERS}
    SELECT id AS customer_id, name AS customer_name, phone_number AS phone, tier AS customer_segment,
      updated_at, {_DIM_STAMPS} FROM silver_customers"""
)
def dim_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.dim_customer(m.silver_customers(spark, sf_dir), m.at(m.STAMP))


def _payment_dimension_sql(like: str) -> str:
    return f"""WITH {m.SQL_PAYMENTS}
    SELECT id AS payment_method_id, method_name, bank,
      CASE WHEN method_name {like} '%Credit%' THEN 'Credit Card'
           WHEN method_name {like} '%Debit%' THEN 'Debit Card'
           WHEN method_name {like} '%Cash%' THEN 'Cash' ELSE 'Other' END AS payment_type,
      1 AS is_active, {_DIM_STAMPS} FROM src_payments"""


@query(_payment_dimension_sql("LIKE"))
def dim_payment_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.dim_payment_method(m.silver_payments(spark, sf_dir), m.at(m.STAMP))


@query(_payment_dimension_sql("ILIKE"))
def dim_payment_method_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.dim_payment_method(m.silver_payments(spark, sf_dir), m.at(m.STAMP), normalize=True)


@query(
    f"""SELECT DISTINCT l_partkey AS product_id, 'Product_' || CAST(l_partkey AS VARCHAR) AS product_name,
      'General' AS category, 'Standard' AS subcategory, 'Unknown' AS brand, CAST(0 AS DOUBLE) AS price,
      'Active' AS product_status, {_DIM_STAMPS} FROM lineitem"""
)
def dim_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.dim_product(m.silver_details(spark, sf_dir), m.at(m.STAMP))


@query(f"WITH {m.SQL_CALENDAR} SELECT d.*, n AS order_count FROM dim_date d JOIN ("
       "SELECT CAST(o_orderdate AS DATE) AS od, count(*) AS n FROM orders GROUP BY 1) o ON od = \"date\"")
def dim_date_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar rows of days with orders."""
    days = samples.table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderdate").cast("date").alias("date")
    ).agg(F.count(F.lit(1)).alias("order_count"))
    return gold.dim_date(spark, *m.CALENDAR).join(days, "date")


_FACT = f"WITH {m.SQL_SILVER_ORDERS}, {m.sql_silver_details()}, {m.SQL_FACT_ORDERS}"


@query(f"{_FACT} SELECT * FROM fact_orders")
def fact_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.fact_orders(spark, sf_dir)


@query(f"{_FACT} SELECT * FROM fact_orders")
def fact_orders_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact written by order day and read back."""
    target = scratch_dir(spark, "fact-orders")
    write_dataset(m.fact_orders(spark, sf_dir), target, "overwrite", ("order_date_id",))
    return spark.read.parquet(target)


@query(
    f"""WITH {m.sql_silver_details('coalesce(quantity, 1)')}
    SELECT order_id, product_id, quantity, CAST(0 AS DOUBLE) AS unit_price, CAST(0 AS DOUBLE) AS line_total,
      TIMESTAMP '{m.STAMP}' AS fact_created_at FROM silver_details"""
)
def fact_order_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.fact_order_products(m.silver_details(spark, sf_dir, "preserve"), m.at(m.STAMP))


_PRICED = f"""WITH {m.SQL_SILVER_ORDERS}, {m.sql_silver_details('coalesce(quantity, 1)')}, {m.SQL_FACT_ORDERS},
priced AS (
  SELECT order_id, product_id, quantity, coalesce(CAST(p_retailprice AS DECIMAL(10,2)), 0) AS unit_price
  FROM silver_details LEFT JOIN part ON p_partkey = product_id)"""


def _priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = gold.fact_order_products(m.silver_details(spark, sf_dir, "preserve"), m.at(m.STAMP))
    return gold.price_lines(lines, samples.books(spark, sf_dir))


@query(
    f"""{_PRICED} SELECT order_id, product_id, quantity, CAST(unit_price AS DOUBLE) AS unit_price,
      CAST(unit_price * quantity AS DOUBLE) AS line_total, TIMESTAMP '{m.STAMP}' AS fact_created_at FROM priced"""
)
def fact_order_products_priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = _priced_lines(spark, sf_dir)
    return priced.withColumns(
        {c: F.col(c).cast("double") for c in ("unit_price", "line_total")}
    )


@query(
    f"""{_PRICED} SELECT f.* EXCLUDE (total_amount), CAST(coalesce(amount, 0) AS DOUBLE) AS total_amount
    FROM fact_orders f LEFT JOIN (
      SELECT order_id, sum(unit_price * quantity) AS amount FROM priced GROUP BY order_id) a
    ON a.order_id = f.order_id"""
)
def fact_orders_priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = m.fact_orders(spark, sf_dir, "preserve")
    priced = gold.price_orders(orders, _priced_lines(spark, sf_dir))
    return priced.withColumn("total_amount", F.col("total_amount").cast("double"))


# --- reports ----------------------------------------------------------------

@query(
    f"""{_FACT}, {m.SQL_SILVER_CUSTOMERS}, {m.SQL_CALENDAR}
    SELECT d.year, d.month, c.tier AS customer_segment, count(*) AS order_count,
      CAST(sum(product_count) AS BIGINT) AS product_count,
      CAST(sum(quantity_ordered) AS BIGINT) AS quantity_ordered
    FROM fact_orders f LEFT JOIN dim_date d ON d.date_id = f.order_date_id
    LEFT JOIN silver_customers c ON c.id = f.customer_id GROUP BY ALL"""
)
def orders_by_month_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = gold.dim_customer(m.silver_customers(spark, sf_dir), m.at(m.STAMP))
    dates = gold.dim_date(spark, *m.CALENDAR)
    return reports.orders_by_month_segment(m.fact_orders(spark, sf_dir), customers, dates)


@query(
    f"""{_FACT}, {m.SQL_PAYMENTS}, {m.SQL_CALENDAR}
    SELECT d.day_of_week, d.day_name, d.is_weekend,
      CASE WHEN p.id IS NULL THEN NULL
           WHEN method_name ILIKE '%Credit%' THEN 'Credit Card' WHEN method_name ILIKE '%Debit%' THEN 'Debit Card'
           WHEN method_name ILIKE '%Cash%' THEN 'Cash' ELSE 'Other' END AS payment_type,
      count(*) AS order_count, CAST(sum(quantity_ordered) AS BIGINT) AS quantity_ordered
    FROM fact_orders f LEFT JOIN dim_date d ON d.date_id = f.order_date_id
    LEFT JOIN src_payments p ON p.id = f.payment_method_id GROUP BY ALL"""
)
def sales_by_weekday_payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = gold.dim_payment_method(m.silver_payments(spark, sf_dir), m.at(m.STAMP), normalize=True)
    dates = gold.dim_date(spark, *m.CALENDAR)
    return reports.sales_by_weekday_payment(m.fact_orders(spark, sf_dir), methods, dates)


@query(
    f"""WITH {m.sql_silver_details('coalesce(quantity, 1)')}
    SELECT product_id, 'Product_' || CAST(product_id AS VARCHAR) AS product_name, count(*) AS line_count,
      CAST(sum(quantity) AS BIGINT) AS quantity FROM silver_details GROUP BY product_id"""
)
def product_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = m.silver_details(spark, sf_dir, "preserve")
    return reports.product_sales(
        gold.fact_order_products(details, m.at(m.STAMP)), gold.dim_product(details, m.at(m.STAMP))
    )


@query(
    f"""WITH {m.sql_dim_date('2024-01-01 00:00:00', '2027-12-31 00:00:00')}
    SELECT d.week_of_year, d.day_name, event_type, count(*) AS event_count,
      CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum
    FROM events LEFT JOIN dim_date d ON d."date" = CAST(ts AS DATE) GROUP BY ALL"""
)
def events_by_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table against the default calendar, with a JSON property summed."""
    events = samples.table(spark, sf_dir, "events").select(
        F.col("ts").cast("date").alias("date"),
        "event_type",
        F.from_json("props", "k BIGINT")["k"].alias("k"),
    )
    daily = events.groupBy("date", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("k").alias("k")
    )
    return (
        daily.join(gold.dim_date(spark).select("date", "week_of_year", "day_name"), "date", "left")
        .groupBy("week_of_year", "day_name", "event_type")
        .agg(F.sum("n").alias("event_count"), F.sum("k").alias("k_sum"))
    )


@query(
    f"""WITH {m.SQL_ORDERS}, {m.SQL_CUSTOMERS}, {m.SQL_PAYMENTS}
    SELECT o.id, o."timestamp", c.name, p.method_name, o.num_products FROM src_orders o
    JOIN src_customers c ON c.id = o.customer_id JOIN src_payments p ON p.id = o.payment_method_id
    ORDER BY o."timestamp" DESC, o.id DESC LIMIT 10"""
)
def order_customer_payment_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recent_orders(
        samples.order_heads(spark, sf_dir),
        samples.customers(spark, sf_dir),
        samples.payment_method(spark, sf_dir),
        lines=samples.order_details(spark, sf_dir),
    )


@query(
    f"""WITH {m.SQL_ORDERS} SELECT * FROM src_orders WHERE customer_id = 42
    ORDER BY "timestamp" DESC, id DESC LIMIT 1"""
)
def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.latest_order_of(samples.order_heads(spark, sf_dir), 42, samples.order_details(spark, sf_dir))


@query(
    """SELECT p_partkey AS id, p_name AS title, CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS DOUBLE) AS unit_price
    FROM part WHERE p_name IS NOT NULL AND p_retailprice IS NOT NULL ORDER BY p_partkey LIMIT 1500"""
)
def sellable_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.sellable_products(samples.books(spark, sf_dir))
    return found.withColumn("unit_price", F.col("unit_price").cast("double"))


# --- the stored star ---

_MONTHLY_FACT = m.SQL_FACT_ORDERS.replace("silver_orders o", "monthly o")


@query(
    f"""WITH {m.SQL_SILVER_ORDERS}, {m.sql_silver_details()}, {m.SQL_CALENDAR},
    monthly AS (SELECT * REPLACE (date_trunc('month', "timestamp") AS "timestamp") FROM silver_orders), {_MONTHLY_FACT}
    SELECT month, month_name, payment_method_id, count(*) AS order_count, CAST(sum(quantity_ordered) AS BIGINT) AS quantity_ordered
    FROM fact_orders JOIN dim_date ON date_id = order_date_id WHERE year = 1998 AND quarter = 3 GROUP BY ALL"""
)
def quarter_sales_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quarter of the stored fact; the orders of a month share its first day here, so that the folders are few."""
    folder = scratch_dir(spark, "star")
    month = F.date_trunc("month", "timestamp").cast("timestamp_ntz")
    monthly = gold.fact_orders(m.silver_orders(spark, sf_dir).withColumn("timestamp", month), m.silver_details(spark, sf_dir), m.at(m.STAMP))
    write_dataset(monthly, f"{folder}/fact", "overwrite", ("order_date_id",))
    write_dataset(gold.dim_date(spark, *m.CALENDAR), f"{folder}/dates")
    return reports.quarter_sales(spark.read.parquet(f"{folder}/fact"), spark.read.parquet(f"{folder}/dates"), 1998, 3)


@query(f"{_FACT} SELECT * FROM fact_orders")
def fact_orders_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact over bronze tables that lie in buckets by order: no line is shuffled after it was stored."""
    folder = scratch_dir(spark, "bucketed")
    orders = bucketed.store_by_order(m.bronze_orders(spark, sf_dir), f"{folder}/orders", "id", buckets=16)
    details = bucketed.store_by_order(m.bronze_order_details(spark, sf_dir), f"{folder}/details", "order_id", 16, ("product_id",))
    return bucketed.fact_orders(orders, details, m.at(m.STAMP), samples.DETAIL_TIES)


_REFRESHED = """TIMESTAMP '2024-02-01 00:00:00' AS dim_created_at, CASE WHEN c_custkey % 10 = 0 THEN TIMESTAMP '2024-02-02 00:00:00'
      ELSE TIMESTAMP '2024-02-01 00:00:00' END AS dim_updated_at"""


@query(
    f"""WITH {m.SQL_CUSTOMERS}
    SELECT id AS customer_id, name AS customer_name, phone_number AS phone,
      CASE WHEN id % 10 = 0 THEN 'MOVED' ELSE tier END AS customer_segment, updated_at, {_REFRESHED.replace("c_custkey", "id")}
    FROM src_customers WHERE id % 13 <> 0
    UNION ALL SELECT id + 1000000, name, phone_number, tier, updated_at, TIMESTAMP '2024-02-02 00:00:00', TIMESTAMP '2024-02-02 00:00:00'
    FROM src_customers WHERE id % 17 = 0"""
)
def dim_customer_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer dimension after two loads, the second with changed, vanished and new members, and a third without changes."""
    first = gold.dim_customer(samples.customers(spark, sf_dir), m.at(m.FIRST_LOAD))
    tenth = F.when(F.col("customer_id") % 10 == 0, F.lit("MOVED")).otherwise(F.col("customer_segment"))
    second = first.where("customer_id % 13 != 0").withColumn("customer_segment", tenth).unionByName(
        first.where("customer_id % 17 = 0").withColumn("customer_id", F.col("customer_id") + 1_000_000)
    )
    table = members.dimension(spark, scratch_dir(spark, "dim-customer"), first, "customer_id", buckets=16)
    for incoming, at in ((first, m.FIRST_LOAD), (second, m.SECOND_LOAD), (second, m.STAMP)):
        members.refresh(table, incoming, m.at(at))
    return members.members(table)


# --- increments ---

def _order_loads(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The two bronze loads of orders, cleaned each by itself."""
    loads = m.bronze_orders(spark, sf_dir)
    return [
        silver.clean_orders(loads.where(F.col("bronze_ingestion_time") == m.at(moment)), m.at(m.STAMP))
        for moment in (m.FIRST_LOAD, m.SECOND_LOAD)
    ]


def _silver_orders(spark: SparkSession, folder: str, loads: list[DataFrame]) -> KeyedTable:
    return increment.silver_table(spark, f"{folder}/silver-orders", loads[0], buckets=16)


@query(f"WITH {m.SQL_SILVER_ORDERS} SELECT * FROM silver_orders")
def silver_orders_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver orders after one load, then after the orders of a second one alone."""
    loads = _order_loads(spark, sf_dir)
    table = _silver_orders(spark, scratch_dir(spark, "increment"), loads)
    for load in loads:
        increment.apply_load(table, load, ["order_id"])
    return table.read()


_MONTHLY = m.SQL_FACT_ORDERS.replace("silver_orders o", "monthly o")


@query(
    f"""WITH {m.SQL_SILVER_ORDERS}, {m.sql_silver_details()},
    monthly AS (SELECT * REPLACE (date_trunc('month', "timestamp") AS "timestamp") FROM silver_orders), {_MONTHLY}
    SELECT * FROM fact_orders"""
)
def fact_orders_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored fact after a first load, then only the days of the second load's orders written again.

    The orders of a month share its first day here, so that the folders are few.
    """
    folder = scratch_dir(spark, "increment")
    month = F.date_trunc("month", "timestamp").cast("timestamp_ntz")
    loads = [load.withColumn("timestamp", month) for load in _order_loads(spark, sf_dir)]
    orders = _silver_orders(spark, folder, loads)
    lines = m.silver_details(spark, sf_dir)
    details = increment.silver_table(spark, f"{folder}/silver-details", lines, buckets=16)
    increment.apply_load(details, lines, ["order_id", "product_id"], samples.DETAIL_TIES)
    for load in loads:
        increment.apply_load(orders, load, ["order_id"])
        changed = increment.changed_orders([load])
        increment.refresh_fact_orders(f"{folder}/fact", orders, details, changed, m.at(m.STAMP))
    return spark.read.parquet(f"{folder}/fact")


# The second load of ``segment_months_maintained``: orders in P are 45 days later, those in O belong to the next customer, some have one
# more line, and every tenth customer is in another segment.
_MOVED_ORDERS = """moved AS (SELECT o_orderkey AS order_id,
      CASE o_orderstatus WHEN 'P' THEN o_orderdate + INTERVAL 45 DAY ELSE o_orderdate END AS moment,
      CASE o_orderstatus WHEN 'O' THEN o_custkey + 1 ELSE o_custkey END AS customer_id FROM orders),
    sizes AS (SELECT l_orderkey AS order_id, count(DISTINCT l_partkey) + CASE l_orderkey % 7 WHEN 0 THEN 1 ELSE 0 END AS n
      FROM lineitem GROUP BY l_orderkey)"""


def _moved(orders: DataFrame) -> DataFrame:
    later = F.timestamp_add("DAY", F.lit(45), F.col("timestamp"))
    return orders.select(
        *[
            {
                "timestamp": F.when(F.col("o_orderstatus") == "P", later).otherwise(F.col("timestamp")).alias("timestamp"),
                "customer_id": F.when(F.col("o_orderstatus") == "O", F.col("customer_id") + 1).otherwise(F.col("customer_id")).alias("customer_id"),
            }.get(c, F.col(c))
            for c in orders.columns
            if c != "o_orderstatus"
        ]
    )


@query(
    f"""WITH {m.SQL_CALENDAR}, {_MOVED_ORDERS}
    SELECT d.year, d.month, CASE c_custkey % 10 WHEN 0 THEN 'MOVED' ELSE c_mktsegment END AS customer_segment,
      count(*) AS order_count, CAST(sum(coalesce(n, 0)) AS BIGINT) AS product_count, CAST(sum(coalesce(n, 0)) AS BIGINT) AS quantity_ordered
    FROM moved LEFT JOIN dim_date d ON d."date" = CAST(moment AS DATE)
    LEFT JOIN customer ON c_custkey = customer_id LEFT JOIN sizes ON sizes.order_id = moved.order_id GROUP BY ALL"""
)
def segment_months_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per month and segment after a first load, and after one that moves and changes orders and customers."""
    folder = scratch_dir(spark, "maintained")
    status = samples.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    first = samples.orders(spark, sf_dir)
    second = _moved(first.join(status.where("o_orderstatus != 'F'"), "id"))
    lines = samples.order_details(spark, sf_dir)
    more = lines.where(F.col("order_id") % 7 == 0).dropDuplicates(["order_id"]).withColumn("product_id", F.lit(-1).cast("bigint"))
    customers = gold.dim_customer(samples.customers(spark, sf_dir), m.at(m.STAMP))
    tenth = F.when(F.col("customer_id") % 10 == 0, F.lit("MOVED")).otherwise(F.col("customer_segment"))
    dimension = [customers.limit(0), customers, customers.withColumn("customer_segment", tenth)]

    def landed(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    kept, orders, details = None, None, None
    for load, (head_rows, line_rows, at) in enumerate(((first, lines, m.FIRST_LOAD), (second, more, m.SECOND_LOAD))):
        heads = silver.clean_orders(add_load_columns(head_rows, ORDERS, m.at(at)), m.at(m.STAMP))
        items = silver.clean_order_details(add_load_columns(line_rows, ORDER_DETAILS, m.at(at)), m.at(m.STAMP), ties=samples.DETAIL_TIES)
        heads, items = landed(heads, f"heads-{load}"), landed(items, f"items-{load}")
        if kept is None:
            orders = increment.silver_table(spark, f"{folder}/orders", heads, buckets=8)
            details = increment.silver_table(spark, f"{folder}/details", items, buckets=8)
            kept = maintained.SegmentMonths(spark, f"{folder}/sums", gold.dim_date(spark, *m.CALENDAR), buckets=8)

        def apply(heads: DataFrame = heads, items: DataFrame = items) -> None:
            increment.apply_load(orders, heads, ["order_id"])
            increment.apply_load(details, items, ["order_id", "product_id"], samples.DETAIL_TIES)

        changed = increment.changed_orders([heads, items])
        kept.follow(load, orders, details, changed, apply, dimension[load], dimension[load + 1])
    return kept.read()


# --- the whole pipeline -----------------------------------------------------

@query(
    f"""WITH {m.SQL_PAYMENTS}, counts AS (
      SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM lineitem) AS l,
        (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM src_payments) AS p,
        (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) AS d,
        (SELECT count(DISTINCT l_partkey) FROM lineitem) AS b)
    SELECT 'bronze' AS layer, 'orders' AS "table", o AS row_count FROM counts
    UNION ALL SELECT 'bronze', 'order_details', l FROM counts
    UNION ALL SELECT 'bronze', 'customers', c FROM counts
    UNION ALL SELECT 'bronze', 'payment_method', p FROM counts
    UNION ALL SELECT 'silver', 'orders', o FROM counts
    UNION ALL SELECT 'silver', 'order_details', d FROM counts
    UNION ALL SELECT 'silver', 'customers', c FROM counts
    UNION ALL SELECT 'silver', 'payment_method', p FROM counts
    UNION ALL SELECT 'gold', 'dim_customer', c FROM counts
    UNION ALL SELECT 'gold', 'dim_payment_method', p FROM counts
    UNION ALL SELECT 'gold', 'dim_product', b FROM counts
    UNION ALL SELECT 'gold', 'dim_date', 1461 FROM counts
    UNION ALL SELECT 'gold', 'fact_orders', o FROM counts
    UNION ALL SELECT 'gold', 'fact_order_products', d FROM counts"""
)
def medallion_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze, silver and gold in sequence; rows written per table."""
    sources = {
        "orders": samples.orders,
        "order_details": samples.order_details,
        "customers": samples.customers,
        "payment_method": samples.payment_method,
    }
    layout = Layout.under(scratch_dir(spark, "medallion"))
    counts = pipeline.run_all(spark, lambda name: sources[name](spark, sf_dir), layout, m.at(m.STAMP))
    rows = [(layer, name, n) for layer, tables in counts.items() for name, n in tables.items()]
    return spark.createDataFrame(rows, "layer STRING, table STRING, row_count BIGINT")


def _medallion_twice(spark: SparkSession, sf_dir: str) -> Layout:
    """All layers, run before and after a cut in the orders, whose times are months here (a folder each)."""
    monthly = samples.orders(spark, sf_dir).withColumn("timestamp", F.date_trunc("month", "timestamp").cast("timestamp_ntz"))
    layout = Layout.under(scratch_dir(spark, "medallion"))
    for orders in (monthly.where(F.col("timestamp") < m.at(CUT)), monthly):
        sources = {
            "orders": orders,
            "order_details": samples.order_details(spark, sf_dir),
            "customers": samples.customers(spark, sf_dir),
            "payment_method": samples.payment_method(spark, sf_dir),
        }
        pipeline.run_all(spark, sources.__getitem__, layout, m.at(m.STAMP), samples.DETAIL_TIES)
    return layout


@query(
    f"""WITH {m.SQL_ORDERS}, {m.sql_silver_details()},
    silver_orders AS (SELECT * REPLACE (date_trunc('month', "timestamp") AS "timestamp"), id AS order_id FROM src_orders),
    {m.SQL_FACT_ORDERS} SELECT * FROM fact_orders"""
)
def medallion_fact_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order fact that the whole pipeline has written after an increment."""
    return spark.read.parquet(_medallion_twice(spark, sf_dir).fact("fact_orders"))


@query(
    f"""WITH {m.sql_silver_details()} SELECT * REPLACE (TIMESTAMP '{m.STAMP}' AS bronze_ingestion_time, 2024 AS year, 3 AS month, 1 AS day)
    FROM silver_details"""
)
def medallion_silver_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines that the whole pipeline has written to silver after an increment."""
    return spark.read.parquet(_medallion_twice(spark, sf_dir).silver_table("order_details"))
