"""Shared pieces of the queries: load times, two-load bronze frames and their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.config import CUSTOMERS, ORDER_DETAILS, ORDERS, PAYMENT_METHOD
from ordermill.operators.ingest import add_load_columns
from ordermill.plans import gold, silver
from ordermill.sources import samples

# Load and processing times are fixed so that results can be compared.
FIRST_LOAD = "2024-02-01 00:00:00"
SECOND_LOAD = "2024-02-02 00:00:00"
STAMP = "2024-03-01 00:00:00"

# The sample orders lie in this range.
CALENDAR = (date(1995, 1, 1), date(2001, 12, 31))


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def bronze_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, then those since 2000 loaded again with another payment method."""
    first = samples.orders(spark, sf_dir)
    again = first.where(F.col("timestamp") >= at("2000-01-01")).withColumn(
        "payment_method_id", F.col("payment_method_id") % 5 + 1
    )
    return _two_loads(first, again, ORDERS)


def bronze_order_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_load_columns(samples.order_details(spark, sf_dir), ORDER_DETAILS, at(FIRST_LOAD))


def bronze_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers, then those updated after ten minutes loaded again, renamed."""
    first = samples.customers(spark, sf_dir)
    again = first.where(F.col("updated_at") >= at("2024-01-01 00:10:00")).withColumn("name", F.upper("name"))
    return _two_loads(first, again, CUSTOMERS)


def bronze_payment_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = samples.payment_method(spark, sf_dir)
    return _two_loads(methods, methods, PAYMENT_METHOD)


def _two_loads(first: DataFrame, again: DataFrame, spec) -> DataFrame:
    return add_load_columns(first, spec, at(FIRST_LOAD)).unionByName(
        add_load_columns(again, spec, at(SECOND_LOAD))
    )


def silver_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.clean_orders(bronze_orders(spark, sf_dir), at(STAMP))


def silver_details(spark: SparkSession, sf_dir: str, policy: str = "constant") -> DataFrame:
    bronze = bronze_order_details(spark, sf_dir)
    return silver.clean_order_details(bronze, at(STAMP), policy, samples.DETAIL_TIES)


def silver_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.clean_customers(bronze_customers(spark, sf_dir), at(STAMP))


def silver_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.clean_payment_method(bronze_payment_method(spark, sf_dir), at(STAMP))


def fact_orders(spark: SparkSession, sf_dir: str, policy: str = "constant") -> DataFrame:
    return gold.fact_orders(
        silver_orders(spark, sf_dir), silver_details(spark, sf_dir, policy), at(STAMP)
    )


# --- the same pieces in SQL -------------------------------------------------

PAYMENT_ID = "CAST(substr(o_orderpriority, 1, 1) AS INTEGER)"


def ymd(moment: str) -> str:
    return (
        f"CAST(year({moment}) AS INTEGER) AS year, CAST(month({moment}) AS INTEGER) AS month, "
        f"CAST(day({moment}) AS INTEGER) AS day"
    )


SQL_ORDERS = f"""
src_orders AS (
  SELECT o_orderkey AS id, o_orderdate AS "timestamp", o_custkey AS customer_id,
         {PAYMENT_ID} AS payment_method_id, n AS num_products
  FROM orders LEFT JOIN (
    SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n FROM lineitem GROUP BY l_orderkey
  ) ON l_orderkey = o_orderkey)"""

SQL_DETAILS = """
src_details AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
         l_shipdate AS shipped_at, l_linenumber AS line_number, l_extendedprice AS subtotal
  FROM lineitem)"""

SQL_CUSTOMERS = """
src_customers AS (
  SELECT c_custkey AS id, c_name AS name,
         '555-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS phone_number, c_mktsegment AS tier,
         TIMESTAMP '2024-01-01 00:00:00' + c_custkey * INTERVAL 1 SECOND AS updated_at
  FROM customer)"""

SQL_PAYMENTS = f"""
src_payments AS (
  SELECT id, CASE id WHEN 1 THEN 'Credit Card' WHEN 2 THEN 'Debit Card' WHEN 3 THEN 'Cash'
                     WHEN 4 THEN 'credit' WHEN 5 THEN 'bank transfer' END AS method_name,
         CAST(NULL AS VARCHAR) AS bank
  FROM (SELECT DISTINCT {PAYMENT_ID} AS id FROM orders))"""

SQL_SILVER_ORDERS = f"""{SQL_ORDERS},
silver_orders AS (
  SELECT id AS order_id, "timestamp", customer_id,
         CASE WHEN again THEN payment_method_id % 5 + 1 ELSE payment_method_id END AS payment_method_id,
         num_products,
         CASE WHEN again THEN TIMESTAMP '{SECOND_LOAD}' ELSE TIMESTAMP '{FIRST_LOAD}' END
           AS bronze_ingestion_time,
         'mysql.project_db.orders' AS bronze_source, {ymd('"timestamp"')},
         TIMESTAMP '{STAMP}' AS silver_processed_time
  FROM (SELECT *, "timestamp" >= TIMESTAMP '2000-01-01 00:00:00' AS again FROM src_orders))"""


def sql_silver_details(quantity: str = "1") -> str:
    return f"""{SQL_DETAILS},
silver_details AS (
  SELECT order_id, product_id, {quantity} AS quantity, shipped_at, line_number, subtotal,
         TIMESTAMP '{FIRST_LOAD}' AS bronze_ingestion_time,
         'mysql.project_db.order_details' AS bronze_source,
         {ymd(f"TIMESTAMP '{FIRST_LOAD}'")}, TIMESTAMP '{STAMP}' AS silver_processed_time
  FROM (SELECT *, row_number() OVER (PARTITION BY order_id, product_id
          ORDER BY shipped_at DESC, line_number DESC, subtotal DESC, quantity DESC) AS rn
        FROM src_details) WHERE rn = 1)"""


SQL_SILVER_CUSTOMERS = f"""{SQL_CUSTOMERS},
silver_customers AS (
  SELECT id, CASE WHEN again THEN upper(name) ELSE name END AS name, phone_number, tier, updated_at,
         CASE WHEN again THEN TIMESTAMP '{SECOND_LOAD}' ELSE TIMESTAMP '{FIRST_LOAD}' END
           AS bronze_ingestion_time,
         'mysql.project_db.customers' AS bronze_source,
         2024 AS year, 2 AS month, CASE WHEN again THEN 2 ELSE 1 END AS day,
         TIMESTAMP '{STAMP}' AS silver_processed_time
  FROM (SELECT *, updated_at >= TIMESTAMP '2024-01-01 00:10:00' AS again FROM src_customers))"""

SQL_FACT_ORDERS = f"""
fact_orders AS (
  SELECT o.order_id, customer_id, payment_method_id,
         CAST(strftime("timestamp", '%Y%m%d') AS INTEGER) AS order_date_id,
         coalesce(product_count, 0) AS product_count,
         coalesce(num_products, 0) AS expected_products,
         coalesce(total_quantity, 0) AS quantity_ordered,
         CAST(0 AS DOUBLE) AS total_amount, 'completed' AS order_status,
         "timestamp" AS created_timestamp, TIMESTAMP '{STAMP}' AS fact_created_at
  FROM silver_orders o LEFT JOIN (
    SELECT order_id, count(product_id) AS product_count, CAST(sum(quantity) AS BIGINT) AS total_quantity
    FROM silver_details GROUP BY order_id) a ON a.order_id = o.order_id)"""


def sql_dim_date(first: str, last: str) -> str:
    return f"""
dim_date AS (
  SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_id, CAST(d AS DATE) AS "date",
         CAST(year(d) AS INTEGER) AS "year", CAST(quarter(d) AS INTEGER) AS "quarter",
         CAST(month(d) AS INTEGER) AS "month", monthname(d) AS month_name,
         CAST(day(d) AS INTEGER) AS "day", CAST(isodow(d) AS INTEGER) AS day_of_week,
         dayname(d) AS day_name, CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS is_weekend,
         0 AS is_holiday, CAST(weekofyear(d) AS INTEGER) AS week_of_year
  FROM (SELECT unnest(generate_series(TIMESTAMP '{first}', TIMESTAMP '{last}', INTERVAL 1 DAY)) AS d))"""


SQL_CALENDAR = sql_dim_date(f"{CALENDAR[0]} 00:00:00", f"{CALENDAR[1]} 00:00:00")
