"""The benchmark tables in the shape of the retail entities, in Spark and as SQL views of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("first_name"), F.lit("x").alias("last_name"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"), F.col("c_nationkey").cast("string").alias("city"),
        F.lit("CO").alias("country"), F.col("c_mktsegment").alias("segment"), F.lit(None).cast("date").alias("signup_date"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"), (F.col("c_custkey") % 97 == 0).alias("is_deleted"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("p_partkey") % 3 == 0, "active").when(F.col("p_partkey") % 3 == 1, "inactive").otherwise("discontinued")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"),
        F.col("p_name").alias("product_name"), F.col("p_brand").alias("category"), F.col("p_retailprice").cast(MONEY).alias("unit_price"),
        status.alias("product_status"), (F.col("p_partkey") % 101 == 0).alias("is_deleted"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "cancelled").when(F.col("o_orderstatus") == "F", "delivered").otherwise("paid")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("order_date"),
        F.lower("o_orderpriority").alias("sales_channel"), status.alias("order_status"), F.col("o_totalprice").cast(MONEY).alias("order_total"),
        F.col("o_orderdate").alias("updated_at"), (F.col("o_orderkey") % 89 == 0).alias("is_deleted"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_item_id"), F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("unit_price"), F.col("l_extendedprice").cast(MONEY).alias("line_total"),
        F.col("l_shipdate").alias("updated_at"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 53 == 0).alias("is_deleted"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    extra = F.when(F.col("order_id") % 50 == 0, F.lit("0.05").cast(MONEY)).otherwise(F.lit("0.00").cast(MONEY))
    paid = F.when(F.col("order_status") != "cancelled", F.col("order_date"))
    return o.select(
        F.col("order_id").alias("payment_id"), "order_id", (F.col("order_total") + extra).cast(MONEY).alias("amount"),
        paid.alias("payment_date"), "updated_at", F.lit(False).alias("is_deleted"),
    )


#: The same entities as common table expressions; SQL on the left of what the functions above do.
VIEWS = """
customers AS (SELECT c_custkey AS customer_id, c_name AS first_name, 'x' AS last_name, lower(c_name) || '@example.com' AS email,
  CAST(c_nationkey AS VARCHAR) AS city, 'CO' AS country, c_mktsegment AS segment, CAST(NULL AS DATE) AS signup_date,
  CAST(NULL AS TIMESTAMP) AS updated_at, c_custkey % 97 = 0 AS is_deleted FROM customer),
products AS (SELECT p_partkey AS product_id, 'SKU-' || CAST(p_partkey AS VARCHAR) AS sku, p_name AS product_name, p_brand AS category,
  CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price,
  CASE p_partkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'inactive' ELSE 'discontinued' END AS product_status,
  p_partkey % 101 = 0 AS is_deleted FROM part),
ords AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date, lower(o_orderpriority) AS sales_channel,
  CASE o_orderstatus WHEN 'P' THEN 'cancelled' WHEN 'F' THEN 'delivered' ELSE 'paid' END AS order_status,
  CAST(o_totalprice AS DECIMAL(18,2)) AS order_total, o_orderdate AS updated_at, o_orderkey % 89 = 0 AS is_deleted FROM orders),
items AS (SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id, l_partkey AS product_id,
  CAST(l_quantity AS INTEGER) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS unit_price,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS line_total, l_shipdate AS updated_at,
  (l_orderkey * 7 + l_linenumber) % 53 = 0 AS is_deleted FROM lineitem),
pays AS (SELECT order_id AS payment_id, order_id, CAST(order_total + CASE WHEN order_id % 50 = 0 THEN 0.05 ELSE 0.00 END AS DECIMAL(18,2)) AS amount,
  CASE WHEN order_status <> 'cancelled' THEN order_date END AS payment_date, updated_at, FALSE AS is_deleted FROM ords)
"""
