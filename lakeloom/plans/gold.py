"""The star schema: dimensions, the sales fact, the daily aggregate and the KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.columns import date_key
from lakeloom.operators import history

CUSTOMER = ("customer_id", "first_name", "last_name", "email", "city", "country", "segment", "signup_date", "updated_at", "is_deleted")
PRODUCT = ("product_id", "sku", "product_name", "category", "unit_price", "product_status", "is_deleted")


def dim_customers(customers: DataFrame) -> DataFrame:
    return customers.select(F.col("customer_id").alias("customer_key"), *CUSTOMER)


def dim_customers_history(changes: DataFrame) -> DataFrame:
    """Versions of customers by segment; a deletion closes the last one."""
    spread = history.spread_for(changes, ["customer_id"])
    return history.scd2(changes, ["customer_id"], ["segment"], deleted="is_deleted", spread=spread)


def dim_products(products: DataFrame) -> DataFrame:
    return products.select(F.col("product_id").alias("product_key"), *PRODUCT)


def dim_date(orders: DataFrame) -> DataFrame:
    """One row for each date that has an order."""
    d = F.col("date_day")
    return orders.select(F.to_date("order_date").alias("date_day")).distinct().select(
        d, date_key(d).alias("date_key"), F.year(d).alias("year"), F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"),
        F.dayofmonth(d).alias("day"), F.date_format(d, "EEEE").alias("day_of_week"), F.quarter(d).alias("quarter"),
    )


def fact_sales(items: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per item with an order, deleted and cancelled ones too; is_deleted is the item's."""
    heads = orders.select("order_id", "customer_id", date_key(F.to_date("order_date")).alias("date_key"), "sales_channel", "order_status")
    return items.join(heads, "order_id").select(
        F.col("order_item_id").alias("sales_item_key"), "order_item_id", "order_id", "customer_id", "product_id", "date_key",
        "sales_channel", "order_status", "quantity", "unit_price", F.col("line_total").alias("revenue"), "is_deleted",
    )


def agg_daily_sales(fact: DataFrame, products: DataFrame) -> DataFrame:
    """Sales per day, current category and channel. total_orders is a distinct count and doesn't add up over groups.

    Lines are summed per order and group first: where the fact comes from a join by order that needs no shuffle of its
    own, and the orders of a group are then counted like any other sum.
    """
    dims = products.select(F.col("product_key").alias("product_id"), "category")
    lines = fact.select("product_id", "date_key", "sales_channel", "order_id", "quantity", "revenue").join(dims, "product_id")
    per_order = lines.groupBy("order_id", "date_key", "category", "sales_channel").agg(F.sum("quantity").alias("q"), F.sum("revenue").alias("r"))
    return per_order.groupBy("date_key", "category", "sales_channel").agg(
        F.count("order_id").alias("total_orders"), F.sum("q").alias("total_items_sold"), F.sum("r").alias("total_revenue")
    )


def kpi_sales(fact: DataFrame) -> DataFrame:
    """Totals over live sales that aren't cancelled; null flags and statuses are left out, no sales give null averages."""
    sold = fact.where(~F.col("is_deleted") & ~F.col("order_status").isin("cancelled", "canceled"))
    totals = sold.agg(
        F.sum("revenue").alias("total_revenue"), F.countDistinct("order_id").alias("total_orders"), F.sum("quantity").alias("total_items_sold")
    )
    average = F.round(F.col("total_revenue") / F.nullif("total_orders", F.lit(0)), 2)
    return totals.withColumn("average_order_value", average)
