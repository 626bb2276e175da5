"""A synthetic store: the six source tables from row numbers and hashes, the same rows each time, at any size.

Times count back from a given date, so that nothing depends on the clock.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(14,2)"
#: Shares of each hundred rows.
SEGMENTS = (("Regular", 72), ("Premium", 23), ("Business", 5))
CHANNELS = (("web", 50), ("app", 35), ("store", 15))
ORDER_STATUS = (("created", 3), ("paid", 7), ("shipped", 15), ("delivered", 68), ("cancelled", 7))
COUNTRIES = (("CO", 50), ("MX", 20), ("CL", 12), ("PE", 10), ("AR", 8))
CATEGORIES = ("Pantry", "Dairy", "Drinks", "Home", "Produce", "Bakery")


def _draw(seed: int, *of: Column) -> Column:
    """A number below 100 that the seed and the columns fix."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(100))


def _pick(drawn: Column, shares: tuple[tuple[str, int], ...]) -> Column:
    out, below = F.lit(None).cast("string"), 100
    for name, share in reversed(shares):
        out = F.when(drawn < below, F.lit(name)).otherwise(out)
        below -= share
    return out


def _before(end: datetime, hours: Column) -> Column:
    return F.timestamp_seconds(F.lit(int(end.timestamp())) - hours * 3600)


def store(spark: SparkSession, end: datetime, customers: int = 60, products: int = 24, orders: int = 120, tickets: int = 40, seed: int = 2026) -> dict[str, DataFrame]:
    """The six tables. Items follow from orders, an order's total is the sum of its items, each order has a payment."""
    i = F.col("id")

    def stamped(df: DataFrame, age: Column) -> DataFrame:
        at = _before(end, age)
        return df.withColumns({"created_at": at, "updated_at": at, "is_deleted": F.lit(False)}).drop("id")

    rows = lambda n: spark.range(1, n + 1)
    people = rows(customers).select(
        "id", i.alias("customer_id"), F.format_string("Name%d", i).alias("first_name"), F.format_string("Surname%d", i).alias("last_name"),
        F.format_string("customer%d@example.com", i).alias("email"), F.when(_draw(seed, i) < 80, F.format_string("300%07d", i)).alias("phone"),
        F.format_string("City%d", i % 9).alias("city"), _pick(_draw(seed + 1, i), COUNTRIES).alias("country"),
        _pick(_draw(seed + 2, i), SEGMENTS).alias("segment"), F.to_date(_before(end, i * 24)).alias("signup_date"),
    )
    price = lambda p: (F.pmod(F.xxhash64(F.lit(seed + 3), p), F.lit(5000)) / 100 + 1).cast(MONEY)
    goods = rows(products).select(
        "id", i.alias("product_id"), F.format_string("SKU-%05d", i).alias("sku"), F.format_string("Product %d", i).alias("product_name"),
        F.element_at(F.array(*map(F.lit, CATEGORIES)), (i % len(CATEGORIES) + 1).cast("int")).alias("category"), price(i).alias("unit_price"),
        F.lit(None).cast("string").alias("product_description"), F.when(i % 8 == 0, "inactive").otherwise("active").alias("product_status"),
    )
    slots = F.sequence(F.lit(0), F.pmod(F.xxhash64(F.lit(seed + 4), i), F.lit(3)).cast("int"))
    lines = rows(orders).select("id", i.alias("order_id"), F.explode(slots).alias("slot"))
    product = (F.pmod(F.xxhash64(F.lit(seed + 5), "order_id"), F.lit(products)) + F.col("slot")) % products + 1
    lines = lines.withColumn("product_id", product).withColumn("quantity", (F.pmod(F.xxhash64(F.lit(seed + 6), "order_id", "slot"), F.lit(3)) + 1).cast("int"))
    lines = lines.withColumn("unit_price", price(F.col("product_id"))).select(
        "id", (F.col("order_id") * 10 + F.col("slot")).alias("order_item_id"), "order_id", "product_id", "quantity", "unit_price",
        (F.col("quantity") * F.col("unit_price")).cast(MONEY).alias("line_total"),
    )
    totals = lines.groupBy("order_id").agg(F.sum("line_total").cast(MONEY).alias("order_total"))
    status = _pick(_draw(seed + 7, i), ORDER_STATUS)
    heads = rows(orders).select(
        "id", i.alias("order_id"), (F.pmod(F.xxhash64(F.lit(seed + 8), i), F.lit(customers)) + 1).alias("customer_id"),
        _before(end, i * 5).alias("order_date"), _pick(_draw(seed + 9, i), CHANNELS).alias("sales_channel"), status.alias("order_status"),
    ).join(totals, "order_id")
    settled = ~F.col("order_status").isin("created", "cancelled")
    paid = heads.select(
        "id", F.col("order_id").alias("payment_id"), "order_id", F.element_at(F.array(*map(F.lit, ("credit_card", "debit_card", "pse", "cash", "wallet"))), (i % 5 + 1).cast("int")).alias("payment_method"),
        F.when(settled, "approved").when(F.col("order_status") == "created", "pending").otherwise("rejected").alias("payment_status"),
        F.col("order_total").alias("amount"), F.when(settled, F.col("order_date")).alias("payment_date"),
    )
    asked = rows(tickets).select(
        "id", i.alias("ticket_id"), (F.pmod(F.xxhash64(F.lit(seed + 10), i), F.lit(customers)) + 1).alias("customer_id"),
        F.format_string("Subject %d", i).alias("subject"), F.format_string("Body of ticket %d", i).alias("ticket_body"),
        _pick(_draw(seed + 11, i), (("open", 20), ("in_progress", 20), ("resolved", 30), ("closed", 30))).alias("ticket_status"),
        _pick(_draw(seed + 12, i), (("low", 30), ("medium", 40), ("high", 20), ("urgent", 10))).alias("priority"),
    )
    made = {"customers": people, "products": goods, "orders": heads, "order_items": lines, "payments": paid, "support_tickets": asked}
    return {k: stamped(df, i * 5) for k, df in made.items()}


def second_batch(tables: dict[str, DataFrame], at: datetime) -> dict[str, DataFrame]:
    """Changes after the first load: a customer's segment, a pending payment approved, an inactive product removed."""
    when = F.lit(at).cast("timestamp")
    first = lambda df, key: df.orderBy(key).limit(1)
    return {
        "customers": first(tables["customers"].where("segment = 'Regular'"), "customer_id").withColumns({"segment": F.lit("Premium"), "updated_at": when}),
        "payments": first(tables["payments"].where("payment_status = 'pending'"), "payment_id").withColumns(
            {"payment_status": F.lit("approved"), "payment_date": F.coalesce("payment_date", when), "updated_at": when}
        ),
        "products": first(tables["products"].where("product_status = 'inactive'"), "product_id").withColumns(
            {"product_status": F.lit("discontinued"), "is_deleted": F.lit(True), "updated_at": when}
        ),
    }
