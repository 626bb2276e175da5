"""The engine's queries over the benchmark tables, each with SQL of the same result."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.config import RunContext
from lakeloom.functions.columns import convert, date_key, to_boolean
from lakeloom.operators import history, quality, silver
from lakeloom.plans import gold
from lakeloom.plans.adapter import VIEWS, customers, order_items, orders, payments, products, table
from lakeloom.sources.readers import between_watermarks, with_lineage
from lakeloom.specs import ColumnRule, EntitySpec, ForeignKey
from lakeloom.streaming import clickstream

RUN = RunContext("00000000-0000-0000-0000-000000000000", datetime(2026, 1, 1, tzinfo=timezone.utc))
SUM = "decimal(38,2)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str, views: bool = True) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {VIEWS}{sql}" if views else sql
        return f

    return add


FACT = """, fact AS (SELECT i.order_item_id AS sales_item_key, i.order_item_id, i.order_id, o.customer_id, i.product_id,
  CAST(strftime(o.order_date, '%Y%m%d') AS INTEGER) AS date_key, o.sales_channel, o.order_status, i.quantity, i.unit_price,
  i.line_total AS revenue, i.is_deleted FROM items i JOIN ords o ON i.order_id = o.order_id)"""


def _fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.fact_sales(order_items(spark, sf_dir), orders(spark, sf_dir))


@_query(FACT + """ SELECT CAST(sum(revenue) AS DECIMAL(38,2)) AS total_revenue, count(DISTINCT order_id) AS total_orders,
  CAST(sum(quantity) AS BIGINT) AS total_items_sold,
  round(CAST(sum(revenue) AS DOUBLE) / count(DISTINCT order_id), 2) AS average_order_value
FROM fact WHERE is_deleted = false AND order_status NOT IN ('cancelled', 'canceled')""")  # fmt: skip
def kpi_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.kpi_sales(_fact(spark, sf_dir)).select(
        F.col("total_revenue").cast(SUM).alias("total_revenue"), "total_orders", "total_items_sold",
        F.col("average_order_value").cast("double").alias("average_order_value"),
    )


@_query(FACT + """ SELECT date_key, category, sales_channel, count(DISTINCT order_id) AS total_orders,
  CAST(sum(quantity) AS BIGINT) AS total_items_sold, CAST(sum(revenue) AS DECIMAL(38,2)) AS total_revenue
FROM fact f JOIN products p ON f.product_id = p.product_id GROUP BY ALL""")
def agg_daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = gold.agg_daily_sales(_fact(spark, sf_dir), gold.dim_products(products(spark, sf_dir)))
    return made.withColumn("total_revenue", F.col("total_revenue").cast(SUM))


@_query(FACT + " SELECT * FROM fact")
def fact_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fact(spark, sf_dir)


@_query("SELECT customer_id AS customer_key, * FROM customers")
def dim_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.dim_customers(customers(spark, sf_dir))


@_query("SELECT product_id AS product_key, * FROM products")
def dim_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.dim_products(products(spark, sf_dir))


@_query("""SELECT d AS date_day, CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(year(d) AS INTEGER) AS year,
  CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name, CAST(day(d) AS INTEGER) AS day, dayname(d) AS day_of_week,
  CAST(quarter(d) AS INTEGER) AS quarter FROM (SELECT DISTINCT CAST(order_date AS DATE) AS d FROM ords)""")
def dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.dim_date(orders(spark, sf_dir))


@_query("""SELECT TRY_CAST(trim(k) AS BIGINT) AS customer_id, lower(trim(e)) AS email, trim(s) AS segment,
  TRY_CAST(TRY_CAST(b AS DOUBLE) AS DECIMAL(18,2)) AS balance
FROM (SELECT ' ' || CAST(c_custkey AS VARCHAR) || ' ' AS k, '  ' || upper(c_name) || '@EXAMPLE.COM ' AS e, ' ' || c_mktsegment AS s,
  CASE WHEN c_custkey % 13 = 0 THEN 'abc' ELSE CAST(c_acctbal AS VARCHAR) END AS b FROM customer)""", views=False)  # fmt: skip
def silver_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "customer").select(
        F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" ")).alias("customer_id"),
        F.concat(F.lit("  "), F.upper("c_name"), F.lit("@EXAMPLE.COM ")).alias("email"),
        F.concat(F.lit(" "), F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_custkey") % 13 == 0, "abc").otherwise(F.col("c_acctbal").cast("string")).alias("balance"),
    )
    kinds = {"customer_id": "long", "email": "lower", "segment": "text", "balance": "money"}
    return raw.select(*[convert(c, k).alias(c) for c, k in kinds.items()])


@_query("""SELECT c_custkey AS id, t AS raw_flag, CASE WHEN lower(t) IN ('true', '1') THEN true WHEN lower(t) IN ('false', '0') THEN false END AS flag
FROM (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'false' WHEN 2 THEN '1' WHEN 3 THEN '0' WHEN 4 THEN ' true'
  WHEN 5 THEN 'yes' END AS t FROM customer)""", views=False)  # fmt: skip
def silver_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 7
    text = F.when(k == 0, "TRUE").when(k == 1, "false").when(k == 2, "1").when(k == 3, "0").when(k == 4, " true").when(k == 5, "yes")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.alias("raw_flag")).withColumn("flag", to_boolean("raw_flag"))


@_query("""SELECT order_item_id, order_id, product_id, quantity, unit_price, line_total, updated_at, is_deleted FROM
  (SELECT *, row_number() OVER (PARTITION BY order_item_id ORDER BY updated_at DESC, order_id DESC, product_id DESC, quantity DESC,
     unit_price DESC, line_total DESC, is_deleted DESC) AS rn FROM items) WHERE rn = 1""")
def silver_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.latest(order_items(spark, sf_dir), ["order_item_id"])


_CHECK = "SELECT '{t}' AS table_name, '{n}' AS check_name, '{k}' AS check_type, CAST({bad} AS BIGINT) AS failed_rows, CAST({all} AS BIGINT) AS total_rows, CASE WHEN {bad} = 0 THEN 'passed' ELSE '{s}' END AS check_status FROM {f}"


def _null_sql(name: str, view: str, columns: tuple[str, ...]) -> list[str]:
    return [_CHECK.format(t=name, n=f"null_{c}", k="null_check", bad=f"count(*) FILTER (WHERE {c} IS NULL)", all="count(*)", s="warning", f=view) for c in columns]


def _unique_sql(name: str, view: str, key: str) -> str:
    grouped = f"(SELECT {key}, count(*) AS n FROM {view} GROUP BY {key})"
    return _CHECK.format(t=name, n="duplicate_primary_key", k="uniqueness_check", bad="(sum(n) - count(*))", all="sum(n)", s="failed", f=grouped)


def _fk_sql(name: str, view: str, key: ForeignKey, parent: str, parent_key: str) -> str:
    of = f"SELECT {parent_key} FROM {parent}" + " WHERE NOT coalesce(is_deleted, false)" * key.live_parent
    rows = f"(SELECT c.{key.column}, p.k FROM (SELECT * FROM {view} WHERE NOT coalesce(is_deleted, false)) c LEFT JOIN (SELECT DISTINCT {parent_key} AS k FROM ({of})) p ON c.{key.column} = p.k)"
    return _CHECK.format(t=name, n=key.check_name, k="referential_integrity", bad="count(*) FILTER (WHERE k IS NULL)", all="count(*)", s="failed", f=rows)


_NULLS = {
    "customers": ("customers", ("customer_id", "email", "updated_at")), "products": ("products", ("product_id", "sku", "unit_price")),
    "orders": ("ords", ("order_id", "customer_id", "order_date", "order_total", "updated_at")),
    "order_items": ("items", ("order_item_id", "order_id", "product_id", "quantity", "unit_price", "line_total")),
    "payments": ("pays", ("payment_id", "order_id", "amount", "payment_date", "updated_at")),
}
_KEYS = {"customers": "customer_id", "products": "product_id", "orders": "order_id", "order_items": "order_item_id", "payments": "payment_id"}
_FKS = [
    ("orders", ForeignKey("customer_id", "customers")), ("order_items", ForeignKey("order_id", "orders")),
    ("order_items", ForeignKey("product_id", "products", live_parent=False)), ("payments", ForeignKey("order_id", "orders")),
]
_FRAMES = {"customers": customers, "products": products, "orders": orders, "order_items": order_items, "payments": payments}
_NULL_SQL = [x for n, (v, cs) in _NULLS.items() for x in _null_sql(n, v, cs)]
_UNIQUE_SQL = [_unique_sql(n, _NULLS[n][0], k) for n, k in _KEYS.items()]
_FK_SQL = [_fk_sql(n, _NULLS[n][0], k, _NULLS[k.parent][0], _KEYS[k.parent]) for n, k in _FKS]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@_query(" UNION ALL ".join(_NULL_SQL))
def dq_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union([quality.null_checks(_FRAMES[n](spark, sf_dir), n, cs) for n, (_, cs) in _NULLS.items()])


@_query(" UNION ALL ".join(_UNIQUE_SQL))
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union([quality.unique_check(_FRAMES[n](spark, sf_dir), n, [k]) for n, k in _KEYS.items()])


@_query(" UNION ALL ".join(_FK_SQL))
def dq_referential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union([
        quality.referential_check(_FRAMES[n](spark, sf_dir), _FRAMES[k.parent](spark, sf_dir), n, k, _KEYS[k.parent]) for n, k in _FKS
    ])


@_query(" UNION ALL ".join(_NULL_SQL + _UNIQUE_SQL + _FK_SQL))
def dq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {n: quality.KeyRules(_KEYS[n], cs, tuple(k for c, k in _FKS if c == n)) for n, (_, cs) in _NULLS.items()}
    checks = quality.key_checks({n: f(spark, sf_dir) for n, f in _FRAMES.items()}, rules)
    return quality.with_run(checks, RUN).select(*quality.SHORT)


@_query("""SELECT * FROM (SELECT o.order_id, o.order_total, CAST(coalesce(s.t, 0) AS DECIMAL(38,2)) AS items_total FROM ords o LEFT JOIN
  (SELECT order_id, sum(line_total) AS t FROM items WHERE NOT is_deleted GROUP BY order_id) s ON o.order_id = s.order_id)
WHERE abs(order_total - items_total) > 0.01""")
def dq_order_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = quality.order_totals(orders(spark, sf_dir), order_items(spark, sf_dir))
    return bad.withColumn("items_total", F.col("items_total").cast(SUM))


@_query("SELECT order_id FROM ords WHERE order_id NOT IN (SELECT order_id FROM items WHERE NOT is_deleted)")
def dq_orders_without_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.orders_without_items(orders(spark, sf_dir), order_items(spark, sf_dir))


@_query("""SELECT p.payment_id, p.order_id, p.amount, o.order_total FROM pays p JOIN ords o ON p.order_id = o.order_id
WHERE abs(p.amount - o.order_total) > 0.01""")
def dq_payment_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.payment_mismatches(payments(spark, sf_dir), orders(spark, sf_dir))


_CONSISTENT = [
    ("orders", "order_total_matches_items", "count(*) FILTER (WHERE abs(order_total - coalesce(t, 0)) > 0.01)", "met"),
    ("orders", "order_has_items", "count(*) FILTER (WHERE has IS NULL)", "met"),
    ("payments", "payment_matches_order_total", "count(*) FILTER (WHERE abs(p.amount - o.order_total) > 0.01)", "pays p JOIN ords o ON p.order_id = o.order_id"),
    ("order_items", "line_total_matches_quantity", "count(*) FILTER (WHERE abs(line_total - quantity * unit_price) > 0.01)", "items"),
]


@_query(""", met AS (SELECT o.order_id, o.order_total, s.t, s.has FROM ords o LEFT JOIN
  (SELECT order_id, sum(line_total) AS t, true AS has FROM items WHERE NOT is_deleted GROUP BY order_id) s ON o.order_id = s.order_id) """
  + " UNION ALL ".join(_CHECK.format(t=t, n=n, k="consistency_check", bad=bad, all="count(*)", s="failed", f=f) for t, n, bad, f in _CONSISTENT))
def dq_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality.consistency_checks(orders(spark, sf_dir), order_items(spark, sf_dir), payments(spark, sf_dir))
    return quality.with_run(made, RUN).select(*quality.SHORT)


@_query("""SELECT 'accepted_product_status' AS check_name, count(*) FILTER (WHERE product_status NOT IN ('active', 'inactive')) AS failed_rows,
  count(*) AS total_rows FROM products""")
def dq_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = ~F.col("product_status").isin("active", "inactive")
    made = quality.condition_check(products(spark, sf_dir), "products", "accepted_product_status", bad, "accepted_values")
    return made.select("check_name", "failed_rows", "total_rows")


@_query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {v}" for n, (v, _) in _NULLS.items()))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union([_FRAMES[n](spark, sf_dir).agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n in _NULLS])


@_query("SELECT order_id, order_status, updated_at FROM ords ORDER BY updated_at DESC, order_id LIMIT 10")
def latest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select("order_id", "order_status", "updated_at").orderBy(F.desc("updated_at"), "order_id").limit(10)


@_query("SELECT payment_id, order_id, amount, payment_date, updated_at FROM pays ORDER BY updated_at DESC, payment_id LIMIT 10")
def latest_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payments(spark, sf_dir).select("payment_id", "order_id", "amount", "payment_date", "updated_at")
    return rows.orderBy(F.desc("updated_at"), "payment_id").limit(10)


@_query("""SELECT c.customer_id, c.first_name, c.last_name, c.segment, max(o.updated_at) AS updated_at FROM customers c JOIN ords o
  ON c.customer_id = o.customer_id GROUP BY ALL ORDER BY updated_at DESC, customer_id LIMIT 10""")
def latest_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's customers have no time of change; their last order's stands for it."""
    seen = orders(spark, sf_dir).groupBy("customer_id").agg(F.max("updated_at").alias("updated_at"))
    rows = customers(spark, sf_dir).drop("updated_at").join(seen, "customer_id")
    return rows.select("customer_id", "first_name", "last_name", "segment", "updated_at").orderBy(F.desc("updated_at"), "customer_id").limit(10)


@_query("SELECT product_id, sku, product_status, is_deleted FROM products WHERE is_deleted OR product_status = 'discontinued'")
def removed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).where(F.col("is_deleted") | (F.col("product_status") == "discontinued")).select("product_id", "sku", "product_status", "is_deleted")


@_query("SELECT count(*) AS row_count, CAST(1 AS BIGINT) AS ingestion_runs, CAST(1 AS BIGINT) AS source_systems FROM orders", views=False)
def bronze_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = with_lineage(table(spark, sf_dir, "orders").select("o_orderkey"), "azure_sql", "dbo.Orders", "orders.csv", RUN.run_id, RUN.at)
    return history.bronze_validation(raw)


@_query("""SELECT 'dbo.Orders' AS source_table, strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') AS watermark, count(*) AS rows_read,
  'success' AS run_status FROM ords""")
def watermark_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.date_format("last_successful_watermark", "yyyy-MM-dd HH:mm:ss").alias("watermark")
    return history.watermark_rows(orders(spark, sf_dir), "dbo.Orders", RUN).select("source_table", mark, "rows_read", "run_status")


@_query("""SELECT o_orderkey AS order_id, o_orderdate AS updated_at FROM orders
WHERE o_orderdate > TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-01-01'""", views=False)
def incremental_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("1995-01-01 00:00:00", "1996-01-01 00:00:00"))
    raw = table(spark, sf_dir, "orders")
    return raw.where(between_watermarks(F.col("o_orderdate"), low, high)).select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("updated_at"))


@_query(""", changes AS (SELECT order_id, customer_id, order_date, sales_channel, 'delivered' AS order_status, order_total,
  updated_at + INTERVAL 1 DAY AS updated_at, is_deleted FROM ords WHERE order_id % 10 = 0
  UNION ALL SELECT order_id + 100000000, customer_id, order_date, sales_channel, order_status, order_total, updated_at, is_deleted FROM ords WHERE order_id % 1000 = 0)
SELECT order_id, customer_id, order_date, sales_channel, order_status, order_total, updated_at, is_deleted FROM
  (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY updated_at DESC) AS rn FROM
    (SELECT order_id, customer_id, order_date, sales_channel, order_status, order_total, updated_at, is_deleted FROM ords UNION ALL SELECT * FROM changes)) WHERE rn = 1""")  # fmt: skip
def upsert_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = orders(spark, sf_dir)
    later = now.where("order_id % 10 = 0").withColumns({"order_status": F.lit("delivered"), "updated_at": F.expr("updated_at + INTERVAL 1 DAY")})
    new = now.where("order_id % 1000 = 0").withColumn("order_id", F.col("order_id") + 100000000)
    return history.upsert(now, later.unionByName(new), ["order_id"])


_HISTORY = """, changes AS (SELECT customer_id, updated_at, max(order_status) AS order_status FROM ords GROUP BY ALL),
marked AS (SELECT *, lag(order_status) OVER w AS before, row_number() OVER w AS rn FROM changes WINDOW w AS (PARTITION BY customer_id ORDER BY updated_at)),
versions AS (SELECT customer_id, order_status, updated_at AS effective_from, lead(updated_at) OVER (PARTITION BY customer_id ORDER BY updated_at) AS effective_to
  FROM marked WHERE rn = 1 OR order_status IS DISTINCT FROM before)"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.scd2(orders(spark, sf_dir).select("customer_id", "order_status", "updated_at"), ["customer_id"], ["order_status"])


@_query(_HISTORY + " SELECT *, effective_to IS NULL AS is_current FROM versions")
def scd2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).drop("surrogate_key")


@_query(_HISTORY + """ SELECT o.order_id, o.customer_id, o.order_date, v.order_status AS last_status FROM ords o LEFT JOIN versions v
  ON o.customer_id = v.customer_id AND o.order_date >= v.effective_from AND (v.effective_to IS NULL OR o.order_date < v.effective_to)""")
def asof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = orders(spark, sf_dir).select("order_id", "customer_id", "order_date")
    past = _versions(spark, sf_dir).withColumnRenamed("order_status", "last_status")
    return history.as_of(facts, past, "customer_id", "order_date", ["last_status"])


@_query(""", changes AS (SELECT customer_id, updated_at, bool_or(is_deleted) AS gone, max(CASE WHEN is_deleted THEN NULL ELSE order_status END) AS st,
  FROM ords GROUP BY ALL), clean AS (SELECT customer_id, updated_at, gone, CASE WHEN gone THEN NULL ELSE st END AS order_status FROM changes),
marked AS (SELECT *, lag(order_status) OVER w AS before, lag(gone) OVER w AS was, row_number() OVER w AS rn FROM clean WINDOW w AS (PARTITION BY customer_id ORDER BY updated_at)),
steps AS (SELECT * FROM marked WHERE rn = 1 OR order_status IS DISTINCT FROM before OR gone IS DISTINCT FROM was),
versions AS (SELECT customer_id, order_status, gone, updated_at AS effective_from, lead(updated_at) OVER (PARTITION BY customer_id ORDER BY updated_at) AS effective_to FROM steps)
SELECT customer_id, order_status, effective_from, effective_to, effective_to IS NULL AS is_current FROM versions WHERE NOT gone""")
def scd2_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As scd2_history, but a deleted order closes its customer's version."""
    rows = orders(spark, sf_dir).select("customer_id", "order_status", "updated_at", "is_deleted")
    return history.scd2(rows, ["customer_id"], ["order_status"], deleted="is_deleted").drop("surrogate_key")


@_query(""", raw AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 13 = 0 THEN 'abc' ELSE CAST(c_acctbal AS VARCHAR) END AS b,
  CASE WHEN c_custkey % 7 = 0 THEN 'yes' ELSE 'true' END AS f FROM customer)
SELECT 'customers' AS table_name, 'coercion_balance' AS check_name, count(*) FILTER (WHERE k % 13 = 0) AS failed_rows, count(*) AS total_rows FROM raw
UNION ALL SELECT 'customers', 'coercion_flag', count(*) FILTER (WHERE f = 'yes'), count(*) FROM raw""")
def dq_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = table(spark, sf_dir, "customer").select(
        F.when(k % 13 == 0, "abc").otherwise(F.col("c_acctbal").cast("string")).alias("balance"), F.when(k % 7 == 0, "yes").otherwise("true").alias("flag"), F.col("c_name").alias("name")
    )
    spec = EntitySpec("customers", "", "", (ColumnRule("balance", "money"), ColumnRule("flag", "boolean"), ColumnRule("name", "text")), ())
    return quality.coercion_checks(raw, spec).select("table_name", "check_name", "failed_rows", "total_rows")


@_query("""SELECT 'customers' AS table_name, 'duplicate_source_key' AS check_name, count(*) - count(DISTINCT customer_id) AS failed_rows, count(*) AS total_rows FROM ords""")
def dq_source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of their customers: how many keys have several before the latest is chosen."""
    spec = EntitySpec("customers", "", "customer_id", (), ())
    return quality.source_key_check(orders(spark, sf_dir), spec).select("table_name", "check_name", "failed_rows", "total_rows")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id"), F.col("ts").cast("timestamp").alias("event_time"), F.col("user_id").alias("customer_id"), "event_type"
    )


@_query("""SELECT event_id, min(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS event_time, min(user_id) AS customer_id, min(event_type) AS event_type
FROM events GROUP BY event_id""", views=False)
def events_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = _events(spark, sf_dir).unionByName(_events(spark, sf_dir).where("event_id % 5 = 0"))
    made = clickstream.deduplicated(twice)
    return made.select("event_id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"), "customer_id", "event_type")


@_query("""WITH e AS (SELECT user_id AS customer_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY customer_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT customer_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS session_end,
  count(*) AS events FROM s GROUP BY customer_id, k""", views=False)  # fmt: skip
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return clickstream.sessions(_events(spark, sf_dir)).select("customer_id", text("session_start"), text("session_end"), "events")


def _work_dir(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; a local session may use its own."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or 'file://' + tempfile.mkdtemp()).rstrip('/')}/{name}-{uuid4().hex}"


@_query("SELECT event_id, user_id AS customer_id, event_type FROM events", views=False)
def events_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, each twice, de-duplicated under a watermark and written by one run of all that is there."""
    raw = table(spark, sf_dir, "events")
    work = _work_dir(spark, "events")
    raw.unionByName(raw).write.parquet(f"{work}/in")
    stream = spark.readStream.schema(raw.schema).parquet(f"{work}/in")
    events = stream.select("event_id", F.col("ts").cast("timestamp").alias("event_time"), F.col("user_id").alias("customer_id"), "event_type")
    once = clickstream.deduplicated(events, "3650 days").select("event_id", "customer_id", "event_type")
    clickstream.write(once, f"{work}/out", f"{work}/state", once=True).awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{work}/out")


@_query("""SELECT event_type, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS date_key, count(*) AS events FROM events GROUP BY ALL""", views=False)
def events_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type", date_key(F.col("event_time")).alias("date_key")).agg(F.count("*").alias("events"))
