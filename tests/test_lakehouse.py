"""The flow from raw text to the star schema, and each part's edge cases."""

from datetime import datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakeloom.config import LakeConfig, RunContext, create_schemas
from lakeloom.functions.columns import convert, csv_text, to_boolean
from lakeloom.operators import history, quality, silver
from lakeloom.plans import gold, pipeline
from lakeloom.sources import readers, sinks
from lakeloom.specs import ENTITIES, ForeignKey
from tests import fixtures

RUN = RunContext("run-1", datetime(2025, 4, 1, tzinfo=timezone.utc))


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    config = LakeConfig(landing=fixtures.write(tmp_path_factory.mktemp("landing")))
    return config, pipeline.run_pipeline(spark, config, RUN).first()


def one(spark, config, layer, name, where):
    return spark.table(config.table(layer, name)).where(where).first()


def test_csv_keeps_quotes_breaks_and_accents(spark, lake):
    assert one(spark, lake[0], "bronze", "support_tickets", "ticket_id = '900'").ticket_body == 'first line\nsecond, "quoted" line'
    assert one(spark, lake[0], "bronze", "customers", "customer_id = '2'").city == "Lima\nNorte"
    assert spark.table(lake[0].table("bronze", "customers")).count() == 3


def test_bronze_has_one_run_and_system(spark, lake):
    got = history.bronze_validation(spark.table(lake[0].table("bronze", "orders"))).first()
    assert tuple(got) == (3, 1, 1)


def test_silver_types_and_latest_row(spark, lake):
    ana = one(spark, lake[0], "silver", "customers", "customer_id = 1")
    assert (ana.segment, ana.email, ana.is_deleted) == ("Premium", "ana@example.com", False)
    assert ana.updated_at.microsecond == 123000
    assert one(spark, lake[0], "silver", "customers", "customer_id = 2").signup_date is None
    assert one(spark, lake[0], "silver", "products", "product_id = 10").unit_price == Decimal("2.01")
    widths = {n: len(spark.table(lake[0].table("silver", n)).columns) for n in ENTITIES}
    assert widths == {"customers": 19, "products": 17, "orders": 16, "order_items": 16, "payments": 16, "support_tickets": 16}


def test_quality_run(spark, lake):
    found = spark.table(lake[0].table("control", "data_quality_results")).collect()
    rows = {(r.table_name, r.check_name): r for r in found}
    assert len(rows) == len(found)
    kinds = [r.check_type for r in found if r.check_name != "duplicate_source_key"]
    assert sum(k in ("null_check", "uniqueness_check", "referential_integrity") for k in kinds) == 42
    assert kinds.count("consistency_check") == 4 and kinds.count("accepted_values") == 9 and kinds.count("range_check") == 5
    assert rows["payments", "null_payment_date"].check_status == "warning"
    assert rows["orders", "customer_id_references_customers"].failed_rows == 1  # customer 2 is deleted, order 102 as well
    assert rows["order_items", "order_id_references_orders"].failed_rows == 1  # the item of a deleted order
    assert rows["order_items", "product_id_references_products"].failed_rows == 0  # deleted products still count
    assert rows["orders", "duplicate_primary_key"].check_status == "passed"
    assert (rows["customers", "duplicate_source_key"].failed_rows, rows["customers", "duplicate_source_key"].check_status) == (1, "warning")
    assert (rows["customers", "coercion_signup_date"].failed_rows, rows["customers", "coercion_signup_date"].total_rows) == (1, 3)
    assert rows["orders", "coercion_order_total"].check_status == "passed"
    assert rows["orders", "order_total_matches_items"].failed_rows == 1  # 102; 9.01 against 9.00 passes
    assert rows["orders", "order_has_items"].failed_rows == 0 and rows["payments", "payment_matches_order_total"].failed_rows == 1
    assert rows["customers", "accepted_country"].failed_rows == 0 and rows["order_items", "range_quantity"].total_rows == 4


def test_kpis_and_gold(spark, lake):
    # Items without a flag and cancelled orders are left out.
    assert tuple(lake[1]) == (Decimal("7.50"), 2, 3, Decimal("3.75"))
    assert spark.table(lake[0].table("gold", "fact_sales")).count() == 4
    assert spark.table(lake[0].table("gold", "dim_date")).count() == 2
    assert len(spark.table(lake[0].table("gold", "dim_customers")).columns) == 11
    assert len(spark.table(lake[0].table("gold", "dim_products")).columns) == 8


def test_watermarks(spark, lake):
    table = lake[0].table("control", "ingestion_watermarks")
    assert history.last_watermark(spark, table, "dbo.Orders") == datetime(2025, 2, 2, 12, 0)
    assert spark.table(table).schema.names == history.WATERMARKS.names
    assert history.last_watermark(spark, table, "dbo.None") is None


def test_second_batch_is_merged_and_idempotent(spark, lake):
    config = LakeConfig(silver_schema="silver_two", control_schema="control_two")
    create_schemas(spark, config)
    spec = ENTITIES["payments"]
    sinks.overwrite(spark.table(lake[0].table("silver", "payments")), config.table("silver", "payments"))
    change = [("501", "101", "cash", "approved", "3.60", "2025-02-05 10:00:00", "2025-02-02 12:00:00", "2025-02-05 10:00:00", "false"),
              ("502", "100", "cash", "approved", "0.01", "2025-02-05 10:00:00", "2025-02-05 10:00:00", "2025-02-05 10:00:00", "false")]
    raw = spark.createDataFrame(change, spec.raw_schema)
    raw = readers.with_lineage(raw, "azure_sql", spec.source_table, "x.csv", "run-2", RUN.at)
    for _ in range(2):
        pipeline.merge_batch(spark, config, "payments", raw, RUN)
        got = {r.payment_id: r.payment_status for r in spark.table(config.table("silver", "payments")).collect()}
        assert got == {500: "approved", 501: "approved", 502: "approved"}


def raw_rows(spark, name, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], ENTITIES[name].raw_schema)


def test_increments_by_watermark(spark, tmp_path_factory):
    """Two batches after the first load: windows, late rows, a new column, a lost one, reruns."""
    config = LakeConfig("b_inc", "s_inc", "g_inc", "c_inc", landing=fixtures.write(tmp_path_factory.mktemp("inc")))
    pipeline.run_pipeline(spark, config, RUN)
    control = config.table("control", "ingestion_watermarks")
    before = history.last_watermark(spark, control, "dbo.Payments")
    assert before == datetime(2025, 2, 2, 12, 5)
    payments = raw_rows(
        spark, "payments",
        ("501", "101", "cash", "approved", "3.50", "2025-02-05 10:00:00", "2025-02-02 12:00:00", "2025-02-05 10:00:00", "false"),
        ("500", "100", "pse", "rejected", "9.00", None, "2025-02-01 12:00:00", "2025-02-02 12:05:00", "false"),  # not after the watermark
        ("503", "100", "cash", "approved", "1.00", None, "2026-02-01 12:00:00", "2026-02-02 12:05:00", "false"),  # after the run's time
    )
    customers = raw_rows(spark, "customers", ("2", "Luis", "P", "l@e.com", None, "Lima", "PE", "Regular", "2025-01-02", "2025-01-02 10:00:00", "2025-03-05 10:00:00", "false"))
    typed = customers.withColumns({"customer_id": F.col("customer_id").cast("int"), "updated_at": F.col("updated_at").cast("timestamp"), "is_deleted": F.lit(False)})
    second = RunContext("run-2", datetime(2025, 6, 1, tzinfo=timezone.utc))
    kpis = pipeline.run_increment(spark, config, {"payments": payments, "customers": typed.withColumn("loyalty", F.lit(7))}, second).first()
    assert kpis.total_orders == 2
    got = {r.payment_id: r.payment_status for r in spark.table(config.table("silver", "payments")).collect()}
    assert got == {500: "approved", 501: "approved"}
    assert one(spark, config, "silver", "customers", "customer_id = 2").segment == "Regular"
    assert [r.loyalty for r in spark.table(config.table("bronze", "customers")).where("customer_id = '2'").orderBy("_ingested_at").collect()] == [None, "7"]
    assert "loyalty" not in spark.table(config.table("silver", "customers")).columns
    assert history.last_watermark(spark, control, "dbo.Payments") == datetime(2025, 2, 5, 10)
    row = spark.table(control).where("last_run_id = 'run-2' AND source_table = 'dbo.Payments'").collect()
    assert [r.rows_read for r in row] == [1]
    audit = spark.table(config.table("control", "schema_audit")).collect()
    assert [(r.source_table, r.change, r.column_name, r.action) for r in audit] == [("dbo.Customers", "added", "loyalty", "accepted")]
    past = {(r.customer_id, r.segment, r.is_current) for r in spark.table(config.table("gold", "dim_customers_history")).collect()}
    assert past == {(1, "Regular", False), (1, "Premium", True), (2, "Regular", True)}  # 2 was deleted and came back
    # The same again reads nothing and changes nothing; the watermark stays.
    third = RunContext("run-3", datetime(2025, 6, 2, tzinfo=timezone.utc))
    pipeline.run_increment(spark, config, {"payments": payments}, third)
    assert {r.payment_id: r.payment_status for r in spark.table(config.table("silver", "payments")).collect()} == got
    assert history.last_watermark(spark, control, "dbo.Payments") == datetime(2025, 2, 5, 10)
    assert spark.table(control).where("last_run_id = 'run-3'").first().rows_read == 0
    # A lost or retyped column is audited and stops the load before anything is written.
    rows = spark.table(config.table("bronze", "payments")).count()
    late = RunContext("run-4", datetime(2026, 6, 1, tzinfo=timezone.utc))
    for bad in (payments.drop("amount"), payments.withColumn("payment_id", F.lit(1.5))):
        with pytest.raises(pipeline.SchemaReview):
            pipeline.run_increment(spark, config, {"payments": bad}, late)
    assert spark.table(config.table("bronze", "payments")).count() == rows
    assert spark.table(control).where("last_run_id = 'run-4'").count() == 0
    changes = {(r.change, r.column_name, r.action) for r in spark.table(config.table("control", "schema_audit")).where("run_id = 'run-4'").collect()}
    assert changes == {("removed", "amount", "review"), ("retyped", "payment_id", "review")}


def test_all_entities_are_exported_with_counts(spark, lake, tmp_path):
    assert pipeline.export_all(spark, lake[0], str(tmp_path / "all")) == {
        "customers": 2, "products": 2, "orders": 3, "order_items": 4, "payments": 2, "support_tickets": 1,
    }
    spec = ENTITIES["customers"]
    back = silver.typed(readers.read_csv(spark, str(tmp_path / "all" / "customers"), spec.raw_schema), spec).where("customer_id = 1").first()
    assert back.updated_at.microsecond == 123000  # fractions of seconds survive the round trip


def test_key_checks_are_the_single_rules(spark):
    parents = spark.createDataFrame([(1, "a", False), (1, None, False), (2, "b", True), (None, None, None), (None, "x", False)], "id long, v string, is_deleted boolean")
    children = spark.createDataFrame([(10, 1, None), (11, 99, False), (12, None, False), (13, 2, False), (14, 99, True), (14, 1, False)], "c long, fk int, is_deleted boolean")
    other = ForeignKey("fk", "p", live_parent=False)
    rules = {"p": quality.KeyRules("id", ("id", "v")), "t": quality.KeyRules("c", ("c", "fk"), (ForeignKey("fk", "p"),)), "u": quality.KeyRules("c", ("fk",), (other,))}
    for some in (1.0, 0.0):
        tables = {"p": parents.limit(int(5 * some)), "t": children, "u": children.limit(int(6 * some))}
        want = [quality.null_checks(tables[n], n, r.required) for n, r in rules.items()] + [quality.unique_check(tables[n], n, [r.key]) for n, r in rules.items()]
        want += [quality.referential_check(tables[n], tables["p"], n, k, "id") for n, r in rules.items() for k in r.references]
        assert sorted(map(tuple, quality.key_checks(tables, rules).collect())) == sorted(tuple(r) for w in want for r in w.collect())
    plan = quality.key_checks(tables, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and plan.count("Expand") + plan.count("Generate") <= 4


def test_deletions_close_versions(spark):
    rows = [(1, "a", 1, False), (1, "a", 3, True), (1, "b", 4, True), (1, "a", 6, None), (2, "x", 1, True), (3, "y", 1, False), (3, "z", 1, True)]
    past = history.scd2(spark.createDataFrame(rows, "k int, s string, updated_at int, is_deleted boolean"), ["k"], ["s"], deleted="is_deleted")
    assert sorted(map(tuple, past.drop("surrogate_key").collect()), key=str) == [(1, "a", 1, 3, False), (1, "a", 6, None, True)]


def test_time_ranges_change_no_version(spark):
    import random

    rnd = random.Random(8)
    rows = [(rnd.choice([1, 1, 1, 1, 2, 3, None]), rnd.choice("abc"), rnd.randrange(200), rnd.random() < 0.1) for _ in range(900)]
    changes = spark.createDataFrame(rows, "k int, s string, updated_at int, is_deleted boolean")
    facts = spark.createDataFrame([(i, rnd.choice([1, 1, 1, 2, 3, 4, None]), rnd.choice([None, rnd.randrange(-5, 210)])) for i in range(800)], "f int, k int, at int")
    for deleted in (None, "is_deleted"):
        whole = history.scd2(changes, ["k"], ["s"], deleted=deleted)
        found = history.as_of(facts, whole, "k", "at", ["s"])
        for spread in (2, 7, 40):
            parts = history.scd2(changes, ["k"], ["s"], deleted=deleted, spread=spread)
            assert sorted(map(tuple, parts.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
            split = history.as_of(facts, whole, "k", "at", ["s"], spread=spread)
            assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, found.collect()), key=str)
    assert history.spread_for(changes, ["k"], 100) == 6 and history.spread_for(changes.limit(0), ["k"]) == 1


def test_large_extracts_are_refused_where_one_task_would_read_them(spark, lake):
    path = f"{lake[0].landing}/orders.csv"
    with pytest.raises(ValueError, match="line_breaks=False"):
        readers.read_csv(spark, path, ENTITIES["orders"].raw_schema, largest=10)
    assert readers.read_csv(spark, path, ENTITIES["orders"].raw_schema, line_breaks=False, largest=10).count() == 3


def test_increments_over_jdbc(spark, tmp_path_factory):
    """The database that comes with Spark stands for the source: windows are pushed down, typed columns go through."""
    options = {"url": "jdbc:derby:memory:store;create=true", "user": "app", "password": "x", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    config = LakeConfig("b_jdbc", "s_jdbc", "g_jdbc", "c_jdbc", landing=fixtures.write(tmp_path_factory.mktemp("jdbc")))
    pipeline.run_pipeline(spark, config, RUN)
    spec = ENTITIES["payments"]
    text = raw_rows(
        spark, "payments", ("501", "101", "cash", "approved", "3.60", "2025-02-05 10:00:00", "2025-02-02 12:00:00", "2025-02-05 10:00:00", "false"),
        ("500", "100", "pse", "rejected", "9.00", "2025-02-01 12:05:00", "2025-02-01 12:00:00", "2025-02-01 12:05:00", "false"),
    )
    connection = spark._jvm.java.sql.DriverManager.getConnection(options["url"], "app", "x")
    connection.createStatement().execute("CREATE SCHEMA \"dbo\"")
    connection.close()
    silver.typed(text, spec).write.format("jdbc").options(**options, dbtable='"dbo"."Payments"').mode("append").save()
    source = readers.read_jdbc(spark, '"dbo"."Payments"', options, "payment_id", (0, 1000), 4)
    assert source.rdd.getNumPartitions() == 4
    bounded = source.where(readers.between_watermarks(F.col("updated_at"), datetime(2025, 2, 2), datetime(2025, 3, 1)))
    assert "GreaterThan(updated_at" in bounded._jdf.queryExecution().executedPlan().toString() and bounded.count() == 1
    pipeline.run_increment(spark, config, {"payments": source}, RunContext("jdbc-2", datetime(2025, 6, 1, tzinfo=timezone.utc)))
    got = {r.payment_id: (r.payment_status, r.amount) for r in spark.table(config.table("silver", "payments")).collect()}
    assert got == {500: ("approved", Decimal("9.00")), 501: ("approved", Decimal("3.60"))}
    assert set(pipeline.jdbc_sources(spark, options | {"url": "jdbc:derby:memory:store"}, ())) == set()


def test_jdbc_reads_may_take_long_but_connect_soon():
    made = readers.jdbc_read_options("t", {"url": "u"}, "id", (1, 9))
    assert made["loginTimeout"] == "60" and "queryTimeout" not in made and made["numPartitions"] == "8"


@pytest.mark.parametrize(("text", "expected"), [("TRUE", True), ("1", True), ("0", False), ("False", False), (" true", None), ("yes", None), (None, None)])
def test_boolean(spark, text, expected):
    assert spark.createDataFrame([(text,)], "x string").select(to_boolean("x")).first()[0] is expected


@pytest.mark.parametrize(
    ("kind", "text", "expected"),
    [("long", " 12 ", 12), ("long", "abc", None), ("money", "2.005", Decimal("2.01")), ("money", "99999999999999999999", None),
     ("text", "\t a \t", "\t a \t"), ("text", "  a ", "a"), ("lower", " AbC ", "abc"), ("date", "2025-13-01", None),
     ("timestamp", "2026-01-01 10:00:00.123", datetime(2026, 1, 1, 10, 0, 0, 123000)), ("timestamp", "x", None)],
)
def test_conversions(spark, kind, text, expected):
    assert spark.createDataFrame([(text,)], "x string").select(convert("x", kind)).first()[0] == expected


def test_coercion_losses(spark):
    raw = spark.createDataFrame([("1", "a", "x", "bad", "1", "S", "2025-01-01 00:00:00", "no", "false")], ENTITIES["order_items"].raw_schema)
    got = silver.coercion_losses(raw, ENTITIES["order_items"]).first().asDict()
    assert got.pop("__n") == 1
    assert {k for k, v in got.items() if v} == {"order_id", "product_id", "quantity", "line_total", "updated_at"}


def test_null_and_unique_rules(spark):
    df = spark.createDataFrame([(1, 100.0), (2, None), (3, 250.0)], "order_id int, order_total double")
    assert tuple(quality.null_checks(df, "orders", ["order_total"]).first())[2:] == ("null_check", 1, 3, "warning")
    for keys, failed in (([1, 2, 1, 3, 2], 2), ([1, 2, 3], 0), ([None, None, 1, 1], 2), ([], 0)):
        df = spark.createDataFrame([(k,) for k in keys], "k int")
        assert quality.unique_check(df, "t", ["k"]).first().failed_rows == failed


def test_referential_rule(spark):
    parents = spark.createDataFrame([(1, False), (2, True), (None, None)], "id int, is_deleted boolean")
    children = spark.createDataFrame([(10, 1, None), (11, 99, False), (12, None, False), (13, 2, False), (14, 99, True)], "c int, fk int, is_deleted boolean")
    live = quality.referential_check(children, parents, "t", ForeignKey("fk", "p"), "id").first()
    assert (live.failed_rows, live.total_rows, live.check_status) == (3, 4, "failed")
    every = quality.referential_check(children, parents, "t", ForeignKey("fk", "p", live_parent=False), "id").first()
    assert every.failed_rows == 2


def test_totals_within_a_cent_pass(spark):
    orders = spark.createDataFrame([(1, Decimal("1.01")), (2, Decimal("0.00")), (3, Decimal("0.02"))], "order_id long, order_total decimal(18,2)")
    items = spark.createDataFrame([(1, Decimal("1.00"), None)], "order_id long, line_total decimal(18,2), is_deleted boolean")
    assert [r.order_id for r in quality.order_totals(orders, items).collect()] == [3]
    assert sorted(r.order_id for r in quality.orders_without_items(orders, items).collect()) == [2, 3]


def test_domains(spark, lake):
    bad = [d.first() for d in quality.domain_checks(spark.table(lake[0].table("silver", "products")), ENTITIES["products"])]
    assert [(r.check_name, r.failed_rows) for r in bad] == [("accepted_product_status", 0), ("range_unit_price", 0)]


def test_empty_kpi(spark, lake):
    empty = spark.table(lake[0].table("gold", "fact_sales")).limit(0)
    assert tuple(gold.kpi_sales(empty).first()) == (None, 0, None, None)


def test_latest_ties_are_stable(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, None, "c"), (None, 1, "d")], "k int, updated_at int, v string")
    for parts in (1, 4):
        got = silver.latest(df.repartition(parts), ["k"]).collect()
        assert sorted((r.k or 0, r.v) for r in got) == [(0, "d"), (1, "b"), (2, "c")]


def test_scd2_and_as_of(spark):
    rows = [(1, "Regular", 1), (1, "Regular", 2), (1, "Premium", 3), (2, None, 1), (2, "X", 4)]
    past = history.scd2(spark.createDataFrame(rows, "k int, segment string, updated_at int"), ["k"], ["segment"])
    got = sorted((r.k, r.segment, r.effective_from, r.effective_to, r.is_current) for r in past.collect() if r.segment)
    assert got == [(1, "Premium", 3, None, True), (1, "Regular", 1, 3, False), (2, "X", 4, None, True)]
    facts = spark.createDataFrame([(1, 0), (1, 2), (1, 3), (3, 1)], "k int, at int")
    found = history.as_of(facts, past, "k", "at", ["segment"]).collect()
    assert sorted((r.k, r.at, r.segment) for r in found) == [(1, 0, None), (1, 2, "Regular"), (1, 3, "Premium"), (3, 1, None)]


def test_window_is_half_open(spark):
    df = spark.range(5)
    assert [r.id for r in df.where(readers.between_watermarks(F.col("id"), 1, 3)).collect()] == [2, 3]
    assert [r.id for r in df.where(readers.between_watermarks(F.col("id"), None, 1)).collect()] == [0, 1]


def test_extracts_without_line_breaks_are_split(spark, tmp_path):
    lines = ["id,t", *[f'{i},"say ""{i}"", ok"' for i in range(2000)]]
    (tmp_path / "x.csv").write_bytes(b"\xef\xbb\xbf" + "\n".join(lines).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        whole, split = (readers.read_csv(spark, str(tmp_path / "x.csv"), "id string, t string", b) for b in (True, False))
        assert whole.rdd.getNumPartitions() == 1 < split.rdd.getNumPartitions()
        for df in (whole, split):
            assert sorted((int(r.id), r.t) for r in df.collect()) == [(i, f'say "{i}", ok') for i in range(2000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_schema_drift(spark):
    old, new = spark.range(1).withColumn("x", F.lit(1)).schema, spark.range(1).withColumns({"id": F.lit("a"), "y": F.lit(1)}).schema
    diff = history.schema_diff(old, new)
    assert diff == {"added": ["y"], "removed": ["x"], "retyped": ["id"]}
    assert not history.compatible(diff)
    assert history.compatible({"added": ["y"], "removed": [], "retyped": []})


def test_export_round_trip(spark, lake, tmp_path):
    spec = ENTITIES["payments"]
    sinks.export_csv(spark.table(lake[0].table("silver", "payments")), str(tmp_path / "out"), spec)
    back = silver.typed(readers.read_csv(spark, str(tmp_path / "out"), spec.raw_schema), spec)
    want = spark.table(lake[0].table("silver", "payments")).select(*[c.name for c in spec.columns])
    assert sorted(map(str, back.collect())) == sorted(map(str, want.collect()))


def test_csv_text(spark):
    at = spark.sql("SELECT timestamp'2025-01-02 03:04:05' AS a, timestamp'2025-01-02 03:04:05.12' AS b")
    assert tuple(at.select(csv_text(F.col("a"), "timestamp"), csv_text(F.col("b"), "timestamp")).first()) == ("2025-01-02 03:04:05", "2025-01-02 03:04:05.120000")
    df = spark.createDataFrame([(Decimal("1.50"), True, None)], "a decimal(18,2), b boolean, c string")
    assert tuple(df.select(csv_text(F.col("a"), "money"), csv_text(F.col("b"), "boolean"), csv_text(F.col("c"), "text")).first()) == ("1.50", "true", "")


def test_jdbc_settings_name_what_is_missing(spark):
    with pytest.raises(ValueError, match="SOURCE_DB_USER, SOURCE_DB_DRIVER"):
        readers.jdbc_options({"SOURCE_DB_URL": "a", "SOURCE_DB_PASSWORD": "b"})
    assert readers.session_info(spark).columns == ["catalog", "schema", "at", "version"]


def test_plans_push_down_and_broadcast_nothing_unbounded(spark):
    raw = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("1995-01-01 00:00:00", "1996-01-01 00:00:00"))
    plan = raw.where(readers.between_watermarks(F.col("o_orderdate"), low, high)).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderdate" in plan
    assert "o_totalprice" not in plan
