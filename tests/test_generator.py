"""The synthetic store is the same each time, consistent, and feeds the whole flow."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from lakeloom.config import LakeConfig, RunContext
from lakeloom.operators import history, quality
from lakeloom.plans import pipeline
from lakeloom.sources import generator, sinks
from lakeloom.specs import ENTITIES

END = datetime(2026, 1, 1, tzinfo=timezone.utc)


def test_store_is_consistent_and_repeatable(spark):
    one, two = generator.store(spark, END), generator.store(spark, END)
    assert {k: v.count() for k, v in one.items() if k != "order_items"} == {"customers": 60, "products": 24, "orders": 120, "payments": 120, "support_tickets": 40}
    assert 120 <= one["order_items"].count() <= 360
    for name, spec in ENTITIES.items():
        assert one[name].columns[:1] and set(one[name].columns) == {c.name for c in spec.columns}
        assert sorted(map(str, one[name].collect())) == sorted(map(str, two[name].collect()))
        assert all(d.first().failed_rows == 0 for d in quality.domain_checks(one[name], spec))
    assert quality.order_totals(one["orders"], one["order_items"]).count() == 0
    assert quality.payment_mismatches(one["payments"], one["orders"]).count() == 0
    share = one["customers"].where("segment = 'Regular'").count() / 60
    assert 0.5 < share < 0.9


def test_store_goes_through_the_flow(spark, tmp_path):
    tables = generator.store(spark, END)
    for name, spec in ENTITIES.items():
        sinks.export_csv(tables[name], str(tmp_path / f"{name}.csv"), spec)
    config = LakeConfig(landing=str(tmp_path), bronze_schema="b3", silver_schema="s3", gold_schema="g3", control_schema="c3")
    kpi = pipeline.run_pipeline(spark, config, RunContext("r", END)).first()
    sold = tables["orders"].where("order_status <> 'cancelled'").agg(F.sum("order_total"), F.count("*")).first()
    assert (kpi.total_revenue, kpi.total_orders) == tuple(sold)
    results = spark.table("c3.data_quality_results").where("check_status <> 'passed'").collect()
    assert [r.check_name for r in results] in ([], ["null_payment_date"])


def test_second_batch_is_merged_into_history(spark):
    tables = generator.store(spark, END)
    changes = generator.second_batch(tables, END + timedelta(days=1))
    for name, changed in changes.items():
        key = ENTITIES[name].key
        assert changed.count() == 1
        merged = history.upsert(tables[name], changed, [key])
        assert merged.count() == tables[name].count()
        assert merged.where(F.col("updated_at") > F.lit(END).cast("timestamp")).count() == 1
    past = history.scd2(tables["customers"].unionByName(changes["customers"]), ["customer_id"], ["segment"])
    assert past.count() == 61 and past.where("is_current").count() == 60
