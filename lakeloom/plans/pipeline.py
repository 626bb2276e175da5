"""Raw extracts to the star schema in one call, with control rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.config import LakeConfig, RunContext, create_schemas
from lakeloom.functions.columns import convert
from lakeloom.operators import history, quality, silver
from lakeloom.plans import gold
from lakeloom.sources import readers, sinks
from lakeloom.specs import ENTITIES


def ingest(spark: SparkSession, config: LakeConfig, run: RunContext) -> None:
    """Each extract to its raw table. Control rows are written last, so a failed load leaves none."""
    rows = []
    for name, spec in ENTITIES.items():
        path = f"{config.landing}/{name}.csv"
        raw = readers.read_csv(spark, path, spec.raw_schema, config.line_breaks)
        raw = readers.with_lineage(raw, config.source_system, spec.source_table, path, run.run_id, run.at)
        sinks.overwrite(raw, config.table("bronze", name), config.table_format)
        stored = silver.typed(spark.table(config.table("bronze", name)), spec)
        rows.append(history.watermark_rows(stored, spec.source_table, run))
    sinks.append(reduce(DataFrame.unionByName, rows), config.table("control", "ingestion_watermarks"), config.table_format)


def refine(spark: SparkSession, config: LakeConfig, run: RunContext) -> None:
    for name, spec in ENTITIES.items():
        made = silver.silver(spark.table(config.table("bronze", name)), spec, run)
        sinks.overwrite(made, config.table("silver", name), config.table_format)


def check(spark: SparkSession, config: LakeConfig, run: RunContext) -> DataFrame:
    """Writes the results of the run and gives them, in order. Failures don't stop the pipeline."""
    tables = {name: spark.table(config.table("silver", name)) for name in ENTITIES}
    raw = {name: spark.table(config.table("bronze", name)) for name in ENTITIES}
    typed = {name: silver.typed(raw[name], spec) for name, spec in ENTITIES.items()}
    results = config.table("control", "data_quality_results")
    sinks.append(quality.all_checks(tables, run, raw, typed), results, config.table_format)
    return spark.sql(
        f"SELECT * FROM {results} WHERE quality_run_id = :run ORDER BY table_name, check_name", args={"run": run.run_id}
    )


def publish(spark: SparkSession, config: LakeConfig) -> DataFrame:
    """Dimensions, fact and aggregate; the aggregate reads the fact as written. Gives the KPIs."""
    table = lambda n: spark.table(config.table("silver", n))
    out = lambda df, n, **k: sinks.overwrite(df, config.table("gold", n), config.table_format, **k)
    out(gold.dim_customers(table("customers")), "dim_customers")
    changes = silver.typed(spark.table(config.table("bronze", "customers")), ENTITIES["customers"])
    out(gold.dim_customers_history(changes), "dim_customers_history")
    out(gold.dim_products(table("products")), "dim_products")
    out(gold.dim_date(table("orders")), "dim_date")
    out(gold.fact_sales(table("order_items"), table("orders")), "fact_sales", sort_by=("date_key",))
    fact = spark.table(config.table("gold", "fact_sales"))
    out(gold.agg_daily_sales(fact, spark.table(config.table("gold", "dim_products"))), "agg_daily_sales")
    return gold.kpi_sales(fact)


def merge_batch(spark: SparkSession, config: LakeConfig, name: str, changes: DataFrame, run: RunContext) -> DataFrame:
    """Raw changes of one entity are typed, the latest row per key becomes the new snapshot. Gives the typed changes."""
    spec, table = ENTITIES[name], config.table("silver", name)
    fresh = silver.with_metadata(silver.typed(changes, spec), run)
    sinks.replace_read_table(spark, history.upsert(spark.table(table), fresh, [spec.key]), table, config.table_format)
    return fresh


class SchemaReview(ValueError):
    """A source lost or changed columns; nothing was loaded from it."""


def load_increment(spark: SparkSession, config: LakeConfig, name: str, source: DataFrame, run: RunContext) -> DataFrame:
    """The rows of a source, text or typed, that were updated after the last watermark and up to the run's time.

    They are added to the raw table and merged into Silver; the control row is given back, to be written once all went
    well: until then the next run reads the same window again, and merging it again changes nothing. New columns are
    let into the raw table and audited, lost or retyped ones raise after they are audited.
    """
    spec = ENTITIES[name]
    control = config.table("control", "ingestion_watermarks")
    sinks.append(history.audit_rows(spark, spec, source.schema, run), config.table("control", "schema_audit"), config.table_format)
    diff = history.source_diff(spec, source.schema)
    if not history.compatible(diff):
        raise SchemaReview(f"{spec.source_table}: {diff}")
    low = history.last_watermark(spark, control, spec.source_table)
    text = source.schema["updated_at"].dataType.simpleString() == "string"
    at = convert("updated_at", "timestamp") if text else F.col("updated_at").cast("timestamp")
    window = source.where(readers.between_watermarks(at, low, F.lit(run.at).cast("timestamp")))
    raw = readers.with_lineage(sinks.as_text(window, spec), config.source_system, spec.source_table, spec.source_table, run.run_id, run.at)
    table = config.table("bronze", name)
    sinks.grow(spark, raw, table, config.table_format)
    # From here on the rows are read as they were stored, so that the source is read once.
    stored = spark.table(table).where(F.col("_ingestion_run_id") == run.run_id)
    fresh = merge_batch(spark, config, name, stored, run)
    return history.read_watermark(history.watermark_rows(fresh, spec.source_table, run), low)


def run_increment(spark: SparkSession, config: LakeConfig, sources: dict[str, DataFrame], run: RunContext | None = None) -> DataFrame:
    """run_pipeline() for what changed since: windows by watermark, merges, checks, Gold, and the control rows last."""
    run = run or RunContext()
    rows = [load_increment(spark, config, name, source, run) for name, source in sources.items()]
    check(spark, config, run)
    kpis = publish(spark, config)
    sinks.append(reduce(DataFrame.unionByName, rows), config.table("control", "ingestion_watermarks"), config.table_format)
    return kpis


def jdbc_sources(spark: SparkSession, options: dict[str, str], names: Sequence[str] = tuple(ENTITIES), **read: object) -> dict[str, DataFrame]:
    """The source system's tables for run_increment(), whose windows are then pushed down; see readers.read_jdbc()."""
    return {name: readers.read_jdbc(spark, ENTITIES[name].source_table, options, **read) for name in names}


def export_all(spark: SparkSession, config: LakeConfig, folder: str) -> dict[str, int]:
    """All entities of Silver as CSV below the folder, and how many rows each has."""
    return {name: sinks.export_csv(spark.table(config.table("silver", name)), f"{folder}/{name}", spec) for name, spec in ENTITIES.items()}


def run_pipeline(spark: SparkSession, config: LakeConfig, run: RunContext | None = None) -> DataFrame:
    run = run or RunContext()
    create_schemas(spark, config)
    ingest(spark, config, run)
    refine(spark, config, run)
    check(spark, config, run)
    return publish(spark, config)
