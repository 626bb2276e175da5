"""Names of layers and tables, and the session."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class LakeConfig:
    """Where layers live. Tables have two-part names, so that any session catalog will do."""

    bronze_schema: str = "bronze"
    silver_schema: str = "silver"
    gold_schema: str = "gold"
    control_schema: str = "control"
    landing: str = "landing"
    line_breaks: bool = True  # whether fields of extracts may hold them; if not, large files are read by several tasks
    table_format: str = "parquet"
    source_system: str = "azure_sql"

    def table(self, layer: str, name: str) -> str:
        return f"{getattr(self, layer + '_schema')}.{name}"

    @property
    def schemas(self) -> tuple[str, ...]:
        return self.bronze_schema, self.silver_schema, self.gold_schema, self.control_schema


@dataclass(frozen=True)
class RunContext:
    """Identity and time of a run; given from outside in tests."""

    run_id: str = field(default_factory=lambda: str(uuid4()))
    at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))


def session(name: str = "lakeloom", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. Names of settings may use __ for dots."""
    builder = SparkSession.builder.appName(name)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}.items():
        builder = builder.config(k, v)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def create_schemas(spark: SparkSession, config: LakeConfig) -> None:
    for schema in config.schemas:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
