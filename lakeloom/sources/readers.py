"""Readers: CSV extracts, JDBC tables, catalog tables, event streams."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of an extract that one task may read.
WHOLE_FILE = 1 << 30
#: Seconds to wait for a connection. Queries may take as long as they need.
LOGIN_SECONDS = 60
REQUIRED_ENV = ("SOURCE_DB_URL", "SOURCE_DB_USER", "SOURCE_DB_PASSWORD", "SOURCE_DB_DRIVER")


def largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file that a path, or the folder or pattern that it names, holds."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(where) or []
    each = [s for f in found for s in (files.listStatus(f.getPath()) if f.isDirectory() else [f])]
    return max((s.getLen() for s in each), default=0)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, line_breaks: bool = True, largest: int = WHOLE_FILE) -> DataFrame:
    """An extract as text: RFC 4180 quoting, quoted line breaks, byte order mark; columns by the header's order.

    Where fields may hold line breaks, a file is read by one task, as only its start tells what is quoted; a file of
    more than `largest` bytes is refused then. Large extracts should come as many files, or without such fields
    (line_breaks=False), and are then split.
    """
    if line_breaks and (size := largest_file(spark, path)) > largest:
        raise ValueError(f"{path} has a file of {size} bytes that one task would read; split it, or read it with line_breaks=False")
    return spark.read.schema(schema).options(header=True, multiLine=line_breaks, escape='"', enforceSchema=False, encoding="UTF-8").csv(path)


def with_lineage(df: DataFrame, system: str, table: str, file: str, run_id: str, at: datetime) -> DataFrame:
    return df.withColumns({
        "_source_system": F.lit(system), "_source_table": F.lit(table), "_source_file": F.lit(file),
        "_ingestion_run_id": F.lit(run_id), "_ingested_at": F.lit(at).cast("timestamp"),
    })


def jdbc_options(env: dict[str, str] | None = None) -> dict[str, str]:
    """Connection options from the environment; says which names are missing."""
    env = dict(os.environ) if env is None else env
    if missing := [k for k in REQUIRED_ENV if not env.get(k)]:
        raise ValueError(f"missing settings: {', '.join(missing)}")
    return {"url": env[REQUIRED_ENV[0]], "user": env[REQUIRED_ENV[1]], "password": env[REQUIRED_ENV[2]], "driver": env[REQUIRED_ENV[3]]}


def read_jdbc(
    spark: SparkSession, table: str, options: dict[str, str], key: str | None = None, bounds: tuple[int, int] | None = None,
    partitions: int = 8, fetch_size: int = 500,
) -> DataFrame:
    """A table over JDBC; with a key and its bounds it is read by several tasks. Later filters are pushed down."""
    return spark.read.format("jdbc").options(**jdbc_read_options(table, options, key, bounds, partitions, fetch_size)).load()


def jdbc_read_options(
    table: str, options: dict[str, str], key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, fetch_size: int = 500
) -> dict[str, str]:
    """Settings of a read: loginTimeout goes to the driver, the others are Spark's."""
    out = options | {"dbtable": table, "fetchsize": str(fetch_size), "loginTimeout": str(LOGIN_SECONDS)}
    if key and bounds:
        out |= {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return out


def between_watermarks(column: Column, low: object, high: object) -> Column:
    """The half-open window (low, high]; no lower bound reads from the start. Simple enough to be pushed down."""
    upper = column <= F.lit(high)
    return upper if low is None else (column > F.lit(low)) & upper


def read_events_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The raw JSON of a topic as a stream."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return reader.load().select(F.col("value").cast("string").alias("json"))


def session_info(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT current_catalog() AS catalog, current_schema() AS schema, current_timestamp() AS at, version() AS version")


def schemas(spark: SparkSession) -> list[str]:
    return [d.name for d in spark.catalog.listDatabases()]
