"""Writers: snapshots, audit rows, CSV exports. The one place with side effects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lakeloom.functions.columns import csv_text
from lakeloom.specs import EntitySpec


def overwrite(df: DataFrame, table: str, fmt: str = "parquet", partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """Replaces a table as a whole, schema included. Rows may be clustered for later pruning."""
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    writer = df.write.format(fmt).mode("overwrite").option("overwriteSchema", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)


def append(df: DataFrame, table: str, fmt: str = "parquet") -> None:
    df.write.format(fmt).mode("append").saveAsTable(table)


def replace_read_table(spark: SparkSession, df: DataFrame, table: str, fmt: str = "parquet") -> None:
    """Replaces a table by a frame that reads it: the new snapshot is complete before the old one goes."""
    fresh = f"{table}__next"
    overwrite(df, fresh, fmt)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {table}")


def export_csv(df: DataFrame, path: str, spec: EntitySpec) -> int:
    """Text as the source exports it, sorted by key for stable files; gives the number of rows.

    Null and empty can't be told apart there.
    """
    texts = [csv_text(F.col(c.name), c.kind).alias(c.name) for c in spec.columns]
    seen = Observation()
    rows = df.orderBy(spec.key).select(*texts).observe(seen, F.count(F.lit(1)).alias("n"))
    rows.write.mode("overwrite").options(header=True, escape='"', emptyValue="").csv(path)
    return seen.get["n"]


def as_text(df: DataFrame, spec: EntitySpec) -> DataFrame:
    """A source's columns as text, as its extract would have them; nulls stay null, columns of no rule are cast."""
    kinds = {c.name: c.kind for c in spec.columns}
    out = []
    for f in df.schema:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        text = c if f.dataType == StringType() else F.when(c.isNotNull(), csv_text(c, kinds.get(f.name, "text")))
        out.append(text.alias(f.name))
    return df.select(*out)


def grow(spark: SparkSession, df: DataFrame, table: str, fmt: str = "parquet") -> None:
    """append(), for rows that may have columns which the table lacks: then it is written anew, with nulls in old rows."""
    known = spark.table(table)
    if set(df.columns) <= set(known.columns):
        append(df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(known.schema[c].dataType).alias(c) for c in known.columns]), table, fmt)
    else:
        replace_read_table(spark, known.unionByName(df, allowMissingColumns=True), table, fmt)
