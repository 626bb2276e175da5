"""Raw text to typed entities, one projection per entity, and the latest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.config import RunContext
from lakeloom.functions.columns import convert
from lakeloom.specs import EntitySpec


def typed(raw: DataFrame, spec: EntitySpec) -> DataFrame:
    """The entity's columns converted, and lineage columns if there; other columns are left out on purpose."""
    lineage = [F.col(c) for c in raw.columns if c.startswith("_")]
    return raw.select(*[convert(c.name, c.kind).alias(c.name) for c in spec.columns], *lineage)


def latest(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ("updated_at",)) -> DataFrame:
    """One row per key: the greatest by `by`, ties by all other columns in order.

    The first row of each key, which Spark limits before the shuffle as well: a hot key costs one row per task. Null
    keys are one key, null times come first.
    """
    order = [F.desc(c) for c in (*by, *[c for c in df.columns if c not in keys and c not in by])]
    ranked = df.withColumn("__number", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__number = 1").drop("__number")


def with_metadata(df: DataFrame, run: RunContext) -> DataFrame:
    return df.withColumns({"_transformation_run_id": F.lit(run.run_id), "_transformed_at": F.lit(run.at).cast("timestamp")})


def silver(raw: DataFrame, spec: EntitySpec, run: RunContext) -> DataFrame:
    return with_metadata(latest(typed(raw, spec), [spec.key]), run)


def coercion_losses(raw: DataFrame, spec: EntitySpec) -> DataFrame:
    """One row: for each column how many texts couldn't be read, and __n, the rows."""
    lost = [
        F.count_if(F.col(c.name).isNotNull() & convert(c.name, c.kind).isNull()).alias(c.name)
        for c in spec.columns if c.kind not in ("text", "lower")
    ]
    return raw.agg(F.count("*").alias("__n"), *lost)
