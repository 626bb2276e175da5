"""Helpers that every training-data operator shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows per Arrow batch handed to Python. Texts run to hundreds of kilobytes, so batches stay small.
ARROW_ROWS = 256
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bounds the memory of a Python worker by the rows of a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='lakeloom-')}")
    return spark.conf.get("spark.checkpoint.dir")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, safe from lost executors, of known size."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lakeloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._lakeloom_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def over_texts(
    df: DataFrame, columns: list[str], schema: str, rows: Callable[..., Iterator[list]], *args: object
) -> DataFrame:
    """mapInArrow over the named columns: rows(lists of column values, *args) gives lists of output columns.

    Strings arrive as UTF-8 bytes (None for null) when the column name ends in '!'.
    """
    names = [c.rstrip("!") for c in columns]
    raw = [c.endswith("!") for c in columns]
    tune(df.sparkSession)
    out = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in batches:
            got = []
            for i, as_bytes in enumerate(raw):
                values = batch.column(i)
                if as_bytes:
                    values = values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary())
                got.append(values.to_pylist())
            made = rows(*got, *args)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, type=f.type) for v, f in zip(made, arrow, strict=True)], schema=arrow
            )

    return df.select(*[quoted(n) for n in names]).mapInArrow(run, schema)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where a column of df has them already, so that joined columns can't be taken for df's."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    """Number of words, null counting as none; JVM only."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
