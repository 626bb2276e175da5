"""Small tables with everything that is awkward in them."""

from __future__ import annotations

from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet " * 6000


def docs(spark, texts, source="s"):  # noqa: ANN001, ANN201
    """Documents from texts, or from (text, source) pairs."""
    rows = [(i, t, "en", source) if not isinstance(t, tuple) else (i, t[0], "en", t[1]) for i, t in enumerate(texts)]
    rows = [(*r, len(r[1] or "")) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def awkward(spark):  # noqa: ANN001, ANN201
    """Nulls in each column, empty and blank and long texts, repeated rows, and columns whose names clash."""
    rows = [
        (1, "one two three", "en", "a", 13), (1, "one two three", "en", "a", 13), (2, None, None, None, None), (3, "", "en", "b", 0),
        (4, " \t\n", "en", "b", 3), (None, "a null id has this text", "en", "a", 23), (5, LONG, "en", "a", len(LONG)), (6, "ünï ço∂é 🙂 x", "fr", None, 13),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ["host", "size", "key", "fp", "rank", "group", "block", "n", "bucket", "__kept", "component_id", "id", "salt",
             "__id", "__bad", "__salt", "__text", "__takes", "__at", "__part", "node", "taken", "x.y", "a`b", "ungleich ä"]
    for c in extra:
        df = df.withColumn(c, F.lit("x"))
    return df


def empty(spark):  # noqa: ANN001, ANN201
    return awkward(spark).limit(0)
