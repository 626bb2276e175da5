"""Chat formatting: logged snapshots of growing conversations collapse to the longest, which are rendered.

All of it is built from SQL functions and runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import table, written

#: Turns in one block at most: hashes go on within blocks, then those of the blocks before are added.
BLOCK = 128
SEEDS = (17, 71)
#: Characters of a role and of a text by which turns are dealt.
HEAD = 16


KEY = ["conv_id", "block"]


def numbered(turns: DataFrame) -> DataFrame:
    """The distinct turns (conv_id, turn, role, text) with number, block, d1 and d2.

    A turn's place goes by (turn, role, text), nulls first. All turns are dealt by ranges of that order and numbered as
    they come, and a block holds BLOCK numbers: so a conversation is in several tasks and blocks if it is long, whatever
    its turns are called. d1 and d2 are hashes of role and text: all that follows up to rendering reads these numbers
    and leaves the texts where they are written.
    """
    order = ("conv_id", "turn", "role", "text")
    nulls = F.concat(F.col("role").isNull().cast("int"), F.col("text").isNull().cast("int"))
    marks = {f"d{i}": F.xxhash64(F.lit(seed), "role", "text", nulls) for i, seed in enumerate(SEEDS, 1)}
    # The driver holds a sample of what the ranges go by, so that is the start of a role and of a text. Past a role that
    # goes on after it the text's start says nothing about the order.
    goes_on = F.coalesce(F.length("role") > HEAD, F.lit(False))
    ranges = ["conv_id", "turn", F.substring("role", 1, HEAD), goes_on, F.when(~goes_on, F.substring("text", 1, HEAD))]
    dealt = turns.select(*order).distinct().repartitionByRange(*ranges).sortWithinPartitions(*order)
    rows = written(dealt.withColumn("number", F.monotonically_increasing_id()).withColumns(marks), "turns")
    # Within a block the numbers of one conversation are in a row, so its least one tells the others' places.
    return rows.withColumn("block", F.floor(F.col("number") / BLOCK))


def _same(left: str = "conv_id") -> Column:
    return F.col(left).eqNullSafe(F.col("__c")) & (F.col("block") == F.col("__b"))


def offsets(numbers: DataFrame) -> DataFrame:
    """(__c, __b, base, n): for each block of a conversation what a turn's number is above its place, and the turns in all."""
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbers.groupBy(*KEY).agg(F.count("*").alias("m"), F.min("number").alias("first"))
    return counts.select(
        F.col("conv_id").alias("__c"), F.col("block").alias("__b"), (F.col("first") - 1 - F.coalesce(F.sum("m").over(before), F.lit(0))).alias("base"),
        F.sum("m").over(Window.partitionBy("conv_id")).alias("n"),
    )


def prefixes(numbers: DataFrame, bases: DataFrame) -> DataFrame:
    """(conv_id, pos, n, h1, h2) for every turn: the rolling hashes of the conversation up to it.

    A turn's hash covers its position, role and text, and a prefix's is the exclusive or of those, so it goes on from
    block to block without having a whole conversation in one task. Two conversations begin alike as far as their
    hashes agree.
    """
    placed = numbers.select(*KEY, "number", "d1", "d2").join(bases, _same()).select(*KEY, "n", (F.col("number") - F.col("base")).alias("pos"), "d1", "d2")
    for h in ("d1", "d2"):
        placed = placed.withColumn(h, F.xxhash64("pos", h))
    placed = written(placed, "placed")
    sums = placed.groupBy(*KEY).agg(F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    sums = sums.select(
        F.col("conv_id").alias("__c"), F.col("block").alias("__b"), F.coalesce(F.bit_xor("d1").over(before), none).alias("b1"),
        F.coalesce(F.bit_xor("d2").over(before), none).alias("b2"),
    )
    rolling = Window.partitionBy(*KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.withColumns({"h1": F.bit_xor("d1").over(rolling), "h2": F.bit_xor("d2").over(rolling)})
    return rolled.join(sums, _same()).select(
        "conv_id", F.col("pos").cast("long").alias("pos"), F.col("n").cast("long").alias("n"),
        F.col("h1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("h2").bitwiseXOR(F.col("b2")).alias("h2"),
    )


def maximal(turns: DataFrame) -> DataFrame:
    """The turns of the conversations that no other one continues: conv_id, turn, role, text, pos, n and n_copies.

    n_copies is how often the conversation was logged in full. Of equal conversations the one with the least conv_id
    stays (a null id last). Prefixes and full conversations are reduced to distinct hashes before they are joined, so
    that a first turn that opens a third of the log is one row.
    """
    numbers = numbered(turns)
    bases = written(offsets(numbers), "offsets")
    rolled = written(prefixes(numbers, bases), "prefixes")
    full = rolled.where("pos = n").groupBy("n", "h1", "h2").agg(
        F.min(F.struct(F.col("conv_id").isNull().alias("unnamed"), "conv_id")).alias("least"), F.count("*").alias("n_copies")
    )
    inner = rolled.where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    stay = full.join(inner, ["n", "h1", "h2"], "left_anti").select(F.col("least.conv_id").alias("__id"), "n_copies")
    kept = written(bases.join(stay, F.col("__c").eqNullSafe(F.col("__id"))).drop("__id"), "maximal")
    return numbers.join(kept, _same()).select(
        "conv_id", "turn", "role", "text", (F.col("number") - F.col("base")).alias("pos"), "n", "n_copies"
    )


def rendered(turns: DataFrame, chunk: int = 512) -> DataFrame:
    """(conv_id, chunk, n_turns, n_copies, text): the maximal conversations as <|role|> blocks, in order.

    A conversation of up to `chunk` turns is one row, chunk 0; longer ones go on in further rows, so that no row has
    to hold an unbounded conversation. Rows that are equal in all four columns are one turn. A null role is rendered
    as 'unknown', a null text as none. Null conv_ids are one conversation, null turns come first in theirs. Texts of any
    length are kept whole and read only to number and to render them. An empty table gives an empty result; other
    columns are not read, whatever their names.
    """
    body = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>\n"))
    lines = maximal(turns).select("conv_id", F.floor((F.col("pos") - 1) / chunk).alias("chunk"), "n", "n_copies", F.struct("pos", body.alias("body")).alias("line"))
    return (
        lines.groupBy("conv_id", "chunk").agg(
            F.max("n").cast("long").alias("n_turns"), F.max("n_copies").cast("long").alias("n_copies"), F.sort_array(F.collect_list("line")).alias("lines"))
        .select("conv_id", F.col("chunk").cast("long").alias("chunk"), "n_turns", "n_copies", F.array_join(F.transform("lines", lambda x: x["body"]), "").alias("text"))
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(table(spark, sf_dir, "conversations"))


OP2_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
        string_agg(md5(coalesce('r' || role, 'n') || chr(31) || coalesce('t' || text, 'n')), ',') OVER w AS prefix
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE pos = n GROUP BY prefix),
m AS (SELECT * FROM f WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos < n))
SELECT p.conv_id, CAST((pos - 1) // 512 AS BIGINT) AS chunk, CAST(max(n) AS BIGINT) AS n_turns,
  CAST(max(n_copies) AS BIGINT) AS n_copies,
  string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY pos) AS text
FROM p JOIN m ON p.conv_id = m.conv_id GROUP BY p.conv_id, (pos - 1) // 512
"""
