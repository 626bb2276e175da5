"""Mixing sources to target weights: pivotal rounding of fractional copies along a distributed reduction tree.

Each source gets a target in words; a document's expected copies are its source's target over its size. The whole part
is taken as it is. The fractional parts are rounded by pairs: words move at random from one document of a pair to the
other, without changing their sum or any expectation, until one of the two is in whole or out. Groups of documents
are settled so, and the one left over of each group meets those of other groups on the next level.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import fresh, n_words, quoted, table, written

#: Documents settled in one group, about, on each level of the tree.
FAN = 48
#: Words are counted in this many parts, so that moving them is exact.
PARTS = 1 << 20
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size, target) of sizes (source, size).

    Sources in order of code points, null last, weigh WEIGHTS in turn and share `share` times all words; a target
    stops at `limit` times its source's size and the excess goes to the others by weight, until none is above.
    No words at all: targets of zero. The loop reads one row of sums each time, the sources stay distributed.
    """
    totals = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    # Ranks without one task that holds all sources: ranges first, then offsets of the few ranges.
    order = [F.col("source").isNull(), F.col("source")]
    parts = written(
        totals.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source")
        .withColumn("part", F.spark_partition_id()), "ranks",
    )
    counts = parts.groupBy("part").agg(F.count("*").alias("k"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") + F.col("base")) % len(WEIGHTS) + 1).cast("int"))
    weighed = written(
        parts.withColumn("rank", rank).join(bases, "part")
        .select("source", "source_size", "n", weight.cast("double").alias("weight")), "weights",
    )
    level, capped = 0.0, -1
    most = F.col("source_size") * limit
    budget = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    while True:
        # Sources whose share is above their limit at this level stay there, as the level only rises.
        above = F.lit(level) * F.col("weight") >= most if capped >= 0 else F.lit(False)
        row = weighed.agg(
            F.sum(F.when(above, most).otherwise(0.0)).alias("taken"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(F.when(above, 1).otherwise(0)).alias("n"),
        ).first()
        if row["n"] == capped or not row["open"]:
            break
        level, capped = (budget - row["taken"]) / row["open"], row["n"]
    if row["n"] is not None and not row["open"]:
        level = math.inf
    target = F.least(most, F.lit(level) * F.col("weight")) if level != math.inf else most
    return weighed.select("source", "source_size", "n", F.coalesce(target, F.lit(0.0)).alias("target"))


def _pivot(state: Column, x: Column) -> Column:
    """One step: the one left over and the next document; state (open, done). Parts are whole numbers throughout."""
    a = state["open"]
    up = F.least(a["full"] - a["m"], x["m"])  # to the one left over from x
    down = F.least(a["m"], x["full"] - x["m"])
    u = F.pmod(F.xxhash64(a["id"], a["salt"], a["copy"], x["id"], x["salt"], x["copy"], F.lit("pivot")), F.lit(1 << 40)) / float(1 << 40)
    move = F.when(u * (up + down) < down, up).otherwise(-down)

    def moved(y: Column, m: Column) -> Column:
        return F.struct(y["id"].alias("id"), y["salt"].alias("salt"), y["copy"].alias("copy"), y["size"].alias("size"), y["base"].alias("base"), m.alias("m"), y["full"].alias("full"))

    first, second = moved(a, a["m"] + move), moved(x, x["m"] - move)
    settled = (first["m"] == 0) | (first["m"] == first["full"])
    fresh = F.struct(x.alias("open"), state["done"].alias("done"))
    step = F.when(
        settled, F.struct(second.alias("open"), F.concat(state["done"], F.array(first)).alias("done"))
    ).otherwise(F.struct(first.alias("open"), F.concat(state["done"], F.array(second)).alias("done")))
    return F.when(a.isNull(), fresh).otherwise(step)


KIND = "id {0}, salt long, copy long, size long, base long, m long, full long"
#: Rows that are equal in all columns are numbered so many at a time.
EQUAL = 10_000


def numbered(sizes: DataFrame) -> DataFrame:
    """sizes with copy: rows equal in all columns are counted and told apart by numbers, in two steps, so that many of
    them are neither one group nor the rows of one task."""
    counts = sizes.groupBy("doc_id", "salt", "source", "size").agg(F.count("*").alias("n"))
    chunks = counts.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / EQUAL))))
    first = F.col("chunk") * EQUAL
    copy = F.explode(F.sequence(first, F.least(first + EQUAL, F.col("n")) - 1)).alias("copy")
    return chunks.select("doc_id", "salt", "source", "size", copy)


def copies(sizes: DataFrame, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(doc_id, salt, source, size, source_size, target, taken) for every row of sizes (doc_id, salt, source, size).

    taken: words of the mix from that row. A row is taken whole, a whole number of times, but for one of each source:
    what the tree leaves open there is taken as a part, its first words, so that each source's words add up to its
    target but for rounding. Rows without words are taken zero times. Random numbers are hashes of ids, so reruns
    agree; rows equal in all columns are rounded one by one.
    """
    kind = sizes.select("doc_id").schema["doc_id"].dataType.simpleString()
    targets = written(source_targets(sizes, share, limit), "targets")
    sources, largest = targets.agg(F.count("*"), F.max("n")).first()
    by_source = targets.drop("n").withColumnRenamed("source", "__source")
    if sources <= 50_000:  # a hundred bytes each at most; more are joined by a shuffle
        by_source = F.broadcast(by_source)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(rate), F.lit(int(limit)))
    rows = numbered(sizes).join(by_source, F.col("source").eqNullSafe(F.col("__source")), "left").select(
        "source", F.col("doc_id").alias("id"), "salt", "copy", "size", (whole * F.col("size")).cast("long").alias("base"),
        F.round((rate - whole) * F.col("size") * PARTS).cast("long").alias("m"),
        (F.col("size") * PARTS).alias("full"),
    )
    entry = F.struct(*[c.split()[0] for c in KIND.split(", ")])
    settled = (F.col("m") == 0) | (F.col("m") == F.col("full"))
    columns = ["source", "id", "salt", "copy", "size", "base", "m", "full"]
    done = []
    level, n, now = 0, largest or 0, rows
    while True:
        groups = max(1, -(-n // FAN))
        key = F.pmod(F.xxhash64(F.lit(level), "id", "salt", "copy"), F.lit(groups)) if groups > 1 else F.lit(0).cast("long")
        empty = F.struct(F.lit(None).cast(f"struct<{_as_type(kind)}>").alias("open"), F.array().cast(f"array<struct<{_as_type(kind)}>>").alias("done"))
        grouped = (
            now.withColumn("__group", key).groupBy("source", "__group")
            .agg(F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(level), "id", "salt", "copy").alias("at"), entry.alias("e")))).alias("rows"))
            .select("source", F.filter(F.transform("rows", lambda r: r["e"]), lambda e: (e["m"] > 0) & (e["m"] < e["full"])).alias("loose"),
                    F.filter(F.transform("rows", lambda r: r["e"]), lambda e: (e["m"] <= 0) | (e["m"] >= e["full"])).alias("fixed"))
            .select("source", "fixed", F.aggregate("loose", empty, _pivot).alias("s"))
        )
        out = grouped.select(
            "source",
            F.explode(F.concat("fixed", "s.done", F.when(F.col("s.open").isNull(), F.array().cast(f"array<struct<{_as_type(kind)}>>")).otherwise(F.array("s.open")))).alias("e"),
        ).select("source", *[F.col(f"e.{c}").alias(c) for c in columns[1:]])
        out = written(out, "pivots")
        if groups == 1:
            done.append(out)
            break
        done.append(out.where(settled))
        # At most one document of each group is left.
        now, n, level = out.where(~settled), groups, level + 1
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    taken = F.col("base") + F.round(F.col("m") / float(PARTS)).cast("long")
    return every.join(by_source, F.col("source").eqNullSafe(F.col("__source")), "left").select(
        F.col("id").alias("doc_id"), "salt", "source", "size", "source_size", "target", taken.alias("taken")
    )


def _as_type(kind: str) -> str:
    return ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in KIND.format(kind).replace("long", "bigint").split(", "))


def sized(docs: DataFrame, source: str = "source") -> DataFrame:
    """(doc_id, salt, source, size) of docs; salt tells rows apart that share a doc_id but not a text."""
    return docs.select("doc_id", F.xxhash64("text").alias("salt"), quoted(source).alias("source"), n_words(F.col("text")).alias("size"))


def mixed(docs: DataFrame, source: str = "source", share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target and taken; see copies().

    A null text has no words; a null source is a source of its own and the last; repeated rows count each; texts of any
    length are only counted, where they are; an empty table gives an empty result; other columns are not read, whatever
    their names. All of it runs in the JVM.
    """
    sizes = written(sized(docs, source), "sizes")
    return copies(sizes, share, limit).select("doc_id", "size", "source_size", "target", "taken")


def remix(docs: DataFrame, source: str = "source", share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; the one of each source taken in part has its first words.

    n_chars, if there, follows the text. Rows without words are left out, as no target counts them. Other columns come
    out as they are, whatever their names; an empty table stays empty.
    """
    sizes = written(sized(docs, source), "sizes")
    id_, salt, takes, size, at, part = fresh(docs, "__id", "__salt", "__takes", "__size", "__at", "__part")
    marks = copies(sizes, share, limit).where("taken > 0").groupBy("doc_id", "salt").agg(
        F.sort_array(F.collect_list("taken"), asc=False).alias(takes), F.max("size").alias(size)
    )
    marks = written(marks.select(F.col("doc_id").alias(id_), F.col("salt").alias(salt), takes, size), "takes")
    text = F.xxhash64("text")
    # Repeated rows are counted first, so that each take is given out once whichever of them comes first.
    rows = docs.withColumn(at, F.row_number().over(Window.partitionBy("doc_id", text).orderBy("doc_id")) if _repeats(sizes) else F.lit(1))
    joined = rows.join(marks, F.col("doc_id").eqNullSafe(F.col(id_)) & (text == F.col(salt)))
    take = F.get(takes, F.col(at) - 1)
    whole = F.floor(F.coalesce(take, F.lit(0)) / F.col(size))
    rest = F.coalesce(take, F.lit(0)) - whole * F.col(size)
    first_words = F.array_join(F.slice(F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), F.lit(1), F.greatest(rest.cast("int"), F.lit(1))), " ")
    pieces = F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    out = joined.withColumn(part, F.explode(pieces))
    changed = {"text": F.when(F.col(part) > 0, first_words).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col(part) > 0, F.length(first_words).cast(kind)).otherwise(F.col("n_chars"))
    return out.select(*[changed[c].alias(c) if c in changed else quoted(c) for c in docs.columns])


def _repeats(sizes: DataFrame) -> bool:
    return bool(sizes.groupBy("doc_id", "salt").agg(F.count("*").alias("n")).where("n > 1").limit(1).count())


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
