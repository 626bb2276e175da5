"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import discard, written


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a, b), a > b.

    Minima are combined before each shuffle and only joined back, so that a hub's rows can be split among tasks.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(least, "a")
    return (
        joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(least.select("a", F.col("m").alias("b")))
        .distinct()
    )


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v) of type long but the roots; a root is the least of its component.

    Loops and repeated edges are allowed, nulls are not links. Each round is written to the shared folder, so the
    plan stays short and a lost executor costs one round at most. An empty edge table gives an empty result.
    """
    now = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(),
        "edges",
    )
    before = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        last, now = now, written(_stars(now), "edges")
        discard(last)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
