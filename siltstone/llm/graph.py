"""Connected components of links between numbers, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import written

#: Rounds at most; alternating stars need about the logarithm of a component's size.
ROUNDS = 60
#: Links up to which a round is one task without a shuffle; more are dealt by node.
SMALL = 200_000


def _stars(links: DataFrame) -> DataFrame:
    """One round: every node is tied to the smallest of its neighbourhood (large star, then small star)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least.hint("merge"), "a")
    return small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node of its component) for every node of the links a, b.

    Links to oneself or to null are dropped; nodes without any other link don't appear. Each round is written to the
    shared folder, so that a lost executor costs one round.
    """
    links = links.where("a is not null and b is not null and a <> b")
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = (now.count(), None)
    for _ in range(ROUNDS):
        now = written(_stars(now.coalesce(1) if seen[0] <= SMALL else now), "links")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
