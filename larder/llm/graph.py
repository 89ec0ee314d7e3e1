"""Connected components over links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.pin import pinned


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of the links (a, b).

    Alternating large-star and small-star steps: every step is a minimum per node, which Spark sums
    up before the shuffle, and a join that adaptive execution splits at hot nodes. Each round is
    written to the checkpoint folder. Links (a, a) and null nodes are ignored.
    """
    links = pinned(links.select("a", "b").filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        links = pinned(_small_star(_large_star(links)))
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links not settled after {rounds} rounds")
    roots = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    own = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return roots.unionByName(own)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    kept = least.select("a", F.col("low").alias("b"))
    return moved.filter("a <> b").unionByName(kept).distinct()
