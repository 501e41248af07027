"""Connected components of a table of links, by alternating stars.

A round of the large star hangs every larger neighbour of a vertex on the smallest one around it;
a round of the small star does so for the smaller neighbours. Both only need the minimum per
vertex, which combines on the map side, and a join that adaptive execution may split, so a
vertex with a third of all links is no single task. Rounds are staged; their number grows with
the logarithm of the longest path. The driver sees two sums per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.staging import stage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("root"))
    hung = links.join(least, "a").where("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return hung.unionAll(least.select("a", F.col("root").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex of ``links`` (a, b); the root is the least vertex reachable."""
    now = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = mark(now)
    while before[0]:
        now = stage(_small_star(_large_star(now)), "links")
        after = mark(now)
        if after == before:
            break
        before = after
    # Every link now ends at its root; (a, b) with a > b.
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionAll(
        now.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct()
    )
