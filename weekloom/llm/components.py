"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014).

Every step is a minimum per node followed by a join on that node, so no neighbourhood is gathered:
the minimum is combined before the shuffle, and adaptive execution splits the join of a node with
many neighbours. Each round ends in a stored table, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.session import write_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; the root is the smallest node of the component.

    Ids are longs. Loops and repeated edges do no harm; nodes without an edge to another are left out.
    """

    def state(df: DataFrame) -> tuple:
        fold = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        return tuple(df.agg(F.count(F.lit(1)), fold).first())

    now = write_table(edges.where("u <> v").select("u", "v").distinct(), "edges")
    before, after = None, state(now)
    while before != after:
        now = write_table(_small_star(_large_star(now)), "edges")
        before, after = after, state(now)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
