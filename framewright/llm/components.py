"""Connected components by alternating large-star and small-star, on DataFrames of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import materialise


def large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return both.join(least, "u").where("v > u and v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    moved = down.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.withColumnRenamed("least", "v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether all edges form stars: every node has one centre, and no centre has one."""
    twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
    centres = edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").select("u")
    return not twice.unionByName(centres).take(1)


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component), for every node of the edges (u, v) but the labels themselves.

    Each half round is written to the shared folder; the driver only learns whether stars are left. The number of rounds grows with
    the logarithm of the number of nodes. Self-loops and repeated edges do no harm; no edges give no rows.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _settled(now):
        now = materialise(small_star(materialise(large_star(now), "large-star")), "small-star")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
