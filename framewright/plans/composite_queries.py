"""Queries of the composites: rows-only, their invariants are in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import composites, shapes, snakes
from framewright.plans.base import Views, query
from framewright.plans.frame_queries import rounded

query("e32_outlines")(lambda s: composites.outlines(s.contours, 0.5))


@query("e35_active_contours")
def e35(s: Views):
    """A line across each frame, in the frame's blurred values."""
    start = s.frames8.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7))))
    points = start.select((F.col("video_id") * 100_000_000 + F.col("frame_idx")).alias("curve_id"), "video_id", "frame_idx", "i", F.col("i").cast("double").alias("x"), F.lit(3.5).alias("y"))
    slopes = shapes.gradients(s.pixels8, 8, 8, 1.0)
    return rounded(snakes.active_contours(points, slopes, (8, 8), alpha=0.1, beta=1.0, gamma=0.002), "x", "y")


def moved(s: Views):
    """The contours, which lie within 36..64, moved to the corner."""
    return s.contours.select("poly_id", "i", (F.col("x") - 36).alias("x"), (F.col("y") - 36).alias("y"))


query("e36_centerlines")(lambda s: composites.centerlines(s.contours))
query("e36_centerlines_optimised")(lambda s: rounded(composites.optimised_centerlines(moved(s), (28, 28), 3.0, 10.0, 10.0), "x", "y"))
query("e36_centerlines_smooth")(lambda s: rounded(composites.smooth_centerlines(moved(s), (28, 28), 2.0, 2.0, 4.0, alpha=10.0, beta=10.0), "x", "y"))
