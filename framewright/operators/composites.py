"""Composites: outlines of self-crossing curves, active contours, centre lines. All shapes advance together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import pieces
from framewright.functions.iterate import cut
from framewright.operators import boxes, curves, regions, shapes, snakes


def polygon_mask(contours: DataFrame) -> DataFrame:
    """Mask pixels of polygons, one frame a polygon (video_id is the polygon)."""
    return shapes.rasterize(contours).select(F.col("poly_id").alias("video_id"), F.lit(0).cast("long").alias("frame_idx"), "y", "x")


def outlines(contours: DataFrame, resolution: float) -> DataFrame:
    """Outer outline of closed curves that may cross themselves: raster at the resolution, largest region, its boundary, scaled back."""
    fine = contours.select("poly_id", "i", F.round(F.col("x") / resolution).cast("int").alias("x"), F.round(F.col("y") / resolution).cast("int").alias("y"))
    ring = shapes.span_outlines(_spans(fine))
    return ring.select(F.col("video_id").alias("poly_id"), "i", ((F.col("x") - 0.5) * resolution).alias("x"), ((F.col("y") - 0.5) * resolution).alias("y"))


def _spans(contours: DataFrame) -> DataFrame:
    """The spans of polygons, one frame a polygon."""
    return shapes.raster_spans(contours).select(F.col("poly_id").alias("video_id"), F.lit(0).cast("long").alias("frame_idx"), "y", "x0", "x1")


def centerlines(contours: DataFrame) -> DataFrame:
    """Centre line of each polygon, as an estimate: the way between the farthest points of its mask; poly_id, i, x, y.

    Polygons with a box of `boxes.CELLS` pixels at most are each a task's, many at once; larger ones go tile by tile.
    """
    return _ways(*pieces.split(_spans(contours), (F.col("n") > regions.WHOLE) | (F.col("area") > boxes.CELLS)))


def _ways(small: DataFrame, pixels: int, mask: DataFrame | None) -> DataFrame:
    """The longest ways in split spans."""
    path = boxes.longest_ways(small, pixels)
    if mask is not None:
        mask = cut(mask)
        seeds = mask.groupBy(*regions.FRAME).agg(F.min(F.struct("y", "x")).alias("p")).select(*regions.FRAME, "p.y", "p.x")
        path = path.unionByName(regions.farthest_path(mask, seeds))
    return path.select(F.col("video_id").alias("poly_id"), F.col("pos").alias("i"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def _depth_slopes(mask: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Slopes of the blurred distance to the background, pixel by pixel, for frames of any size."""
    depth = regions.background_distance(mask, size[1], size[0]).select(*regions.PIXEL, F.col("d").alias("v"))
    cells = mask.select(*regions.FRAME).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(size[1] - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(size[0] - 1))))
    potential = cells.join(depth, regions.PIXEL, "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    return shapes.gradients(potential, size[1], size[0], 1.0)


def optimised_centerlines(contours: DataFrame, size: tuple[int, int], spacing: float = 20.0, alpha: float = 1e3, beta: float = 1e6, gamma: float = 0.01, rounds: int = 1000) -> DataFrame:
    """Centre lines pulled to the middle: active contours in the distance to the background, both ends held; poly_id, i, x, y, converged.

    `spacing` is that of the points, before and after. `converged` is false for lines that have not come to rest after `rounds`. Pixels around the
    frame count as background.
    """
    contours, size = contours.withColumns({c: F.col(c) + 1 for c in "xy"}), (size[0] + 2, size[1] + 2)  # a rim of one pixel
    small, pixels, mask = pieces.split(_spans(contours), (F.col("n") > regions.WHOLE) | (F.col("area") > boxes.CELLS))
    opened = None
    if mask is None and size[0] * size[1] <= boxes.CELLS:
        slopes, opened = cut(boxes.packed(small, pixels, size[1], size[0])), boxes.depth_slopes(size[1], size[0], 1.0)
    else:
        slopes = cut(_depth_slopes(cut(polygon_mask(contours)), size))
    lines = cut(curves.spaced(cut(_ways(small, pixels, mask)).withColumnRenamed("poly_id", "curve_id"), spacing))
    ends = lines.groupBy("curve_id").agg(F.min("i").alias("a"), F.max("i").alias("b")).select("curve_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("i"), F.lit(True).alias("hold_x"), F.lit(True).alias("hold_y"))
    placed = lines.select("curve_id", F.col("curve_id").alias("video_id"), F.lit(0).cast("long").alias("frame_idx"), "i", "x", "y")
    found = cut(snakes.active_contours(placed, slopes, size, alpha, beta, gamma, anchors=ends, rounds=rounds, opened=opened).withColumns({c: F.col(c) - 1 for c in "xy"}))
    state = found.groupBy("curve_id").agg(F.first("converged").alias("converged"))
    return curves.spaced(found.select("curve_id", "i", "x", "y"), spacing).join(state, "curve_id").withColumnRenamed("curve_id", "poly_id")


def smooth_centerlines(contours: DataFrame, size: tuple[int, int], spacing: float = 10.0, sigma: float = 2.0, skip_length: float = 90.0, **settings) -> DataFrame:
    """Optimised centre lines, less `skip_length` at both ends, smoothed and carried on straight to where the old ends are nearest: poly_id, i, x, y, smoothed, converged.

    Lines of which fewer than four points are left stay as they are; `smoothed` is false for them. `settings` go to `optimised_centerlines`.
    """
    lines = cut(optimised_centerlines(contours, size, spacing, **settings).withColumnRenamed("poly_id", "curve_id"))
    skip = int(skip_length / spacing)
    kept = lines.join(lines.groupBy("curve_id").agg(F.count(F.lit(1)).alias("n")), "curve_id").withColumn("smoothed", F.col("n") - 2 * skip >= 4)
    inner = cut(curves.smooth(kept.where("smoothed").where((F.col("i") >= skip) & (F.col("i") < F.col("n") - skip)).select("curve_id", "i", "x", "y"), sigma))
    ends = curves.ends(lines).select("curve_id", *[F.col(c).alias(f"old_{c}") for c in ("x0", "y0", "x1", "y1")])
    point = F.struct("i", "x", "y")
    tips = inner.groupBy("curve_id").agg(F.sort_array(F.collect_list(point)).alias("p")).select("curve_id", F.slice("p", 1, 2).alias("first"), F.slice("p", -2, 2).alias("last")).join(ends, "curve_id")
    rays = []
    for own, before, x, y, sign in (("first", (0, 1), "old_x0", "old_y0", -1), ("last", (1, 0), "old_x1", "old_y1", 1)):
        tip, back = (F.get(own, n) for n in before)
        ux, uy = tip["x"] - back["x"], tip["y"] - back["y"]
        norm = F.sqrt(ux * ux + uy * uy)
        ray = tips.select("curve_id", tip["i"].alias("i"), tip["x"].alias("x"), tip["y"].alias("y"), (ux / norm).alias("ux"), (uy / norm).alias("uy"), F.col(x).alias("ex"), F.col(y).alias("ey")).where("ux is not null")
        ray = ray.withColumn("reach", (F.col("ex") - F.col("x")) * F.col("ux") + (F.col("ey") - F.col("y")) * F.col("uy")).where("reach > 1e-9")
        ray = ray.withColumn("k", F.explode(F.sequence(F.lit(1), F.ceil(F.col("reach") / spacing).cast("int")))).withColumn("t", F.least(F.col("k") * spacing, F.col("reach")))
        rays.append(ray.select("curve_id", (F.col("i") + sign * F.col("k")).alias("i"), (F.col("x") + F.col("t") * F.col("ux")).alias("x"), (F.col("y") + F.col("t") * F.col("uy")).alias("y")))
    whole = inner.unionByName(rays[0]).unionByName(rays[1]).withColumn("smoothed", F.lit(True)).unionByName(kept.where("not smoothed").select("curve_id", "i", "x", "y", "smoothed"))
    order = F.row_number().over(Window.partitionBy("curve_id").orderBy("i")) - 1
    return whole.withColumn("i", order).join(lines.select("curve_id", "converged").distinct(), "curve_id").withColumnRenamed("curve_id", "poly_id")
