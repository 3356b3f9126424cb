"""Operators between consecutive frames and reductions over time. A pixel's history is one key, so videos scale out by pixel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import kernels


def _keys(pixels: DataFrame) -> list[str]:
    return [c for c in pixels.columns if c not in ("frame_idx", "v")]


def compare(pixels: DataFrame, function: Callable[[Column, Column], Column]) -> DataFrame:
    """function(this, previous) of consecutive frames; the result has one frame less, named by the earlier one."""
    keys = _keys(pixels)
    following = F.lead("v").over(Window.partitionBy(*keys).orderBy("frame_idx"))
    return pixels.withColumn("__n", following).where("__n is not null").select(*keys, "frame_idx", function(F.col("__n"), F.col("v")).alias("v"))


def difference(pixels: DataFrame) -> DataFrame:
    """Signed difference of consecutive frames."""
    return compare(pixels, lambda this, previous: this.cast("int") - previous.cast("int"))


def packed_difference(frames: DataFrame) -> DataFrame:
    """The same on packed frames: one row a frame stays one row."""
    following = F.lead("data").over(Window.partitionBy("video_id").orderBy("frame_idx"))
    return frames.withColumn("__n", following).where("__n is not null").select("video_id", "frame_idx", F.zip_with("__n", "data", lambda a, b: a - b).alias("data"))


def motion(pixels: DataFrame, height: int, width: int, radius: int = 1) -> DataFrame:
    """Motion magnitude between frames by Lucas-Kanade over a box; null where the box's gradients are singular.

    This is a local least-squares solution, not a dense polynomial-expansion solver; magnitudes differ from such solvers.
    """
    central = [-0.5, 0.0, 0.5]
    pixels = kernels.by_frame(pixels)
    across = kernels.apply_axis(pixels, "x", kernels.convolution(central, width)).withColumnRenamed("v", "ix")
    down = kernels.apply_axis(pixels, "y", kernels.convolution(central, height)).withColumnRenamed("v", "iy")
    keys = ["video_id", "frame_idx", "y", "x"]
    g = kernels.by_frame(difference(pixels)).withColumnRenamed("v", "it").join(across, keys).join(down, keys)
    products = g.select(*keys, *[(F.col(a) * F.col(b)).alias(n) for n, a, b in (("xx", "ix", "ix"), ("yy", "iy", "iy"), ("xy", "ix", "iy"), ("xt", "ix", "it"), ("yt", "iy", "it"))])
    sums = kernels.spread(products, kernels.box(radius)).where(kernels.inside(height, width)).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in ("xx", "yy", "xy", "xt", "yt")])
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    u, w = (F.col("xy") * F.col("yt") - F.col("yy") * F.col("xt")) / F.col("det"), (F.col("xy") * F.col("xt") - F.col("xx") * F.col("yt")) / F.col("det")
    return sums.withColumn("det", det).select(*keys, F.when(F.abs("det") > 1e-9, F.sqrt(u * u + w * w)).alias("v"))


def fold(pixels: DataFrame, function: Callable[[Column, Column], Column], initial: Column | None = None) -> DataFrame:
    """Ordered fold function(frame, accumulator) over time for each pixel; without an initial value the first frame is it.

    For commutative folds use reduce_time, which combines partially before the shuffle.
    """
    keys = _keys(pixels)
    series = F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "v"))), lambda s: s["v"].cast("double"))
    rows = pixels.groupBy(*keys).agg(series.alias("s"))
    start = F.get("s", 0) if initial is None else initial.cast("double")
    rest = F.slice("s", 2, F.size("s")) if initial is None else F.col("s")
    return rows.select(*keys, F.aggregate(rest, start, lambda acc, v: function(v, acc)).alias("v"))


def reduce_time(pixels: DataFrame, name: str) -> DataFrame:
    """max, min, sum or bit_or over time for each pixel."""
    return pixels.groupBy(*_keys(pixels)).agg(getattr(F, name)("v").alias("v"))


def mean(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(*_keys(pixels)).agg(F.avg("v").alias("mean"))


def mean_std(pixels: DataFrame) -> DataFrame:
    """Mean and sample deviation over time for each pixel."""
    return pixels.groupBy(*_keys(pixels)).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))


def value_range(pixels: DataFrame) -> DataFrame:
    """Least and largest value of each video."""
    return pixels.groupBy("video_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
