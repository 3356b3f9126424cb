"""Frame-axis projections, filters and selections over long pixels: video_id, frame_idx, y, x[, c], v.

`videos` holds video_id, width, height, frame_count, one row a video; it is joined on video_id where bounds matter.
All are narrow projections and filters unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import kernels

Rect = tuple[float, float, float, float]


def map_values(pixels: DataFrame, function: Callable[[Column], Column]) -> DataFrame:
    """A Column function of every value."""
    return pixels.withColumn("v", function(F.col("v")))


def normalize(pixels: DataFrame, low: float | None = None, high: float | None = None, to: tuple[float, float] = (0, 255)) -> DataFrame:
    """Clips to [low, high] and maps to `to`, cut toward zero; missing bounds are those of each video's first frame."""
    first = pixels.where("frame_idx = 0").groupBy("video_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    known = pixels.join(first, "video_id", "left").withColumns({"lo": F.coalesce(F.lit(low), "lo").cast("double"), "hi": F.coalesce(F.lit(high), "hi").cast("double")})
    share = F.when(F.col("hi") > F.col("lo"), (F.least(F.greatest(F.col("v").cast("double"), "lo"), "hi") - F.col("lo")) * (to[1] - to[0]) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return known.withColumn("v", (share + to[0]).cast("int")).drop("lo", "hi")


def resolve(value: float | Column, size: Column) -> Column:
    """A coordinate: within (-1, 1) a share of the size, negative from the far end; one out of range fails the job."""
    if isinstance(value, float) and -1 < value < 1 and value != 0:
        value = (F.lit(value) * size).cast("int")
    else:
        value = F.lit(int(value)) if isinstance(value, (int, float)) else value
    value = F.when(value < 0, value + size).otherwise(value)
    return F.when((value >= 0) & (value <= size), value).otherwise(F.raise_error(F.lit("coordinate out of range")).cast("int"))


def crop(pixels: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    """Pixels of a rectangle, moved to its corner."""
    inside = pixels.where(F.col("x").between(left, left + width - 1) & F.col("y").between(top, top + height - 1))
    return inside.withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


def crop_by(pixels: DataFrame, videos: DataFrame, rect: Rect, align: int = 1) -> DataFrame:
    """Crop by shares or coordinates of each video's size; width and height are rounded to multiples of `align`."""
    bounds = videos.select("video_id", resolve(rect[0], F.col("width")).alias("l"), resolve(rect[1], F.col("height")).alias("t"), aligned(resolve(rect[2], F.col("width")), align).alias("w"), aligned(resolve(rect[3], F.col("height")), align).alias("h"))
    inside = pixels.join(bounds, "video_id").where("x >= l and x < l + w and y >= t and y < t + h")
    return inside.withColumns({"x": F.col("x") - F.col("l"), "y": F.col("y") - F.col("t")}).drop("l", "t", "w", "h")


def aligned(size: Column, align: int) -> Column:
    """The nearest multiple of `align`."""
    return F.round(size / align).cast("int") * align


def crop_region(pixels: DataFrame, videos: DataFrame, region: str) -> DataFrame:
    """Crop to a named half or quadrant; left beats right, upper beats lower."""
    w2, h2 = F.floor(F.col("width") / 2).cast("int"), F.floor(F.col("height") / 2).cast("int")
    left = F.lit(0) if "left" in region or "right" not in region else w2
    width = w2 if "left" in region else F.col("width") - w2 if "right" in region else F.col("width")
    top = F.lit(0) if "upper" in region or "lower" not in region else h2
    height = h2 if "upper" in region else F.col("height") - h2 if "lower" in region else F.col("height")
    bounds = videos.select("video_id", left.alias("l"), top.alias("t"), width.alias("w"), height.alias("h"))
    inside = pixels.join(bounds, "video_id").where("x >= l and x < l + w and y >= t and y < t + h")
    return inside.withColumns({"x": F.col("x") - F.col("l"), "y": F.col("y") - F.col("t")}).drop("l", "t", "w", "h")


def channel(pixels: DataFrame, number: int) -> DataFrame:
    return pixels.where(F.col("c") == number).drop("c")


def grey(pixels: DataFrame) -> DataFrame:
    """Mean of the channels, cut to an integer (one shuffle)."""
    return pixels.groupBy("video_id", "frame_idx", "y", "x").agg(F.floor(F.avg("v")).cast("int").alias("v"))


def rotate(pixels: DataFrame, videos: DataFrame, angle: int) -> DataFrame:
    """Counter-clockwise by a multiple of 90 degrees."""
    if angle % 90:
        raise ValueError("the angle must be a multiple of 90")
    sizes = pixels.join(videos.select("video_id", "width", "height"), "video_id")
    y, x, right, bottom = F.col("y"), F.col("x"), F.col("width") - 1, F.col("height") - 1
    ny, nx = {0: (y, x), 90: (right - x, y), 180: (bottom - y, right - x), 270: (x, bottom - y)}[angle % 360]
    return sizes.withColumns({"y": ny, "x": nx}).drop("width", "height")


def resize(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int], method: str = "auto") -> DataFrame:
    """From `size` to `to` (width, height); auto: area when shrinking, cubic otherwise. Two passes, one shuffle."""
    if method == "auto":
        method = "area" if to[0] * to[1] < size[0] * size[1] else "cubic"
    return kernels.separable(pixels, kernels.resampling(size[1], to[1], method), kernels.resampling(size[0], to[0], method))


def blur(pixels: DataFrame, size: tuple[int, int], sigma: float = 3.0) -> DataFrame:
    """Gaussian blur, cut at three deviations, mirrored at the border."""
    w = kernels.gaussian(sigma)
    return kernels.separable(pixels, kernels.convolution(w, size[1]), kernels.convolution(w, size[0]))


def replicate(pixels: DataFrame, videos: DataFrame, count: int) -> DataFrame:
    """The video `count` times in a row."""
    sizes = videos.select("video_id", "frame_count")
    times = pixels.join(sizes, "video_id").withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return times.withColumn("frame_idx", F.col("frame_idx") + F.col("__k") * F.col("frame_count")).drop("frame_count", "__k")


def drop_frames(pixels: DataFrame, videos: DataFrame, compression: float) -> DataFrame:
    """Time compression: frame i of the result is frame floor(i * compression); below 1 frames repeat."""
    n = F.floor((F.col("frame_count") - 1) / compression)
    wanted = videos.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("new"))
    wanted = wanted.withColumn("frame_idx", F.floor(F.col("new") * F.lit(float(compression))))
    return pixels.join(wanted, ["video_id", "frame_idx"]).withColumn("frame_idx", F.col("new")).drop("new")


def cut(pixels: DataFrame, videos: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """A slice as of a Python sequence; a negative step reverses."""
    n = F.col("frame_count")

    def bound(value: int | None, missing: Column, low: int, high: Column) -> Column:
        if value is None:
            return missing
        value = F.lit(value) if value >= 0 else n + value
        return F.least(F.greatest(value, F.lit(low)), high)

    first = bound(start, F.lit(0) if step > 0 else n - 1, 0 if step > 0 else -1, n if step > 0 else n - 1)
    last = bound(stop, n if step > 0 else F.lit(-1), 0 if step > 0 else -1, n if step > 0 else n - 1)
    bounds = videos.select("video_id", first.cast("long").alias("__a"), last.cast("long").alias("__z"))
    a, z, i = F.col("__a"), F.col("__z"), F.col("frame_idx")
    within = (i >= a) & (i < z) if step > 0 else (i <= a) & (i > z)
    rows = pixels.join(bounds, "video_id").where(within & ((i - a) % step == 0))
    return rows.withColumn("frame_idx", ((i - a) / step).cast("long")).drop("__a", "__z")


def get_frames(pixels: DataFrame, videos: DataFrame, wanted: DataFrame) -> DataFrame:
    """Frames by index, `wanted` has `idx`; negative ones count from the end; missing frames give no rows.

    Every pixel has two names, the frame's number from the start and from the end; one equi-join on them finds what is wanted.
    """
    named = pixels.join(videos.select("video_id", "frame_count"), "video_id")
    named = named.withColumn("idx", F.explode(F.array(F.col("frame_idx"), F.col("frame_idx") - F.col("frame_count")))).drop("frame_count")
    return named.join(wanted.select(F.col("idx").cast("long").alias("idx")), "idx")


def missing_frames(videos: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted indices that are out of range, by video. Videos of one length lack the same frames, so lengths are looked up first.

    An index is out of range for the lengths up to a bound (idx, or -idx - 1); each length meets the indices beyond it only.
    """
    lengths = videos.select(F.col("frame_count").alias("length")).distinct()
    reach = F.when(F.col("idx") < 0, -F.col("idx") - 1).otherwise(F.col("idx"))
    asked = wanted.select("idx", reach.alias("reach"))
    lacking = lengths.join(asked, F.col("reach") >= F.col("length"))
    return videos.select("video_id", F.col("frame_count").alias("length")).join(lacking, "length").select("video_id", "idx")


def every_nth(pixels: DataFrame, period: int) -> DataFrame:
    return pixels.where(F.col("frame_idx") % period == 0)


def border(pixels: DataFrame, videos: DataFrame, size: int, color: int) -> DataFrame:
    """Paints the rim."""
    sized = pixels.join(videos.select("video_id", "width", "height"), "video_id")
    rim = (F.col("x") < size) | (F.col("y") < size) | (F.col("x") >= F.col("width") - size) | (F.col("y") >= F.col("height") - size)
    return sized.withColumn("v", F.when(rim, color).otherwise(F.col("v"))).drop("width", "height")


def class_to_grey(pixels: DataFrame) -> DataFrame:
    """Class labels 0..3 to grey levels 63, 126, 189, 252."""
    return pixels.withColumn("v", (F.col("v") + 1) * 63)


def named_columns(pixels: DataFrame, functions: dict[str, Callable[[Column], Column]], preprocess: Callable[[Column], Column] | None = None) -> DataFrame:
    """Columns derived from each value beside `raw`, after a shared step."""
    if "raw" in functions:
        raise ValueError("the name raw is reserved")
    value = preprocess(F.col("v")) if preprocess else F.col("v")
    keys = [c for c in pixels.columns if c != "v"]
    return pixels.select(*keys, value.alias("raw")).select(*keys, "raw", *[f(F.col("raw")).alias(name) for name, f in functions.items()])


def zip_branches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two branches of one source, frame by frame: v1, v2."""
    keys = [c for c in left.columns if c != "v"]
    return left.withColumnRenamed("v", "v1").join(right.withColumnRenamed("v", "v2"), keys)


def out_of_step(left: DataFrame, right: DataFrame) -> DataFrame:
    """Frames that only one of two branches has."""
    a, b = (d.select("video_id", "frame_idx").distinct().withColumn(n, F.lit(1)) for d, n in ((left, "l"), (right, "r")))
    return a.join(b, ["video_id", "frame_idx"], "full_outer").where("l is null or r is null").select("video_id", "frame_idx")


def observed(pixels: DataFrame, name: str, *metrics: Column) -> DataFrame:
    """Passes frames on; the named metrics are delivered to query listeners when the job ends."""
    return pixels.observe(name, *metrics)
