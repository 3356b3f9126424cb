"""Composition of overlays: layers are relations of (keys, y, x, z, color) and later ones win. Pixel sets are defined by predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.iterate import cut
from framewright.operators.frames import every_nth, resize

PIXEL = ["video_id", "frame_idx", "y", "x"]
#: Candidate pixels of lines that a task looks at, and rows of pixels of a line that go together.
CELLS, BLOCK = 1 << 18, 256
#: Colour names as red, green, blue.
PALETTE = {"b": (0, 0, 255), "g": (0, 128, 0), "r": (255, 0, 0), "c": (0, 191, 191), "m": (191, 0, 191), "y": (191, 191, 0), "k": (0, 0, 0), "w": (255, 255, 255), "black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "lime": (0, 255, 0), "blue": (0, 0, 255)}


def color(name: Column, grey: bool = False) -> Column:
    """The palette's array of red, green, blue, or for grey targets their mean; null for unknown names."""
    table = F.create_map(*[z for n, rgb in PALETTE.items() for z in (F.lit(n), F.array(*map(F.lit, rgb)))])
    rgb = F.element_at(table, name)
    return F.floor((rgb[0] + rgb[1] + rgb[2]) / 3).cast("int") if grey else rgb


def to_color(pixels: DataFrame) -> DataFrame:
    """Grey to three equal channels."""
    return pixels.withColumn("c", F.explode(F.array(*map(F.lit, range(3)))))


def prepare(pixels: DataFrame, size: tuple[int, int], period: int, zoom: int) -> DataFrame:
    """Output frames: every `period`-th, smaller by `zoom`, in colour. Frames are dropped before any work is done on them."""
    small = resize(every_nth(pixels, period), size, (size[0] // zoom, size[1] // zoom), "area") if zoom > 1 else every_nth(pixels, period)
    return to_color(small.withColumn("v", F.floor(F.col("v") + 1e-9).cast("int")))


def highlight(pixels: DataFrame, mask: DataFrame, strength: int, channel: int | None = None) -> DataFrame:
    """Lifts masked pixels to strength..255: strength + (255 - strength) / 255 * v, cut; all channels or one."""
    marked = pixels.join(mask.select(*PIXEL).distinct().withColumn("m", F.lit(True)), PIXEL, "left")
    lifted = (F.lit(strength) + F.lit(255 - strength) * F.col("v") / 255).cast("int")
    chosen = F.col("m") if channel is None else F.col("m") & (F.col("c") == channel)
    return marked.withColumn("v", F.when(chosen, lifted).otherwise(F.col("v"))).drop("m")


def unmatched(pixels: DataFrame, image: DataFrame) -> DataFrame:
    """Keys of pixels that only one of two images has: none if their sizes are equal."""
    keys = [c for c in pixels.columns if c != "v"]
    return pixels.select(*keys).join(image, keys, "left_anti").unionByName(image.select(*keys).join(pixels, keys, "left_anti"))


def add(pixels: DataFrame, image: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Saturating sum with an image (same keys; pixels that it lacks stay), optionally within a mask."""
    both = pixels.join(image.withColumnRenamed("v", "w"), [c for c in pixels.columns if c != "v"], "left").withColumn("w", F.coalesce("w", F.lit(0)))
    if mask is not None:
        both = both.join(mask.select(*PIXEL).withColumn("m", F.lit(True)), PIXEL, "left").withColumn("w", F.when(F.col("m"), F.col("w")).otherwise(0)).drop("m")
    return both.withColumn("v", F.least(F.lit(255), F.col("v") + F.col("w"))).drop("w")


def blend(pixels: DataFrame, image: DataFrame, weight: float, mask: DataFrame | None = None) -> DataFrame:
    """(1 - weight) * v + weight * image, rounded half up; pixels that the image lacks stay."""
    both = pixels.join(image.withColumnRenamed("v", "w"), [c for c in pixels.columns if c != "v"], "left").withColumn("w", F.coalesce("w", "v"))
    mixed = F.floor((1 - weight) * F.col("v") + weight * F.col("w") + 0.5).cast("int")
    if mask is not None:
        both = both.join(mask.select(*PIXEL).withColumn("m", F.lit(True)), PIXEL, "left")
        return both.withColumn("v", F.when(F.col("m"), mixed).otherwise(F.col("v"))).drop("w", "m")
    return both.withColumn("v", mixed).drop("w")


def _cells(shapes: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """Candidate pixels of each shape's box."""
    spans = shapes.withColumns({"__x0": F.ceil(x0).cast("int"), "__x1": F.floor(x1).cast("int"), "__y0": F.ceil(y0).cast("int"), "__y1": F.floor(y1).cast("int")}).where("__x0 <= __x1 and __y0 <= __y1")
    return spans.withColumn("y", F.explode(F.sequence("__y0", "__y1"))).withColumn("x", F.explode(F.sequence("__x0", "__x1"))).drop("__x0", "__x1", "__y0", "__y1")


def rectangles(rects: DataFrame, thickness: int = 1) -> DataFrame:
    """Outline pixels of rectangles (rect_id, left, top, width, height), the rim inside."""
    right, bottom = F.col("left") + F.col("width") - 1, F.col("top") + F.col("height") - 1
    cells = _cells(rects, F.col("left"), F.col("top"), right, bottom)
    return cells.where((F.col("x") < F.col("left") + thickness) | (F.col("x") > right - thickness) | (F.col("y") < F.col("top") + thickness) | (F.col("y") > bottom - thickness)).select("rect_id", "y", "x")


def discs(points: DataFrame, radius: float, ring: float | None = None) -> DataFrame:
    """Pixels of discs, or rings of a width, around points (point_id, px, py); points that are not finite are skipped."""
    finite = points.where("px is not null and py is not null and not isnan(px) and not isnan(py) and abs(px) < 1e9 and abs(py) < 1e9")
    cells = _cells(finite, F.col("px") - radius, F.col("py") - radius, F.col("px") + radius, F.col("py") + radius)
    d2 = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
    return cells.where((d2 <= radius * radius) & (F.lit(True) if ring is None else d2 > (radius - ring) ** 2)).select("point_id", "y", "x")


def polylines(segments: DataFrame, width: float = 1.0) -> DataFrame:
    """Pixels within width / 2 of segments (line_id, x, y, x2, y2)."""
    return _drawn(segments.select("line_id", "x", "y", "x2", "y2", F.lit(width / 2).alias("half")))


def _drawn(segments: DataFrame) -> DataFrame:
    """Pixels within `half` of segments (line_id, x, y, x2, y2, half).

    Segments are dealt to tasks by line and block of `BLOCK` rows of pixels, about `CELLS` candidate pixels each, before pixels are made and
    repeated ones dropped: so what a task holds follows neither the size of the files nor, beyond a block, that of a line.
    """
    s = cut(segments.select("line_id", "half", *[F.col(a).alias(b) for a, b in (("x", "ax"), ("y", "ay"), ("x2", "bx"), ("y2", "by"))]))
    half = F.col("half")
    x0, x1, y0, y1 = (e.cast("int") for n in "xy" for e in (F.ceil(F.least(f"a{n}", f"b{n}") - half), F.floor(F.greatest(f"a{n}", f"b{n}") + half)))
    s = s.where((x0 <= x1) & (y0 <= y1))
    cells = s.agg(F.sum((x1 - x0 + 1.0) * (y1 - y0 + 1.0))).first()[0] or 0
    first, last = (F.floor(e / BLOCK).cast("int") for e in (y0, y1))
    dealt = s.withColumn("block", F.explode(F.sequence(first, last))).repartition(int(cells // CELLS) + 1, "line_id", "block")
    rows = dealt.withColumn("y", F.explode(F.sequence(F.greatest(y0, F.col("block") * BLOCK), F.least(y1, F.col("block") * BLOCK + (BLOCK - 1)))))
    pixels = rows.withColumn("x", F.explode(F.sequence(x0, x1)))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / square))).otherwise(0.0)
    near = F.pow(F.col("ax") + t * dx - F.col("x"), F.lit(2)) + F.pow(F.col("ay") + t * dy - F.col("y"), F.lit(2))
    return pixels.where(near <= half * half).select("line_id", "block", "y", "x").distinct().drop("block")


def track_lines(points: DataFrame, width: float = 1.0, closed: bool = True, marks: bool = False) -> DataFrame:
    """Pixels of polylines (line_id, i, x, y): broken at invalid points (x not above 0), each run closed unless `closed` is off; with
    `marks` a disc of radius 2 * width at every valid vertex."""
    from framewright.operators import curves

    valid = points.where("x > 0")
    runs = curves.runs(points.withColumnRenamed("line_id", "curve_id"), F.coalesce(F.col("x") > 0, F.lit(False))).withColumnRenamed("curve_id", "line_id")
    parts = valid.join(runs, "line_id").where("i >= first and i < stop")
    order = Window.partitionBy("line_id", "first").orderBy("i")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = {n: F.coalesce(F.lead(n).over(order), F.first(n).over(whole) if closed else F.lit(None).cast("double")) for n in "xy"}
    segments = parts.select("line_id", "x", "y", after["x"].alias("x2"), after["y"].alias("y2")).where("x2 is not null")
    segments = segments.withColumn("half", F.lit(width / 2))
    if marks:  # a disc is what lies within its radius of a segment without length
        finite = valid.where("y is not null and not isnan(x) and not isnan(y) and abs(x) < 1e9 and abs(y) < 1e9")
        segments = segments.unionByName(finite.select("line_id", "x", "y", F.col("x").alias("x2"), F.col("y").alias("y2"), F.lit(2.0 * width).alias("half")))
    return _drawn(segments)


def contour_lines(contours: DataFrame, width: float = 1.0) -> DataFrame:
    """Pixels of closed contours (poly_id, i, x, y)."""
    from framewright.operators import shapes

    return polylines(shapes.ring_edges(contours).withColumnRenamed("poly_id", "line_id"), width).withColumnRenamed("line_id", "poly_id")


def mask_contour(mask: DataFrame) -> DataFrame:
    """Outline pixels of masks: those with a four-neighbour outside."""
    from framewright.functions import kernels

    inner = kernels.spread(mask.select(*PIXEL), kernels.FOUR).groupBy(*PIXEL).agg(F.count(F.lit(1)).alias("n")).where("n = 4")
    return mask.select(*PIXEL).join(inner, PIXEL, "left_anti")


def layers(pixels: DataFrame, *drawn: DataFrame) -> DataFrame:
    """Draws layers (y, x, z, color, and video_id, frame_idx if not for all frames) over frames; the highest z wins."""
    out = pixels
    keyed = [d for d in drawn if "frame_idx" in d.columns]
    common = [d for d in drawn if "frame_idx" not in d.columns]
    for group, keys in ((keyed, PIXEL), (common, ["y", "x"])):
        if group:
            every = group[0].select(*keys, "z", "color")
            for d in group[1:]:
                every = every.unionByName(d.select(*keys, "z", "color"))
            top = every.groupBy(*keys).agg(F.max(F.struct("z", "color")).alias("top"))
            out = out.join(top, keys, "left")
            out = out.withColumn("__t", F.when(F.col("top").isNotNull(), F.col("top")) if "__t" not in out.columns else F.greatest("__t", "top")).drop("top")
    return out.withColumn("v", F.coalesce(F.col("__t.color"), "v")).drop("__t") if "__t" in out.columns else out
