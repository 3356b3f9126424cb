"""Set-level operators on many curves at once: points(curve_id, i, x, y), one row a vertex, in the order of i.

Windows and groupings are by curve; nothing is collected across curves.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.iterate import cut


def _curve() -> Window:
    """A curve's vertices in order."""
    return Window.partitionBy("curve_id").orderBy("i")


def _next(name: str) -> Column:
    return F.lead(name).over(_curve())


def segments(points: DataFrame) -> DataFrame:
    """curve_id, i, x, y, x2, y2, length of every segment."""
    s = points.select("curve_id", "i", "x", "y", _next("x").alias("x2"), _next("y").alias("y2")).where("x2 is not null")
    return s.withColumn("length", F.sqrt((F.col("x2") - F.col("x")) * (F.col("x2") - F.col("x")) + (F.col("y2") - F.col("y")) * (F.col("y2") - F.col("y"))))


def lengths(points: DataFrame) -> DataFrame:
    """Arc length of each curve; 0 below two points."""
    step = F.sqrt(F.pow(_next("x") - F.col("x"), F.lit(2)) + F.pow(_next("y") - F.col("y"), F.lit(2)))
    return points.select("curve_id", step.alias("d")).groupBy("curve_id").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("length"))


def turning_angles(points: DataFrame) -> DataFrame:
    """Turning angle at inner vertices: 0 is straight; null at a segment of length 0."""
    p = points.select("curve_id", "i", "x", "y", F.lag("x").over(_curve()).alias("px"), F.lag("y").over(_curve()).alias("py"), _next("x").alias("nx"), _next("y").alias("ny")).where("px is not null and nx is not null")
    ax, ay, bx, by = F.col("x") - F.col("px"), F.col("y") - F.col("py"), F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    norm = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    return p.select("curve_id", "i", F.when(norm > 0, F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (ax * bx + ay * by) / norm)))).alias("angle"))


def translate(points: DataFrame, offsets: DataFrame, key: str = "curve_id") -> DataFrame:
    """Shifts (and scales by `s`, if given) each group by its row of `offsets`: key, dx, dy[, s]."""
    rest = [c for c in points.columns if c not in ("x", "y")]
    scale = F.col("s") if "s" in offsets.columns else F.lit(1.0)
    return points.join(offsets, key).select(*rest, (F.col("x") * scale + F.col("dx")).alias("x"), (F.col("y") * scale + F.col("dy")).alias("y"))


def ends(points: DataFrame) -> DataFrame:
    """First and last point of each curve: curve_id, n, x0, y0, x1, y1."""
    p = F.struct("i", "x", "y")
    e = points.groupBy("curve_id").agg(F.count(F.lit(1)).alias("n"), F.min(p).alias("a"), F.max(p).alias("z"))
    return e.select("curve_id", "n", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("z.x").alias("x1"), F.col("z.y").alias("y1"))


def merge_pairs(points: DataFrame, pairs: DataFrame, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """Joins curves c1, c2 of each row of `pairs` (pair_id, c1, c2) end to end, both copies of the joint kept; and the pairs that do not touch.

    The orientations are tried in a fixed order: c1 end - c2 start, c1 start - c2 start (c1 turned), c1 start - c2 end (both turned), c1 end - c2 end (c2 turned).
    """
    e = ends(points)
    a, b = (e.select(*[F.col(c).alias(f"{p}{c}") for c in e.columns]) for p in "ab")
    known = pairs.join(a, pairs["c1"] == F.col("acurve_id")).join(b, pairs["c2"] == F.col("bcurve_id"))

    def touch(p: str, q: str) -> Column:
        return (F.abs(F.col(f"ax{p}") - F.col(f"bx{q}")) <= tolerance) & (F.abs(F.col(f"ay{p}") - F.col(f"by{q}")) <= tolerance)

    how = F.when(touch("1", "0"), 0).when(touch("0", "0"), 1).when(touch("0", "1"), 2).when(touch("1", "1"), 3)
    known = known.select("pair_id", "c1", "c2", how.alias("how"), F.col("an").alias("n1"), F.col("bn").alias("n2"))
    fit = known.where("how is not null")
    at1 = F.when(F.col("how").isin(1, 2), F.col("n1") - 1 - F.col("i")).otherwise(F.col("i"))
    at2 = F.col("n1") + F.when(F.col("how").isin(2, 3), F.col("n2") - 1 - F.col("i")).otherwise(F.col("i"))
    one = fit.join(points, fit["c1"] == points["curve_id"]).select("pair_id", at1.alias("i"), "x", "y")
    two = fit.join(points, fit["c2"] == points["curve_id"]).select("pair_id", at2.alias("i"), "x", "y")
    return one.unionByName(two), known.where("how is null").select("pair_id", "c1", "c2")


def measured(points: DataFrame) -> DataFrame:
    """Segments with their start `s` along the curve and the curve's `total`."""
    seg = segments(points)
    return seg.withColumns({"s": F.coalesce(F.sum("length").over(_curve().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "total": F.sum("length").over(Window.partitionBy("curve_id")), "last": F.max("i").over(Window.partitionBy("curve_id"))})


def _sample(seg: DataFrame, spacing: Column, count: Column) -> DataFrame:
    """Points at k * spacing, k < count, on measured segments: each segment yields the k that fall on it."""
    eps = 1e-9
    low = F.ceil(F.col("s") / F.col("h") - eps)
    high = F.when(F.col("i") == F.col("last"), F.col("count") - 1).otherwise(F.ceil((F.col("s") + F.col("length")) / F.col("h") - eps) - 1)
    spans = seg.withColumns({"h": spacing, "count": count}).withColumns({"k0": F.greatest(low, F.lit(0)), "k1": F.least(high, F.col("count") - 1)}).where("k1 >= k0")
    rows = spans.withColumn("k", F.explode(F.sequence(F.col("k0").cast("long"), F.col("k1").cast("long"))))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("k") * F.col("h") - F.col("s")) / F.col("length")))
    return rows.select("curve_id", F.col("k").cast("int").alias("i"), (F.col("x") + t * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y2") - F.col("y"))).alias("y"))


def equidistant(points: DataFrame, count: int) -> DataFrame:
    """`count` points at equal arc length."""
    seg = measured(points).where("length > 0")
    seg = seg.withColumn("last", F.max("i").over(Window.partitionBy("curve_id")))
    return _sample(seg, F.col("total") / (count - 1), F.lit(count))


def evenly(points: DataFrame) -> DataFrame:
    """As many points as each curve has, at equal arc length."""
    seg = measured(points).where("length > 0")
    seg = seg.withColumn("last", F.max("i").over(Window.partitionBy("curve_id"))).join(points.groupBy("curve_id").agg(F.count(F.lit(1)).alias("points")), "curve_id")
    return _sample(seg, F.col("total") / (F.col("points") - 1), F.col("points").cast("int"))


def spaced(points: DataFrame, spacing: float) -> DataFrame:
    """Points about `spacing` apart: the length over the nearest whole number of steps; shorter curves stay as they are."""
    seg = measured(points).where("length > 0")
    seg = seg.withColumn("last", F.max("i").over(Window.partitionBy("curve_id")))
    steps = F.round(F.col("total") / spacing)
    long = _sample(seg.where(F.col("total") >= spacing), F.col("total") / steps, (steps + 1).cast("int"))
    short = lengths(points).where(F.col("length") < spacing).select("curve_id")
    return long.unionByName(points.join(short, "curve_id").select("curve_id", F.col("i").cast("int").alias("i"), "x", "y"))


def projection(seg: DataFrame, queries: DataFrame, key: str = "curve_id") -> DataFrame:
    """Closest point of each polyline to each query (query_id, key, qx, qy): px, py, dist.

    A query first meets the boxes of runs of `RUN` segments of its polyline, then the segments of the boxes that can hold the closest point: some segment
    touches every side of its box, which bounds the distance to it.
    """
    run = F.floor(F.col("i") / RUN)
    sides = [F.min(F.least("x", "x2")).alias("x0"), F.min(F.least("y", "y2")).alias("y0"), F.max(F.greatest("x", "x2")).alias("x1"), F.max(F.greatest("y", "y2")).alias("y1")]
    boxes = seg.groupBy(key, run.alias("run")).agg(*sides)
    gap = [F.greatest(F.col(l) - F.col(q), F.col(q) - F.col(h), F.lit(0.0)) for q, l, h in (("qx", "x0", "x1"), ("qy", "y0", "y1"))]
    near, far = ([f(F.abs(F.col(q) - F.col(l)), F.abs(F.col(q) - F.col(h))) for q, l, h in (("qx", "x0", "x1"), ("qy", "y0", "y1"))] for f in (F.least, F.greatest))
    touched = F.sqrt(F.least(near[0] * near[0] + far[1] * far[1], far[0] * far[0] + near[1] * near[1]))
    open_ = boxes.join(queries, key).withColumn("low", F.sqrt(gap[0] * gap[0] + gap[1] * gap[1])).withColumn("r", F.min(touched).over(Window.partitionBy("query_id", key)))
    asked = open_.where(F.col("low") <= F.col("r") + 1e-8).select("query_id", key, "run", "qx", "qy")
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("qx") - F.col("x")) * dx + (F.col("qy") - F.col("y")) * dy) / square))).otherwise(0.0)
    near = seg.withColumn("run", run).join(asked, [key, "run"]).withColumn("t", t).withColumns({"px": F.col("x") + F.col("t") * dx, "py": F.col("y") + F.col("t") * dy})
    near = near.withColumn("dist", F.sqrt((F.col("px") - F.col("qx")) * (F.col("px") - F.col("qx")) + (F.col("py") - F.col("qy")) * (F.col("py") - F.col("qy"))))
    return near.groupBy("query_id", key).agg(F.min(F.struct(F.round("dist", 9).alias("d"), "i", "px", "py")).alias("m")).select("query_id", key, F.col("m.px").alias("px"), F.col("m.py").alias("py"), F.col("m.d").alias("dist"))


def smooth(points: DataFrame, sigma: float, derivative: bool = False, count: int | None = None) -> DataFrame:
    """Gaussian moving average over the vertices, weights renewed at the ends; optionally its central differences, and of `count` points at
    equal arc length instead of the vertices.

    A windowed filter, not a smoothing spline: values differ from a spline fit.
    """
    if count is not None:
        points = equidistant(points, count)
    reach = math.ceil(3 * sigma)
    weights = {k: math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)}

    def average(name: str) -> Column:
        shifted = {k: F.lead(name, k).over(_curve()) if k >= 0 else F.lag(name, -k).over(_curve()) for k in weights}
        total = sum((F.coalesce(v * weights[k], F.lit(0.0)) for k, v in shifted.items()), F.lit(0.0))
        return total / sum((F.when(v.isNotNull(), weights[k]).otherwise(0.0) for k, v in shifted.items()), F.lit(0.0))

    out = points.select("curve_id", "i", average("x").alias("x"), average("y").alias("y"))
    if not derivative:
        return out
    central = {n: (F.coalesce(F.lead(n).over(_curve()), F.col(n)) - F.coalesce(F.lag(n).over(_curve()), F.col(n))) / (F.when(F.lead(n).over(_curve()).isNull(), 0).otherwise(1) + F.when(F.lag(n).over(_curve()).isNull(), 0).otherwise(1)) for n in "xy"}
    return out.select("curve_id", "i", *[e.alias(n) for n, e in central.items()])


def steepest(profiles: DataFrame, direction: int = 1) -> DataFrame:
    """Position of the steepest step of y in a direction: index + 0.5, the first if tied; null below two points."""
    step = direction * (F.lead("y").over(_curve()) - F.col("y"))
    rows = profiles.select("curve_id", "i", step.alias("d"))
    best = rows.groupBy("curve_id").agg(F.max(F.when(F.col("d").isNotNull(), F.struct("d", (-F.col("i")).alias("j")))).alias("m"))
    return best.select("curve_id", (-F.col("m.j") + 0.5).alias("pos"))


def runs(points: DataFrame, valid: Column) -> DataFrame:
    """Runs of consecutive valid points: curve_id, first, stop (one past the last)."""
    good = points.where(valid)
    island = F.col("i") - F.row_number().over(_curve())
    return good.select("curve_id", "i", island.alias("g")).groupBy("curve_id", "g").agg(F.min("i").alias("first"), (F.max("i") + 1).alias("stop")).drop("g")


def mean_profile(profiles: DataFrame, grid: int | None = None) -> DataFrame:
    """Mean of functions on [0, 1], each interpolated at a common grid as fine as the longest profile."""
    size = profiles.groupBy("curve_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("grid"))
    seg = segments(profiles).select("curve_id", "x", "y", "x2", "y2", (F.col("i") == F.max("i").over(Window.partitionBy("curve_id"))).alias("final"))
    if grid is not None:
        seg = seg.withColumn("grid", F.lit(grid))
    else:
        seg = seg.join(F.broadcast(size))  # one row
    step = F.col("grid") - 1
    k0, k1 = F.ceil(F.col("x") * step - 1e-9), F.when(F.col("final"), step).otherwise(F.ceil(F.col("x2") * step - 1e-9) - 1)
    rows = seg.withColumns({"k0": k0, "k1": k1}).where("k1 >= k0 and x2 > x").withColumn("k", F.explode(F.sequence(F.col("k0").cast("int"), F.col("k1").cast("int"))))
    value = F.col("y") + (F.col("k") / step - F.col("x")) / (F.col("x2") - F.col("x")) * (F.col("y2") - F.col("y"))
    return rows.select("k", (F.col("k") / step).alias("x"), value.alias("y")).groupBy("k", "x").agg(F.avg("y").alias("y"))


#: Segments of a run.
RUN = 64
#: Points of an interval that is simplified inside a task.
LOCAL = 1 << 18


def _farthest(x: np.ndarray, y: np.ndarray) -> tuple[float, int]:
    """The distance and the place of the point farthest from the line through the ends, the first if tied."""
    dx, dy = x[-1] - x[0], y[-1] - y[0]
    norm = math.sqrt(dx * dx + dy * dy)
    away = np.abs(dx * (y[0] - y[1:-1]) - (x[0] - x[1:-1]) * dy) / norm if norm > 0 else np.sqrt((x[1:-1] - x[0]) ** 2 + (y[1:-1] - y[0]) ** 2)
    return float(away.max()), int(away.argmax()) + 1


def _simplify_interval(epsilon: float):
    """The inner points of one interval (its ends among the rows) that stay."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        x, y, stays, open_ = rows["x"].to_numpy(), rows["y"].to_numpy(), [], [(0, len(rows) - 1)]
        while open_:
            a, b = open_.pop()
            if b - a > 1:
                away, place = _farthest(x[a : b + 1], y[a : b + 1])
                if away > epsilon:
                    stays.append(a + place)
                    open_ += [(a, a + place), (a + place, b)]
        return rows.iloc[sorted(stays)][["curve_id", "i"]]

    return run


def simplify(points: DataFrame, epsilon: float) -> DataFrame:
    """Ramer-Douglas-Peucker: the vertices that stay.

    Every inner point carries its open interval (a, b), so a round is one aggregate by interval and one join with the splits: each point moves to a
    half. Intervals of `LOCAL` points at most leave the rounds and are finished inside a task; points of intervals that need no split are dropped. Ties
    go to the first point.
    """
    ends = points.groupBy("curve_id").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.count(F.lit(1)).alias("n"))
    done = cut(ends.select("curve_id", F.explode(F.array("a", "b")).alias("i")).distinct())
    placed = points.select("curve_id", F.col("i"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    now = cut(placed.join(ends, "curve_id").select("curve_id", "i", "x", "y", "a", "b", "n"))
    small, at = [], {e: placed.select("curve_id", F.col("i").alias(e), F.col("x").alias(f"x{e}"), F.col("y").alias(f"y{e}")) for e in "ab"}
    while True:
        small.append(now.where(F.col("n") <= LOCAL).drop("n"))
        now = now.where(F.col("n") > LOCAL)
        spans = now.select("curve_id", "a", "b").distinct().join(at["a"], ["curve_id", "a"]).join(at["b"], ["curve_id", "b"])
        if not now.take(1):
            break
        inner = now.where("i > a and i < b").join(spans, ["curve_id", "a", "b"])
        dx, dy = F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")
        norm = F.sqrt(dx * dx + dy * dy)
        line = F.abs(dx * (F.col("ya") - F.col("y")) - (F.col("xa") - F.col("x")) * dy) / norm
        away = F.when(norm > 0, line).otherwise(F.sqrt(F.pow(F.col("x") - F.col("xa"), F.lit(2)) + F.pow(F.col("y") - F.col("ya"), F.lit(2))))
        far = inner.groupBy("curve_id", "a", "b").agg(F.max(F.struct(away.alias("d"), (-F.col("i")).alias("j"))).alias("m")).where(F.col("m.d") > epsilon)
        split = cut(far.select("curve_id", "a", "b", (-F.col("m.j")).alias("k")))
        done = done.unionByName(split.select("curve_id", F.col("k").alias("i")))
        halves = F.array(F.when(F.col("i") <= F.col("k"), F.struct(F.col("a").alias("a"), F.col("k").alias("b"))), F.when(F.col("i") >= F.col("k"), F.struct(F.col("k").alias("a"), F.col("b").alias("b"))))
        moved = now.drop("n").join(split, ["curve_id", "a", "b"]).withColumn("half", F.explode(F.filter(halves, lambda h: h.isNotNull()))).select("curve_id", "i", "x", "y", "half.a", "half.b")
        sizes = moved.groupBy("curve_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))
        now = cut(moved.join(sizes, ["curve_id", "a", "b"]).where("n > 2").select("curve_id", "i", "x", "y", "a", "b", "n"))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.select("curve_id", "i").schema)
    rows = small[0]
    for more in small[1:]:
        rows = rows.unionByName(more)
    done = done.unionByName(rows.where("b > a").groupBy("curve_id", "a", "b").applyInPandas(_simplify_interval(epsilon), kind))
    return points.join(done.distinct(), ["curve_id", "i"])


def circle_fit(points: DataFrame, key: str = "curve_id") -> DataFrame:
    """Least-squares circle (Kasa) of each point set: cx, cy, r; null for collinear points. Sums are taken about the group's mean."""
    mean = points.groupBy(key).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    p = points.join(mean, key).select(key, "mx", "my", (F.col("x") - F.col("mx")).alias("u"), (F.col("y") - F.col("my")).alias("v"))
    u, v = F.col("u"), F.col("v")
    s = p.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"), F.sum(u * u).alias("uu"), F.sum(v * v).alias("vv"), F.sum(u * v).alias("uv"), F.sum(u * (u * u + v * v)).alias("uz"), F.sum(v * (u * u + v * v)).alias("vz"))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    a, b = (F.col("uz") * F.col("vv") - F.col("vz") * F.col("uv")) / (2 * F.col("det")), (F.col("vz") * F.col("uu") - F.col("uz") * F.col("uv")) / (2 * F.col("det"))
    s = s.withColumn("det", det).where("abs(det) > 1e-9").withColumns({"a": a, "b": b})
    return s.select(key, (F.col("a") + F.col("mx")).alias("cx"), (F.col("b") + F.col("my")).alias("cy"), F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + (F.col("uu") + F.col("vv")) / F.col("n")).alias("r"))


def sample_bilinear(pixels: DataFrame, points: DataFrame, key: str = "point_id") -> DataFrame:
    """Image value at sub-pixel points (key, video_id, frame_idx, px, py): four weighted taps joined to the pixels."""
    x0, y0 = F.floor("px"), F.floor("py")
    fx, fy = F.col("px") - x0, F.col("py") - y0
    taps = F.array(*[F.struct((y0 + j).cast("int").alias("y"), (x0 + i).cast("int").alias("x"), ((fy if j else 1 - fy) * (fx if i else 1 - fx)).alias("w")) for j in (0, 1) for i in (0, 1)])
    rows = points.select(key, "video_id", "frame_idx", F.explode(taps).alias("t")).where("t.w > 0").select(key, "video_id", "frame_idx", "t.*")
    return rows.join(pixels, ["video_id", "frame_idx", "y", "x"]).groupBy(key, "video_id", "frame_idx").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def line_scan(pixels: DataFrame, scans: DataFrame, half_width: int) -> DataFrame:
    """Mean intensity along strips: scans (scan_id, video_id, frame_idx, x1, y1, x2, y2), one value for each whole step `pos`."""
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), F.lit(2)) + F.pow(F.col("y2") - F.col("y1"), F.lit(2)))
    grid = scans.withColumn("len", length).where("len > 0").withColumn("pos", F.explode(F.sequence(F.lit(0), F.floor("len").cast("int")))).withColumn("off", F.explode(F.sequence(F.lit(-half_width), F.lit(half_width))))
    ux, uy = (F.col("x2") - F.col("x1")) / F.col("len"), (F.col("y2") - F.col("y1")) / F.col("len")
    pts = grid.select(F.struct("scan_id", "pos", "off").alias("point_id"), "video_id", "frame_idx", (F.col("x1") + F.col("pos") * ux - F.col("off") * uy).alias("px"), (F.col("y1") + F.col("pos") * uy + F.col("off") * ux).alias("py"))
    return sample_bilinear(pixels, pts).groupBy(F.col("point_id.scan_id").alias("scan_id"), F.col("point_id.pos").alias("pos")).agg(F.avg("v").alias("v"))


def subimage(pixels: DataFrame, left: float, right: float, top: float, bottom: float, width: int, height: int) -> DataFrame:
    """A window of every frame, resampled to width x height, upright; corners map to corners."""
    frames = pixels.select("video_id", "frame_idx").distinct()
    grid = frames.withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    pts = grid.select(F.struct("gy", "gx").alias("point_id"), "video_id", "frame_idx", (F.lit(left) + F.col("gx") * ((right - left) / max(1, width - 1))).alias("px"), (F.lit(top) + F.col("gy") * ((bottom - top) / max(1, height - 1))).alias("py"))
    return sample_bilinear(pixels, pts).select("video_id", "frame_idx", F.col("point_id.gy").alias("y"), F.col("point_id.gx").alias("x"), "v")
