"""Spatial joins and measures of rectangles, polygons, lines, rays and circles, as set-level jobs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import buckets
from framewright.functions.numbering import numbered


def _ring() -> Window:
    """A polygon's corners in order."""
    return Window.partitionBy("poly_id").orderBy("i")


def bounding_rects(points: DataFrame, key: str, margin: float = 0.0, inclusive: bool = False) -> DataFrame:
    """Bounding rectangle of each point set, with a margin on all sides; `inclusive` counts the corners' own cells, one more each way."""
    more = 2 * margin + (1 if inclusive else 0)
    box = points.groupBy(key).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return box.select(key, (F.col("x0") - margin).alias("x"), (F.col("y0") - margin).alias("y"), (F.col("x1") - F.col("x0") + more).alias("w"), (F.col("y1") - F.col("y0") + more).alias("h"))


def points_in_rects(points: DataFrame, rects: DataFrame, size: float | None = None) -> DataFrame:
    """Pairs of points and rectangles, borders included; `size` is the cell size of the grid (by the rectangles' density if not given).

    Points of one place and equal rectangles are compared once. The points of a cell are dealt into shares, which meet all its rectangles. The rows of one
    rectangle follow each other, then those of the next with the same points, which files store in little space.
    """
    boxes = rects.select("rect_id", F.col("x").alias("rx"), F.col("y").alias("ry"), (F.col("x") + F.col("w")).alias("rx1"), (F.col("y") + F.col("h")).alias("ry1"))
    size = size or buckets.cell_size(boxes, "rx", "ry", "rx1", "ry1")
    place, sides, keys = ["x", "y"], ["rx", "ry", "rx1", "ry1"], ["cx", "cy", "deal"]
    others = [c for c in points.columns if c not in place]
    asked = buckets.cell_of(buckets.blocks(points.where("x is not null and y is not null"), place, F.struct(*others), others or place), size)
    held = buckets.cells_of(buckets.blocks(boxes, sides, F.struct("rect_id"), ["rect_id"]).withColumnRenamed("members", "rects"), size, *sides)
    held = buckets.dealt(held.select("cx", "cy", *sides, "rects", F.explode(F.sequence(F.lit(0), F.lit(buckets.DEALS - 1))).alias("deal")), keys)
    met = buckets.dealt(asked, keys).join(held, keys).where("x between rx and rx1 and y between ry and ry1").select(*place, "members", "rects")
    pairs = met.withColumn("r", F.explode("rects")).withColumn("p", F.explode("members"))
    return pairs.select(*[F.col(c) if c in place else F.col(f"p.{c}") for c in points.columns], "r.rect_id")


def overlaps(rects: DataFrame, size: float | None = None) -> DataFrame:
    """Pairs a < b of overlapping rectangles with their intersection; touching is not overlapping. `size` as in `points_in_rects`.

    Equal rectangles are compared as one block. The blocks of a cell are dealt into shares, and two shares meet under one key, once.
    """
    corners = rects.withColumns({"x1": F.col("x") + F.col("w"), "y1": F.col("y") + F.col("h")})
    size = size or buckets.cell_size(corners, "x", "y", "x1", "y1")
    sides, keys = ["x", "y", "x1", "y1"], ["cx", "cy", "low", "high"]
    boxes = buckets.cells_of(buckets.blocks(corners, sides, F.col("rect_id"), ["rect_id"]), size, *sides)
    first = boxes.withColumns({"low": F.col("deal"), "high": F.explode(F.sequence(F.col("deal"), F.lit(buckets.DEALS - 1)))})
    second = boxes.withColumns({"low": F.explode(F.sequence(F.lit(0), F.col("deal"))), "high": F.col("deal")})
    a, b = (buckets.dealt(listed, keys).select(*keys, *[F.col(c).alias(f"{s}_{c}") for c in (*sides, "block", "members")]) for s, listed in (("a", first), ("b", second)))
    x, y = F.greatest("a_x", "b_x"), F.greatest("a_y", "b_y")
    w, h = F.least("a_x1", "b_x1") - x, F.least("a_y1", "b_y1") - y
    before, same = F.lit(False), F.lit(True)
    for c in reversed((*sides, "block")):
        before = (F.col(f"a_{c}") < F.col(f"b_{c}")) | ((F.col(f"a_{c}") == F.col(f"b_{c}")) & before)
        same = (F.col(f"a_{c}") == F.col(f"b_{c}")) & same
    once = (F.col("low") < F.col("high")) | before | same
    met = a.join(b, keys).where((w > 0) & (h > 0) & (F.col("cx") == buckets.cell(x, size)) & (F.col("cy") == buckets.cell(y, size)) & once)
    met = met.select("a_members", "b_members", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), ((F.col("low") == F.col("high")) & same).alias("same"))
    pairs = met.withColumn("p", F.explode("a_members")).withColumn("q", F.explode("b_members"))
    return pairs.where("p < q or q < p and not same").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "x", "y", "w", "h")


def cuboid_statistics(pixels: DataFrame, cuboids: DataFrame) -> DataFrame:
    """Figures of the pixels inside half-open boxes: pos and size hold x, y, frame_idx. Boxes meet the pixels by cells of the average box."""
    bounds = [(F.col("x"), 0), (F.col("y"), 1), (F.col("frame_idx"), 2)]
    inside = [(v >= F.col("pos")[k]) & (v < F.col("pos")[k] + F.col("size")[k]) for v, k in bounds]
    mean = cuboids.agg(*[F.greatest(F.lit(1.0), F.avg(F.col("size")[k])) for k in range(3)]).first()
    listed = cuboids
    for k in range(3):
        low, high = F.floor(F.col("pos")[k] / (mean[k] or 1.0)), F.floor((F.col("pos")[k] + F.col("size")[k]) / (mean[k] or 1.0))
        listed = listed.withColumn(f"cell{k}", F.explode(F.sequence(low, high)))
    celled = pixels.withColumns({f"cell{k}": F.floor(v / (mean[k] or 1.0)) for v, k in bounds})
    listed = F.broadcast(listed) if buckets.is_small(listed) else listed
    hit = celled.join(listed, [f"cell{k}" for k in range(3)]).where(inside[0] & inside[1] & inside[2])
    volume = F.aggregate("size", F.lit(1.0), lambda p, s: p * s)
    return hit.withColumn("volume", volume).groupBy("id", "volume").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"))


#: Positions of a chunk, and shares of the frames, when a template is moved to more positions than can be broadcast.
CHUNK, SHARES = 1024, 16


def template_match(pixels: DataFrame, template: DataFrame, positions: DataFrame) -> DataFrame:
    """Squared difference of a template (y, x, t) with every frame at offsets (dy, dx) over the overlap; offsets without overlap give no row.

    The template is moved to every position, which is the work asked for. Positions are listed in chunks, and every template pixel under the number
    of each chunk. The moved template goes to every task up to SMALL rows; beyond that it meets the pixels of a share of the frames by place.
    """
    numbered_ = numbered(positions.select("dy", "dx"), [F.col("dy"), F.col("dx")], "chunk").withColumn("chunk", F.floor(F.col("chunk") / CHUNK))
    chunks = numbered_.groupBy("chunk").agg(F.collect_list(F.struct("dy", "dx")).alias("offsets"))
    count = chunks.count()
    placed = template.select("y", "x", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, count - 1)).cast("long"))).alias("chunk")).join(chunks, "chunk")
    placed = placed.select("y", "x", "t", F.explode("offsets").alias("o")).select("o.dy", "o.dx", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "t")
    if buckets.is_small(placed):
        met = pixels.join(F.broadcast(placed), ["y", "x"])
    else:
        share = F.pmod(F.xxhash64("video_id", "frame_idx"), F.lit(SHARES)).cast("int")
        met = pixels.withColumn("share", share).join(placed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))), ["y", "x", "share"])
    return met.groupBy("video_id", "frame_idx", "dy", "dx").agg(F.sum((F.col("v") - F.col("t")) * (F.col("v") - F.col("t"))).alias("ssd"), F.count(F.lit(1)).alias("n"))


def ring_edges(contours: DataFrame) -> DataFrame:
    """Edges of closed polygons: poly_id, i, x, y, x2, y2."""
    first = {n: F.first(n).over(_ring().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for n in "xy"}
    return contours.select("poly_id", "i", "x", "y", *[F.coalesce(F.lead(n).over(_ring()), first[n]).alias(f"{n}2") for n in "xy"])


def polygon_measures(contours: DataFrame) -> DataFrame:
    """Area, perimeter and centroid."""
    cross = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    sums = ring_edges(contours).groupBy("poly_id").agg((F.sum(cross) / 2).alias("a"), F.sum(F.sqrt(F.pow(F.col("x2") - F.col("x"), F.lit(2)) + F.pow(F.col("y2") - F.col("y"), F.lit(2)))).alias("perimeter"), F.sum((F.col("x") + F.col("x2")) * cross).alias("sx"), F.sum((F.col("y") + F.col("y2")) * cross).alias("sy"))
    return sums.select("poly_id", F.abs("a").alias("area"), "perimeter", (F.col("sx") / (6 * F.col("a"))).alias("cx"), (F.col("sy") / (6 * F.col("a"))).alias("cy"))


def contour_moments(contours: DataFrame) -> DataFrame:
    """Moments of the enclosed area to the second order by Green's theorem."""
    x, y, p, q = (F.col(n).cast("double") for n in ("x", "y", "x2", "y2"))
    c = x * q - p * y
    terms = {"m00": c / 2, "m10": (x + p) * c / 6, "m01": (y + q) * c / 6, "m20": (x * x + x * p + p * p) * c / 12, "m11": (x * (2 * y + q) + p * (y + 2 * q)) * c / 24, "m02": (y * y + y * q + q * q) * c / 12}
    sums = ring_edges(contours).groupBy("poly_id").agg(*[F.sum(e).alias(n) for n, e in terms.items()])
    return sums.select("poly_id", *[(F.col(n) * F.signum("m00")).alias(n) for n in terms])


def points_in_polygons(points: DataFrame, contours: DataFrame, size: float | None = None) -> DataFrame:
    """Pairs of points (point_id, px, py) and polygons that contain them, by crossings, after a bounding box join.

    A polygon's edges are listed in slabs of y, as many as the root of their number; a point counts crossings in its own slab only.
    """
    boxes = bounding_rects(contours, "poly_id").select(F.col("poly_id").alias("rect_id"), "x", "y", "w", "h")
    near = points_in_rects(points.select("point_id", F.col("px").alias("x"), F.col("py").alias("y")), boxes, size).select("point_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("rect_id").alias("poly_id"))
    crossing = ((F.col("y") > F.col("py")) != (F.col("y2") > F.col("py"))) & (F.col("px") < (F.col("x2") - F.col("x")) * (F.col("py") - F.col("y")) / (F.col("y2") - F.col("y")) + F.col("x"))
    slabs = contours.groupBy("poly_id").agg(F.min("y").alias("y0"), ((F.max("y") - F.min("y")) / F.ceil(F.sqrt(F.count(F.lit(1))))).alias("high")).where("high > 0")
    slab = {e: F.floor((F.col(e) - F.col("y0")) / F.col("high")) for e in ("y", "y2", "py")}
    edges = ring_edges(contours).where("y <> y2").join(slabs, "poly_id").withColumn("slab", F.explode(F.sequence(F.least(slab["y"], slab["y2"]), F.greatest(slab["y"], slab["y2"]))))
    asked = near.join(slabs, "poly_id").withColumn("slab", slab["py"]).drop("y0", "high")
    hits = asked.join(edges.drop("y0", "high"), ["poly_id", "slab"]).groupBy("poly_id", "point_id").agg(F.sum(F.when(crossing, 1).otherwise(0)).alias("n"))
    return hits.where("n % 2 = 1").select("poly_id", "point_id")


def raster_spans(contours: DataFrame) -> DataFrame:
    """Mask pixels of polygons as spans poly_id, y, x0, x1, which may overlap: whole scan lines between paired crossings, and the pixels that edges pass through at whole rows."""
    every = ring_edges(contours)
    e = every.where("y <> y2")
    low, high = F.least("y", "y2"), F.greatest("y", "y2")
    rows = e.withColumn("row", F.explode(F.sequence(F.ceil(low).cast("int"), F.floor(high).cast("int"))))
    at = F.col("x") + (F.col("row") - F.col("y")) * (F.col("x2") - F.col("x")) / (F.col("y2") - F.col("y"))
    rows = rows.select("poly_id", "row", at.alias("at"), (F.col("row") < high).alias("counts"))
    order = Window.partitionBy("poly_id", "row").orderBy("at")
    pairs = rows.where("counts").select("poly_id", "row", "at", F.row_number().over(order).alias("k"), F.lead("at").over(order).alias("stop")).where("k % 2 = 1 and stop is not null")
    filled = pairs.select("poly_id", F.col("row").alias("y"), F.ceil("at").cast("int").alias("x0"), F.floor("stop").cast("int").alias("x1")).where("x0 <= x1")
    rim = rows.select("poly_id", F.col("row").alias("y"), F.round("at").cast("int").alias("x0"), F.round("at").cast("int").alias("x1"))
    flat = every.where("y = y2").select("poly_id", F.col("y").cast("int").alias("y"), F.least("x", "x2").cast("int").alias("x0"), F.greatest("x", "x2").cast("int").alias("x1")).where("x0 is not null")
    return filled.unionByName(rim).unionByName(flat)


def rasterize(contours: DataFrame) -> DataFrame:
    """Mask pixels of polygons, those of `raster_spans`."""
    return raster_spans(contours).select("poly_id", "y", F.explode_outer(F.sequence("x0", "x1")).alias("x")).distinct()


def simplify_contours(contours: DataFrame, threshold: float) -> DataFrame:
    """Visvalingam-Whyatt in rounds: of the vertices whose triangle is below the threshold, the local minima go; three vertices stay."""
    from framewright.functions.iterate import cut

    now = cut(contours.select("poly_id", "i", "x", "y"))
    whole = _ring().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    around = lambda n: (F.coalesce(F.lag(n).over(_ring()), F.last(n).over(whole)), F.coalesce(F.lead(n).over(_ring()), F.first(n).over(whole)))
    while True:
        (px, nx), (py, ny) = around("x"), around("y")
        area = F.abs((px - F.col("x")) * (ny - F.col("y")) - (nx - F.col("x")) * (py - F.col("y"))) / 2
        sized = now.select("poly_id", "i", "x", "y", area.alias("area"), F.count(F.lit(1)).over(Window.partitionBy("poly_id")).alias("n"))
        rank = sized.withColumn("rank", F.struct("area", "i"))
        before, after = around("rank")
        judged = cut(rank.select("poly_id", "i", "x", "y", ((F.col("area") < threshold) & (F.col("n") > 3) & (F.col("rank") < before) & (F.col("rank") < after)).alias("gone"), "n", "area"))
        lone = judged.where("gone").withColumn("k", F.row_number().over(Window.partitionBy("poly_id").orderBy("area", "i"))).where("k <= n - 3").select("poly_id", "i")
        if not lone.take(1):
            return now
        now = cut(now.join(lone, ["poly_id", "i"], "left_anti"))


def _crossings(left: DataFrame, right: DataFrame) -> DataFrame:
    """Solves pairs of segments (ax, ay, bx, by) x (cx, cy, dx, dy): adds det, t, u."""
    rx, ry, sx, sy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("dx") - F.col("cx"), F.col("dy") - F.col("cy")
    qx, qy = F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay")
    det = rx * sy - ry * sx
    safe = F.when(det != 0, det)
    return left.withColumns({"det": det, "t": (qx * sy - qy * sx) / safe, "u": (qx * ry - qy * rx) / safe, "side": qx * ry - qy * rx})


ENDS = ("x", "y", "x2", "y2")


def grids(edges: DataFrame) -> DataFrame:
    """poly_id, x0, y0, x1, y1 and cell: a grid over each polygon, about as many cells as it has edges."""
    sides = [F.min(F.least("x", "x2")).alias("x0"), F.min(F.least("y", "y2")).alias("y0"), F.max(F.greatest("x", "x2")).alias("x1"), F.max(F.greatest("y", "y2")).alias("y1")]
    box = edges.groupBy("poly_id").agg(*[c.cast("double") for c in sides], F.count(F.lit(1)).alias("n")).toDF("poly_id", "x0", "y0", "x1", "y1", "n")
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / F.ceil(F.sqrt("n"))
    return box.select("poly_id", "x0", "y0", "x1", "y1", F.when(size > 0, size).otherwise(1.0).alias("cell"))


def crossed_cells(segments: DataFrame, ends: tuple[str, str, str, str] = ENDS) -> DataFrame:
    """The segments with a row for each cell (cx, cy) of their grid (x0, y0, x1, y1, cell) that they pass through, column by column.

    Parts outside the grid's bounds have no cells. Cells at whose rim a segment passes may be listed, too.
    """
    ax, ay, bx, by = (F.col(e).cast("double") for e in ends)
    dx, dy = bx - ax, by - ay
    slack = F.col("cell") * 1e-6

    def share(low: Column, high: Column, start: Column, step: Column) -> Column:
        """The shares of the segment between which one coordinate is within bounds."""
        one, two = (low - slack - start) / step, (high + slack - start) / step
        flat = F.when((start >= low - slack) & (start <= high + slack), F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))).otherwise(F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")))
        return F.when(step != 0, F.struct(F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))).otherwise(flat)

    inside = segments.withColumns({"__h": share(F.col("x0"), F.col("x1"), ax, dx), "__v": share(F.col("y0"), F.col("y1"), ay, dy)})
    inside = inside.withColumns({"__a": F.greatest(F.lit(0.0), "__h.a", "__v.a"), "__b": F.least(F.lit(1.0), "__h.b", "__v.b")}).where("__a <= __b")
    left, right = (F.least(ax + F.col("__a") * dx, ax + F.col("__b") * dx), F.greatest(ax + F.col("__a") * dx, ax + F.col("__b") * dx))
    columns = inside.withColumn("cx", F.explode(F.sequence(F.floor((left - F.col("x0") - slack) / F.col("cell")), F.floor((right - F.col("x0") + slack) / F.col("cell")))))
    edge = F.col("x0") + F.col("cx") * F.col("cell")
    part = columns.withColumn("__h", share(edge, edge + F.col("cell"), ax, dx)).withColumns({"__a": F.greatest("__a", "__h.a"), "__b": F.least("__b", "__h.b")}).where("__a <= __b")
    low, high = F.least(ay + F.col("__a") * dy, ay + F.col("__b") * dy), F.greatest(ay + F.col("__a") * dy, ay + F.col("__b") * dy)
    cells = F.sequence(F.floor((low - F.col("y0") - slack) / F.col("cell")), F.floor((high - F.col("y0") + slack) / F.col("cell")))
    return part.withColumn("cy", F.explode(cells)).drop("__h", "__v", "__a", "__b")


def intersections(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Intersection points of the polygons p1, p2 of each pair; pairs with collinear overlaps yield nothing. Edges meet in the cells of p1's grid."""
    grid = grids(edges).withColumnRenamed("poly_id", "p1")
    sides = {"p1": ("ax", "ay", "bx", "by"), "p2": ("cx_", "cy_", "dx", "dy")}
    a, b = (edges.select(F.col("poly_id").alias(p), F.col("i").alias(f"i_{p}"), *[F.col(c).cast("double").alias(n) for c, n in zip(ENDS, names, strict=True)]) for p, names in sides.items())
    wanted = pairs.select("p1", "p2").distinct()
    a = crossed_cells(a.join(wanted.select("p1").distinct(), "p1").join(grid, "p1"), sides["p1"]).select("p1", "i_p1", *sides["p1"], "cx", "cy")
    b = crossed_cells(b.join(wanted, "p2").join(grid, "p1"), sides["p2"]).select("p1", "p2", "i_p2", *sides["p2"], "cx", "cy")
    met = a.join(b, ["p1", "cx", "cy"]).drop("cx", "cy").dropDuplicates(["p1", "p2", "i_p1", "i_p2"]).withColumnsRenamed({"cx_": "cx", "cy_": "cy"})
    touching = (F.greatest(F.least("ax", "bx"), F.least("cx", "dx")) <= F.least(F.greatest("ax", "bx"), F.greatest("cx", "dx"))) & (F.greatest(F.least("ay", "by"), F.least("cy", "dy")) <= F.least(F.greatest("ay", "by"), F.greatest("cy", "dy")))
    both = _crossings(met.where(touching), edges)
    shared = (F.greatest(F.least("ax", "bx"), F.least("cx", "dx")) < F.least(F.greatest("ax", "bx"), F.greatest("cx", "dx"))) | (F.greatest(F.least("ay", "by"), F.least("cy", "dy")) < F.least(F.greatest("ay", "by"), F.greatest("cy", "dy")))
    overlap = both.where((F.col("det") == 0) & (F.col("side") == 0) & shared).select("p1", "p2").distinct()
    hits = both.where("det <> 0 and t between 0 and 1 and u between 0 and 1")
    points = hits.select("p1", "p2", F.round(F.col("ax") + F.col("t") * (F.col("bx") - F.col("ax")), 6).alias("x"), F.round(F.col("ay") + F.col("t") * (F.col("by") - F.col("ay")), 6).alias("y")).distinct()
    return points.join(overlap, ["p1", "p2"], "left_anti")


def ray_hits(rays: DataFrame, edges: DataFrame, length: float = 1000.0) -> DataFrame:
    """First hit of each ray (ray_id, poly_id, x, y, angle) with its polygon: hx, hy, dist, null for misses. A ray meets the edges in the cells it crosses only."""
    grid = grids(edges)
    b = crossed_cells(edges.select("poly_id", *ENDS).join(grid, "poly_id")).select("poly_id", "cx", "cy", *[F.col(c).cast("double").alias(n) for c, n in zip(ENDS, ("ex", "ey", "dx", "dy"), strict=True)])
    far = rays.select("ray_id", "poly_id", "angle", F.col("x").cast("double").alias("ax"), F.col("y").cast("double").alias("ay")).withColumns({"bx": F.col("ax") + length * F.cos("angle"), "by": F.col("ay") + length * F.sin("angle")})
    passed = crossed_cells(far.join(grid, "poly_id"), ("ax", "ay", "bx", "by")).select("ray_id", "poly_id", "ax", "ay", "bx", "by", "cx", "cy")
    met = passed.join(b, ["poly_id", "cx", "cy"]).drop("cx", "cy").withColumnsRenamed({"ex": "cx", "ey": "cy"})
    hits = _crossings(met, edges).where("det <> 0 and t between 0 and 1 and u between 0 and 1")
    best = hits.groupBy("ray_id").agg(F.min(F.struct((F.col("t") * length).alias("dist"), (F.col("ax") + F.col("t") * (F.col("bx") - F.col("ax"))).alias("hx"), (F.col("ay") + F.col("t") * (F.col("by") - F.col("ay"))).alias("hy"))).alias("m"))
    return rays.join(best, "ray_id", "left").select("ray_id", "poly_id", "angle", F.col("m.hx").alias("hx"), F.col("m.hy").alias("hy"), F.col("m.dist").alias("dist"))


def fan(anchors: DataFrame, angles: list[float]) -> DataFrame:
    """Rays from each anchor (anchor_id, poly_id, x, y) at literal angles: ray_id is a struct of anchor and angle number."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(a)).alias("angle")) for k, a in enumerate(angles)])
    return anchors.withColumn("a", F.explode(table)).select(F.struct("anchor_id", F.col("a.k").alias("k")).alias("ray_id"), "poly_id", "x", "y", F.col("a.angle").alias("angle"))


def farthest_hit(hits: DataFrame) -> DataFrame:
    """The farthest first hit of each fan, the first angle if tied; (null, 0, null) where all rays miss."""
    rank = F.when(F.col("dist").isNotNull(), F.struct(F.round("dist", 9).alias("d"), (-F.col("ray_id.k")).alias("k"), "hx", "hy", "angle"))
    best = hits.groupBy(F.col("ray_id.anchor_id").alias("anchor_id")).agg(F.max(rank).alias("m"))
    return best.select("anchor_id", F.col("m.hx").alias("hx"), F.col("m.hy").alias("hy"), F.coalesce("m.d", F.lit(0.0)).alias("dist"), F.col("m.angle").alias("angle"))


def arc_points(arcs: DataFrame, spacing: float, full: bool = True) -> DataFrame:
    """Points on circles (id, cx, cy, r) or arcs (and start, stop angles) about `spacing` apart: at least 4, or 2."""
    start, stop = (F.lit(0.0), F.lit(2 * math.pi)) if full else (F.col("start"), F.col("stop"))
    n = F.greatest(F.lit(4 if full else 2), F.round((stop - start) * F.col("r") / spacing).cast("int"))
    rows = arcs.withColumns({"__a": start, "__z": stop, "__n": n}).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    angle = F.col("__a") + (F.col("__z") - F.col("__a")) * F.col("i") / (F.col("__n") if full else F.col("__n") - 1)
    return rows.select("id", "i", (F.col("cx") + F.col("r") * F.cos(angle)).alias("x"), (F.col("cy") + F.col("r") * F.sin(angle)).alias("y"))


def circle_figures(circles: DataFrame) -> DataFrame:
    """Area, circumference and bounds of circles (id, cx, cy, r)."""
    r = F.col("r")
    return circles.select("id", (math.pi * r * r).alias("area"), (2 * math.pi * r).alias("perimeter"), (F.col("cx") - r).alias("x"), (F.col("cy") - r).alias("y"), (2 * r).alias("w"), (2 * r).alias("h"))


def gradients(pixels: DataFrame, height: int, width: int, sigma: float = 3.0) -> DataFrame:
    """5x5 Sobel derivatives gx, gy of the blurred pixels."""
    from framewright.functions import kernels
    from framewright.operators.frames import blur

    soft, slope = [1.0, 4.0, 6.0, 4.0, 1.0], [-1.0, -2.0, 0.0, 2.0, 1.0]
    base = blur(pixels, (width, height), sigma)
    gx = kernels.separable(base, kernels.convolution(soft, height), kernels.convolution(slope, width), dealt=True).withColumnRenamed("v", "gx")
    gy = kernels.separable(base, kernels.convolution(slope, height), kernels.convolution(soft, width), dealt=True).withColumnRenamed("v", "gy")
    return gx.join(gy, ["video_id", "frame_idx", "y", "x"])


def angle_column(index: Column, count: int) -> Column:
    return index * (2 * math.pi / count)


def contour_eccentricity(contours: DataFrame) -> DataFrame:
    """Eccentricity of each polygon's area, from the eigenvalues of its central moments; null without area."""
    m = contour_moments(contours).where("m00 <> 0")
    cx, cy = F.col("m10") / F.col("m00"), F.col("m01") / F.col("m00")
    a, b, c = (F.round(F.col(n) / F.col("m00") - p, 9) for n, p in (("m20", cx * cx), ("m11", cx * cy), ("m02", cy * cy)))
    spread = F.sqrt(4 * b * b + (a - c) * (a - c))
    figures = m.select("poly_id", (a + c + spread).alias("big"), F.greatest(a + c - spread, F.lit(0.0)).alias("small"))
    return figures.select("poly_id", F.when(F.col("big") > 0, F.sqrt(1 - F.col("small") / F.col("big"))).alias("eccentricity"))


def arc_figures(arcs: DataFrame) -> DataFrame:
    """Of arcs (id, cx, cy, r, start, stop; counter-clockwise angles, stop >= start): length, sector area, centroid of the line, bounds, end tangents."""
    span = F.col("stop") - F.col("start")
    at = {n: F.struct((F.col("cx") + F.col("r") * F.cos(a)).alias("x"), (F.col("cy") + F.col("r") * F.sin(a)).alias("y")) for n, a in (("p0", F.col("start")), ("p1", F.col("stop")))}
    quarters = F.sequence(F.ceil(F.col("start") / (math.pi / 2) - 1e-12), F.floor(F.col("stop") / (math.pi / 2) + 1e-12))
    turns = F.when(F.ceil(F.col("start") / (math.pi / 2) - 1e-12) <= F.floor(F.col("stop") / (math.pi / 2) + 1e-12), quarters).otherwise(F.array().cast("array<bigint>"))
    extremes = F.transform(turns, lambda k: F.struct((F.col("cx") + F.col("r") * F.cos(k * (math.pi / 2))).alias("x"), (F.col("cy") + F.col("r") * F.sin(k * (math.pi / 2))).alias("y")))
    every = arcs.withColumns({"span": span, **at}).withColumn("on", F.concat(F.array("p0", "p1"), extremes))
    middle, chord = (F.col("start") + F.col("stop")) / 2, F.when(F.col("span") > 0, 2 * F.sin(F.col("span") / 2) / F.col("span")).otherwise(1.0)
    xs, ys = F.transform("on", lambda p: p["x"]), F.transform("on", lambda p: p["y"])
    low, high = ({"x": f(xs), "y": f(ys)} for f in (F.array_min, F.array_max))
    centroid = [(F.col("cx") + F.col("r") * chord * F.cos(middle)).alias("mx"), (F.col("cy") + F.col("r") * chord * F.sin(middle)).alias("my")]
    bounds = [low["x"].alias("x"), low["y"].alias("y"), (high["x"] - low["x"]).alias("w"), (high["y"] - low["y"]).alias("h")]
    tangents = [(-F.sin("start")).alias("tx"), F.cos("start").alias("ty")]
    return every.select("id", (F.col("r") * F.col("span")).alias("length"), (F.col("r") * F.col("r") * F.col("span") / 2).alias("area"), *centroid, *bounds, *tangents)


def region_outlines(mask: DataFrame) -> DataFrame:
    """Boundary of each frame's largest region as ordered corner points, outer rings only: video_id, frame_idx, i, x, y. As `span_outlines` of the pixels."""
    return span_outlines(mask.select("video_id", "frame_idx", "y", F.col("x").alias("x0"), F.col("x").alias("x1")))


def span_outlines(spans: DataFrame) -> DataFrame:
    """Boundary of each frame's largest region of the pixels in spans (video_id, frame_idx, y, x0, x1), which may overlap: video_id, frame_idx, i, x, y.

    Pixel sides without an inside neighbour are directed edges between grid corners, chained end to start. At a corner where two chains meet the turn
    that keeps the region four-connected is taken. The ring with the largest area stays. Frames of `regions.WHOLE` pixels at most are dealt to a task
    each, from spans to rings; pixels and rings of larger ones are dealt over tasks.
    """
    from framewright.functions import pieces
    from framewright.operators import outlines, regions

    kinds = dict(spans.dtypes)
    small, pixels, mask = pieces.split(spans, F.col("n") > regions.WHOLE)
    found = pieces.whole_frames(small, pixels, outlines.outlined, f"i int, x {kinds['x0']}, y {kinds['y']}")
    return found if mask is None else found.unionByName(_dealt_outlines(mask))


def _dealt_outlines(mask: DataFrame) -> DataFrame:
    """The outlines of frames of any size: edges and rings are dealt by node, rings are closed and ordered by pointer doubling."""
    from framewright.functions.iterate import cut, until_stable
    from framewright.operators import regions

    keys = regions.FRAME
    region = cut(regions.largest_region(regions.label(mask)).select(*regions.PIXEL))
    #: side: offset of the neighbour, start corner, end corner (inside on the right hand)
    sides = [(-1, 0, 0, 0, 0, 1), (0, 1, 0, 1, 1, 1), (1, 0, 1, 1, 1, 0), (0, -1, 1, 0, 0, 0)]
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dy", "dx", "sy", "sx", "ey", "ex"), s, strict=True)], F.lit(k).alias("k")) for k, s in enumerate(sides)])
    edges = region.withColumn("s", F.explode(table)).select(*keys, "y", "x", F.col("s.k").alias("k"), (F.col("y") + F.col("s.dy")).alias("ny"), (F.col("x") + F.col("s.dx")).alias("nx"), (F.col("y") + F.col("s.sy")).alias("sy"), (F.col("x") + F.col("s.sx")).alias("sx"), (F.col("y") + F.col("s.ey")).alias("ey"), (F.col("x") + F.col("s.ex")).alias("ex"))
    outside = region.select(*keys, F.col("y").alias("ny"), F.col("x").alias("nx"))
    edges = cut(edges.join(outside, [*keys, "ny", "nx"], "left_anti").withColumn("node", (F.col("sy").cast("long") * (1 << 24) + F.col("sx")) * 4 + F.col("k")))
    ahead = edges.select(*keys, F.col("sy").alias("ey"), F.col("sx").alias("ex"), F.col("k").alias("k2"), F.col("node").alias("next"))
    turn = (F.col("k2") - F.col("k") + 4) % 4  # 1: right, which keeps four-connected regions apart at a shared corner
    links = edges.join(ahead, [*keys, "ey", "ex"]).groupBy(*keys, "node", "sy", "sx").agg(F.min(F.struct(F.when(turn == 1, 0).when(turn == 0, 1).otherwise(2).alias("t"), "next")).alias("m")).select(*keys, "node", "sy", "sx", F.col("m.next").alias("next"))
    links = cut(links)

    def least(now: DataFrame) -> DataFrame:
        far = now.select(*keys, F.col("node").alias("jump"), F.col("low").alias("low2"), F.col("jump").alias("jump2"))
        both = now.join(far, [*keys, "jump"])
        return both.select(*keys, "node", F.least("low", "low2").alias("low"), F.col("jump2").alias("jump"), (F.col("low2") < F.col("low")).alias("changed"))

    from framewright.functions.iterate import order_by_doubling

    rings = until_stable(links.select(*keys, "node", F.least("node", "next").alias("low"), F.col("next").alias("jump")), least)
    named = links.join(rings.select(*keys, "node", "low"), [*keys, "node"])
    chains = named.select(*keys, "low", "node", F.when(F.col("next") != F.col("low"), F.col("next")).alias("next"))
    ranks = order_by_doubling(chains, [*keys, "low"])
    placed = named.join(ranks.select(*keys, "low", "node", "rank"), [*keys, "low", "node"])
    ring = Window.partitionBy(*keys, "low").orderBy(F.desc("rank"))
    points = placed.select(*keys, "low", (F.row_number().over(ring) - 1).alias("i"), F.col("sx").alias("x"), F.col("sy").alias("y"))
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_i = Window.partitionBy(*keys, "low").orderBy("i")
    span = by_i.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shoelace = F.col("x") * F.coalesce(F.lead("y").over(by_i), F.first("y").over(span)) - F.coalesce(F.lead("x").over(by_i), F.first("x").over(span)) * F.col("y")
    areas = points.withColumn("c", shoelace).groupBy(*keys, "low").agg((F.abs(F.sum("c")) / 2).alias("area"))
    best = areas.groupBy(*keys).agg(F.max(F.struct("area", (-F.col("low")).alias("m"))).alias("b")).select(*keys, (-F.col("b.m")).alias("low"))
    return points.join(best, [*keys, "low"]).select(*keys, "i", "x", "y")
