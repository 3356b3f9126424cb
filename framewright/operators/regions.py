"""Local statistics, peaks, regions and distance maps over long pixels and sparse masks.

Pixels are video_id, frame_idx, y, x, v; a mask holds the inside pixels only. Iterative operators advance all frames in the same
rounds; a round is one shuffle keyed by pixel with partial aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import kernels
from framewright.functions.iterate import connected, cut, until_stable
from framewright.operators import fields

FRAME = ["video_id", "frame_idx"]
PIXEL = [*FRAME, "y", "x"]
ROOT2 = math.sqrt(2)


def local_statistics(pixels: DataFrame, height: int, width: int, offsets: list[tuple[int, int]], prior: float | None = None) -> DataFrame:
    """Mean and variance over a neighbourhood in which outside cells count as `prior` (the frame's mean by default)."""
    n = len(offsets)
    means = pixels.groupBy(*FRAME).agg(F.avg("v").alias("prior")) if prior is None else None
    known = pixels.join(means, FRAME) if means is not None else pixels.withColumn("prior", F.lit(float(prior)))
    lifted = known.select(*PIXEL, "prior", (F.col("v") - F.col("prior")).alias("d"))
    sums = kernels.spread(lifted, offsets).where(kernels.inside(height, width)).groupBy(*PIXEL).agg(F.sum("d").alias("s1"), F.sum(F.col("d") * F.col("d")).alias("s2"), F.max("prior").alias("prior"))
    return sums.select(*PIXEL, (F.col("s1") / n + F.col("prior")).alias("mean"), ((F.col("s2") - F.col("s1") * F.col("s1") / n) / (n - 1)).alias("var"))


CROSS = [(0, 0), *kernels.FOUR]


def dilate(mask: DataFrame, height: int, width: int, offsets: list[tuple[int, int]]) -> DataFrame:
    return kernels.spread(mask, offsets).where(kernels.inside(height, width)).select(*mask.columns).distinct()


def erode(mask: DataFrame, height: int, width: int, offsets: list[tuple[int, int]]) -> DataFrame:
    """Pixels all of whose neighbours are inside; cells beyond the border never erode."""
    hits = kernels.spread(mask, offsets).where(kernels.inside(height, width)).groupBy(*mask.columns).agg(F.count(F.lit(1)).alias("n"))
    beyond = sum((F.when((F.col("y") - dy >= 0) & (F.col("y") - dy < height) & (F.col("x") - dx >= 0) & (F.col("x") - dx < width), 1).otherwise(0) for dy, dx in offsets), F.lit(0))
    kept = hits.where(F.col("n") == beyond).drop("n")
    return kept if (0, 0) in offsets else kept.join(mask, mask.columns, "left_semi")


def opened(mask: DataFrame, height: int, width: int, offsets: list[tuple[int, int]]) -> DataFrame:
    return dilate(erode(mask, height, width, offsets), height, width, offsets)


def thin(mask: DataFrame, height: int, width: int) -> DataFrame:
    """Morphological skeleton: what opening removes, gathered over repeated erosions by a cross.

    Ends when nothing is left or a round changes nothing (only completely full frames, whose skeleton is empty).
    """
    rest, skeleton, before = cut(mask.select(*PIXEL).distinct()), mask.select(*PIXEL).where("false"), -1
    while (left := rest.count()) and left != before:
        judged = cut(_thinned(rest, height, width))
        skeleton = skeleton.unionByName(judged.where("bare").select(*PIXEL))
        before, rest = left, judged.where("stays").select(*PIXEL)
    return skeleton


def _thinned(mask: DataFrame, height: int, width: int) -> DataFrame:
    """The pixels with `stays` (the erosion keeps it) and `bare` (the opening lacks it), in one shuffle, by frame."""
    own = F.max((F.col("oy") == F.col("y")) & (F.col("ox") == F.col("x")))
    near = kernels.spread(kernels.by_frame(mask), CROSS).groupBy(*PIXEL).agg(F.count(F.lit(1)).alias("n"), own.alias("own")).where("own")
    within = sum((F.when((F.col("y") - dy).between(0, height - 1) & (F.col("x") - dx).between(0, width - 1), 1).otherwise(0) for dy, dx in CROSS), F.lit(0))
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in CROSS])
    far = near.select(*PIXEL, ((F.col("n") == within) & kernels.inside(height, width)).alias("stays")).withColumn("m", F.explode(F.when(F.col("stays"), moves).otherwise(F.slice(moves, 1, 1))))
    still = (F.col("m.dy") == 0) & (F.col("m.dx") == 0)
    placed = far.select(*FRAME, (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"), still.alias("own"), (F.col("stays") & still).alias("kept"), F.col("stays").alias("covers"))
    found = placed.groupBy(*PIXEL).agg(F.max("own").alias("own"), F.max("kept").alias("stays"), F.max(F.col("covers") & kernels.inside(height, width)).alias("covered")).where("own")
    return found.select(*PIXEL, "stays", (~F.col("covered")).alias("bare"))


def thin_guo_hall(mask: DataFrame) -> DataFrame:
    """Guo-Hall thinning: two conditions on a pixel's eight neighbours, in turn, drop rim pixels until none goes. One shuffle a round, by frame."""
    #: neighbours in turn, clockwise from the one above
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    bits = F.create_map(*[F.lit(z) for k, (dy, dx) in enumerate(ring) for z in (dy * 4 + dx, 1 << k)])

    def keep(now: DataFrame, odd: bool) -> DataFrame:
        far = kernels.spread(now.select(*PIXEL, "old"), kernels.box(1))
        own = (F.col("oy") == F.col("y")) & (F.col("ox") == F.col("x"))
        bit = F.coalesce(F.element_at(bits, (F.col("oy") - F.col("y")) * 4 + F.col("ox") - F.col("x")), F.lit(0))
        near = far.groupBy(*PIXEL).agg(F.sum(bit).alias("around"), F.max(F.when(own, F.col("old"))).alias("old")).where("old is not null")
        p2, p3, p4, p5, p6, p7, p8, p9 = ((F.col("around").bitwiseAND(1 << k)) != 0 for k in range(8))
        count = lambda *terms: sum((t.cast("int") for t in terms), F.lit(0))
        turns = count(~p2 & (p3 | p4), ~p4 & (p5 | p6), ~p6 & (p7 | p8), ~p8 & (p9 | p2))
        pairs = F.least(count(p9 | p2, p3 | p4, p5 | p6, p7 | p8), count(p2 | p3, p4 | p5, p6 | p7, p8 | p9))
        side = ((p2 | p3 | ~p5) & p4) if odd else ((p6 | p7 | ~p9) & p8)
        return near.where(~((turns == 1) & pairs.between(2, 3) & ~side)).select(*PIXEL, "old")

    now, left = cut(mask.select(*PIXEL)), -1
    while (count := now.count()) != left:
        left = count
        now = cut(keep(keep(kernels.by_frame(now).withColumn("old", F.lit(1)), False), True).select(*PIXEL))
    return now


def peaks(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels that equal the maximum of their 3x3 neighbourhood, plateaus included, but not inside a zero background (all zero around)."""
    own = F.max(F.when((F.col("oy") == F.col("y")) & (F.col("ox") == F.col("x")), F.col("v")))
    near = kernels.spread(pixels, kernels.box(1)).where(kernels.inside(height, width))
    around = near.groupBy(*PIXEL).agg(F.max("v").alias("most"), F.min("v").alias("least"), own.alias("v"))
    return around.where("v = most and not (most = 0 and least = 0)").select(*PIXEL)


def strict_peaks(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels greater than all eight neighbours; pixels at the border never are."""
    own = F.max(F.when((F.col("oy") == F.col("y")) & (F.col("ox") == F.col("x")), F.col("v")))
    most = F.max(F.when((F.col("oy") != F.col("y")) | (F.col("ox") != F.col("x")), F.col("v")))
    around = kernels.spread(pixels, kernels.box(1)).groupBy(*PIXEL).agg(own.alias("v"), most.alias("most"))
    return around.where((F.col("v") > F.col("most")) & F.col("y").between(1, height - 2) & F.col("x").between(1, width - 2)).select(*PIXEL)


def runs(mask: DataFrame) -> DataFrame:
    """The runs of neighbouring pixels of each row: video_id, frame_idx, y, x0, x1."""
    row = Window.partitionBy(*FRAME, "y").orderBy("x")
    pixels = mask.select(*PIXEL).withColumn("run", F.col("x") - F.row_number().over(row))
    return pixels.groupBy(*FRAME, "y", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("run")


def run_links(found: DataFrame, slack: int) -> DataFrame:
    """Pairs (a, b) of runs in neighbouring rows that overlap, or, with `slack` 1, touch at a corner. Runs meet by the pixels of the upper one in groups of `SPAN`."""
    node = F.struct(*FRAME, "y", F.col("x0").alias("x"))
    cell = [F.explode(F.sequence(F.floor((F.col("x0") - slack) / SPAN), F.floor((F.col("x1") + slack) / SPAN))).alias("cell"), F.explode(F.sequence(F.floor(F.col("x0") / SPAN), F.floor(F.col("x1") / SPAN))).alias("cell")]
    above = found.select(node.alias("a"), *FRAME, (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), cell[0])
    below = found.select(node.alias("b"), *FRAME, "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"), cell[1])
    met = above.join(below, [*FRAME, "y", "cell"]).where((F.col("a0") <= F.col("b1") + slack) & (F.col("b0") <= F.col("a1") + slack))
    return met.select("a", "b").distinct()


#: Columns of a cell in which runs meet; pixels of a frame up to which the frame is dealt to one task.
SPAN, WHOLE = 256, 1 << 16


def _label_frames(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """The least cell of each pixel's component, frame by frame: minimum of the neighbours, then a pointer jump, twice each round.

    Pixels are dealt by frame once a round; the neighbours' groups and the windows that look labels up need no further shuffle.
    """
    cell = F.col("y").cast("long") * (1 << 20) + F.col("x")
    start = mask.select(*PIXEL, cell.alias("label"))

    def nearer(now: DataFrame) -> DataFrame:
        """PIXEL, old, and as `label` the least label of the neighbours, replaced by the label of the pixel that it names."""
        own = (F.col("oy") == F.col("y")) & (F.col("ox") == F.col("x"))
        near = kernels.spread(now, [(0, 0), *offsets]).groupBy(*PIXEL).agg(F.min("label").alias("low"), F.max(F.when(own, F.col("old"))).alias("old")).where("old is not null")
        told, asks = F.struct(cell.alias("key"), F.col("low").alias("give"), F.lit(False).alias("asks")), F.struct(F.col("low").alias("key"), F.lit(None).cast("long").alias("give"), F.lit(True).alias("asks"))
        both = near.select(*PIXEL, "old", F.explode(F.array(told, asks)).alias("m")).select(*PIXEL, "old", "m.*")
        given = both.withColumn("label", F.max("give").over(Window.partitionBy(*FRAME, "key")))
        return given.where("asks").select(*PIXEL, "old", "label")

    def step(now: DataFrame) -> DataFrame:
        after = nearer(nearer(kernels.by_frame(now).withColumn("old", F.col("label"))))
        return after.select(*PIXEL, "label", (F.col("label") != F.col("old")).alias("changed"))

    return until_stable(start, step)


def _label_runs(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """The same by run lengths: the runs of a row are nodes, runs that touch in neighbouring rows are links, and rounds go over runs, which are dealt
    by run, so a large frame is many keys."""
    found = cut(runs(mask))
    nodes = found.select(F.struct(*FRAME, "y", F.col("x0").alias("x")).alias("node"))
    named = connected(nodes, run_links(found, 1 if len(offsets) == 8 else 0)).select("node.*", (F.col("label.y").cast("long") * (1 << 20) + F.col("label.x")).alias("label"))
    placed = found.join(named.withColumnRenamed("x", "x0"), [*FRAME, "y", "x0"])
    return placed.select(*FRAME, "y", F.explode(F.sequence("x0", "x1")).alias("x"), "label")


def label(mask: DataFrame, offsets: list[tuple[int, int]] = kernels.FOUR, dense: bool = True) -> DataFrame:
    """Connected components under four or eight neighbours: adds `label`, the least cell of the component (y * 2^20 + x), or numbers from 1 within each frame with `dense`.

    Frames of `WHOLE` mask pixels at most are each dealt to a task; if there is a larger one, runs of pixels are dealt instead.
    """
    mask = cut(mask.select(*PIXEL))
    largest = mask.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    done = _label_frames(mask, offsets) if largest <= WHOLE else _label_runs(mask, offsets)
    if not dense:
        return done
    order = done.select(*FRAME, "label").distinct().withColumn("number", F.row_number().over(Window.partitionBy(*FRAME).orderBy("label")))  # a row for each region
    return done.join(order, [*FRAME, "label"]).select(*PIXEL, F.col("number").alias("label"))


def largest_region(labels: DataFrame) -> DataFrame:
    """Pixels and `area` of each frame's largest region; ties go to the smallest label."""
    areas = labels.groupBy(*FRAME, "label").agg(F.count(F.lit(1)).alias("area"))
    best = areas.groupBy(*FRAME).agg(F.max(F.struct("area", (-F.col("label")).alias("minus"))).alias("b")).select(*FRAME, (-F.col("b.minus")).alias("label"), F.col("b.area").alias("area"))
    return labels.join(best, [*FRAME, "label"]).select(*PIXEL, "area")


def moments(labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Raster moments to the second order of each region."""
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    sums = {"m00": F.lit(1).cast("long"), "m10": x, "m01": y, "m20": x * x, "m11": x * y, "m02": y * y}
    return labels.groupBy(*(keys or [*FRAME, "label"])).agg(*[F.sum(e).alias(n) for n, e in sums.items()])


def centroid(moment_rows: DataFrame) -> DataFrame:
    return moment_rows.withColumns({"area": F.col("m00"), "cx": F.col("m10") / F.col("m00"), "cy": F.col("m01") / F.col("m00")})


def central(moment_rows: DataFrame) -> DataFrame:
    """Central second moments mu20, mu11, mu02, to 9 digits."""
    m = {n: F.col(n).cast("double") for n in ("m00", "m10", "m01", "m20", "m11", "m02")}
    return moment_rows.withColumns({"mu20": F.round(m["m20"] - m["m10"] * m["m10"] / m["m00"], 9), "mu11": F.round(m["m11"] - m["m10"] * m["m01"] / m["m00"], 9), "mu02": F.round(m["m02"] - m["m01"] * m["m01"] / m["m00"], 9)})


def orientation(a: Column, b: Column, c: Column) -> Column:
    """-atan2(2 mu11, mu20 - mu02) / 2; plus or minus pi/4 where mu20 = mu02."""
    return F.when(F.abs(a - c) < 1e-9, F.when(b > 0, -math.pi / 4).otherwise(math.pi / 4)).otherwise(-F.atan2(2 * b, a - c) / 2)


def shape_figures(moment_rows: DataFrame) -> DataFrame:
    """orientation, eccentricity, major and minor axis length from the inertia tensor's eigenvalues."""
    t = central(moment_rows)
    a, b, c = (F.col(n) / F.col("m00") for n in ("mu20", "mu11", "mu02"))
    spread = F.sqrt(4 * b * b + (a - c) * (a - c))
    big, small = a + c + spread, F.greatest(a + c - spread, F.lit(0.0))
    return t.withColumns({"orientation": orientation(F.col("mu20"), F.col("mu11"), F.col("mu02")), "eccentricity": F.when(big > 0, F.sqrt(1 - small / big)).otherwise(0.0), "major": 4 * F.sqrt(big), "minor": 4 * F.sqrt(small)})


def bounding_box(labels: DataFrame, expand: int = 0) -> DataFrame:
    """Inclusive bounding box of each region, enlarged on all sides."""
    box = labels.groupBy(*FRAME, "label").agg(F.min("x").alias("left"), F.min("y").alias("top"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"))
    return box.select(*FRAME, "label", *[(F.col(n) - expand).alias(n) for n in ("left", "top")], *[(F.col(n) + 2 * expand).alias(n) for n in ("width", "height")])


#: A straight step and a diagonal one.
KINGS = ([(dy, dx, 0 if 0 in (dy, dx) else 1) for dy, dx in kernels.EIGHT], [1.0, ROOT2])


def distance_map(mask: DataFrame, seeds: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Length of the shortest way inside the mask from the seeds (which have 2): straight steps 1, diagonal ones sqrt(2).

    Steps are counted as whole numbers (a, b), so equal lengths are exactly equal; rounds follow the tiles that ways cross.
    With `ends`, a frame stops at the nearest of its end pixels: pixels farther than it have no row, and seeds must be in the mask. Frames
    whose ends cannot be reached are filled.
    """
    if ends is not None:
        seeds = seeds.select(*PIXEL).join(mask.select(*PIXEL), PIXEL, "left_semi")
    found = fields.ways(mask, seeds, KINGS, 2.0).select(*PIXEL, F.get("counts", F.lit(0)).alias("a"), F.get("counts", F.lit(1)).alias("b"), "d")
    if ends is None:
        return found
    reached = found.join(ends.select(*PIXEL).distinct(), PIXEL).groupBy(*FRAME).agg(F.min("d").alias("reached"))
    return found.join(reached, FRAME, "left").where("reached is null or d <= reached").drop("reached")


def steepest(dist: DataFrame) -> DataFrame:
    """Each pixel's best descent (ny, nx): the neighbour with the largest drop by length, first in row order if tied; null at the bottom."""
    own = dist.select(*PIXEL, F.col("d").alias("own"))
    far = kernels.spread(dist.select(*PIXEL, "d"), kernels.EIGHT).join(own, PIXEL)
    bent = (F.col("oy") != F.col("y")) & (F.col("ox") != F.col("x"))
    drop = F.round((F.col("own") - F.col("d")) / F.when(bent, ROOT2).otherwise(1.0), 9)
    rank = F.struct(drop.alias("drop"), (-F.col("oy")).alias("my"), (-F.col("ox")).alias("mx"))
    best = far.groupBy(*PIXEL).agg(F.max(rank).alias("r")).where("r.drop > 0")
    return dist.select(*PIXEL).join(best.select(*PIXEL, (-F.col("r.my")).alias("ny"), (-F.col("r.mx")).alias("nx")), PIXEL, "left")


def walk(starts: DataFrame, links: DataFrame) -> DataFrame:
    """All pixels on the ways from `starts` along (ny, nx), with `pos` from 0: the reach doubles each round."""
    path = cut(starts.select(*PIXEL).withColumn("pos", F.lit(0).cast("long")))
    jump, reach = cut(links.where("ny is not null").select(*PIXEL, "ny", "nx")), 1
    while True:
        ahead = path.join(jump, PIXEL).select(*FRAME, F.col("ny").alias("y"), F.col("nx").alias("x"), (F.col("pos") + reach).alias("pos"))
        path, known = cut(path.unionByName(ahead).groupBy(*PIXEL).agg(F.min("pos").alias("pos"))), path.count()
        if path.count() == known:
            return path
        second = jump.select(*FRAME, F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("ny").alias("my"), F.col("nx").alias("mx"))
        jump = cut(jump.join(second, [*FRAME, "ny", "nx"]).select(*PIXEL, F.col("my").alias("ny"), F.col("mx").alias("nx")))
        reach *= 2


def farthest_pixel(dist: DataFrame) -> DataFrame:
    """The pixel of each frame farthest from its seeds; the last in row order if tied."""
    best = dist.groupBy(*FRAME).agg(F.max(F.struct(F.round("d", 9).alias("d"), "y", "x")).alias("m"))
    return best.select(*FRAME, F.col("m.y").alias("y"), F.col("m.x").alias("x"), F.col("m.d").alias("d"))


def farthest_pair(mask: DataFrame, seeds: DataFrame) -> DataFrame:
    """Ends of a longest way: sweeps from the farthest pixel until the distance stops growing; y1, x1, y2, x2, d. Pixels are packed into tiles once, for all sweeps."""
    boxes = cut(fields.tiles(mask, seeds))
    sweep = lambda starts: farthest_pixel(fields.farthest(boxes, starts, KINGS, 2.0))
    best = cut(seeds.select(*FRAME, F.col("y").alias("y1"), F.col("x").alias("x1")).join(sweep(seeds), FRAME).select(*FRAME, "y1", "x1", F.col("y").alias("y2"), F.col("x").alias("x2"), "d"))
    done = best.where("false")
    while best.take(1):
        again = sweep(best.select(*FRAME, F.col("y2").alias("y"), F.col("x2").alias("x"))).select(*FRAME, F.col("y").alias("y3"), F.col("x").alias("x3"), F.col("d").alias("d3"))
        both = cut(best.join(again, FRAME))
        done = done.unionByName(both.where("d3 <= d").select(*best.columns))
        best = both.where("d3 > d").select(*FRAME, F.col("y2").alias("y1"), F.col("x2").alias("x1"), F.col("y3").alias("y2"), F.col("x3").alias("x2"), F.col("d3").alias("d"))
    return cut(done)


def farthest_path(mask: DataFrame, seeds: DataFrame) -> DataFrame:
    """The pixels of a longest way between two pixels of each frame's mask, with `pos` from its second end."""
    pair = cut(farthest_pair(mask, seeds))
    dist = distance_map(mask, pair.select(*FRAME, F.col("y1").alias("y"), F.col("x1").alias("x")))
    return walk(pair.select(*FRAME, F.col("y2").alias("y"), F.col("x2").alias("x")), steepest(dist))


#: Steps of the 5x5 chamfer metric along an axis, a diagonal, and a knight's move.
AXIS, DIAGONAL, KNIGHT = 1.0, 1.4, 2.1969


CHAMFER = ([(dy, dx, 0 if 0 in (dy, dx) else 1 if abs(dy) == abs(dx) else 2) for dy, dx in kernels.box(2) if math.gcd(dy, dx) == 1], [AXIS, DIAGONAL, KNIGHT])


def background_distance(mask: DataFrame, height: int, width: int) -> DataFrame:
    """Chamfer distance of each mask pixel to the pixels of its frame that are not in the mask; null if there are none."""
    cells = mask.select(*FRAME).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    outside = cells.join(mask.select(*PIXEL), PIXEL, "left_anti")
    return mask.select(*PIXEL).distinct().join(fields.ways(cells, outside, CHAMFER).select(*PIXEL, "d"), PIXEL, "left")
