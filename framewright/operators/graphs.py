"""Skeleton graphs: nodes(node_id, x, y), edges(edge_id, n1, n2[, length]), edge_points(edge_id, i, x, y).

All operators are set-level and keep parallel edges and loops apart by edge_id. Iterations advance all graphs together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import buckets, kernels
from framewright.functions.iterate import connected, cut, order_by_doubling
from framewright.operators import curves, regions


def edge_lengths(edge_points: DataFrame) -> DataFrame:
    return curves.lengths(edge_points.withColumnRenamed("edge_id", "curve_id")).withColumnRenamed("curve_id", "edge_id")


def _rim(places: DataFrame, sx: int, sy: int) -> DataFrame:
    """The places of each cell (cx, cy) than which no other one is farther in both directions."""
    towards = Window.partitionBy("cx", "cy").orderBy((F.col("x") * sx).desc(), (F.col("y") * sy).desc())
    before = F.max(F.col("y") * sy).over(towards.rowsBetween(Window.unboundedPreceding, -1))
    return places.withColumn("before", before).where(F.col("before").isNull() | (F.col("y") * sy > F.col("before"))).drop("before")


def merge_nodes(nodes: DataFrame, tolerance: float) -> DataFrame:
    """node_id and `kept`: the least id of the nodes that are connected by steps of at most `tolerance` on either axis.

    Cells are a little smaller than half the tolerance, so all nodes of a cell and of its eight neighbours are connected, and a cell goes on as one
    node. Whether cells farther apart are connected is seen from the rims that they turn to each other, of places, not of nodes.
    """
    finite = " and ".join(f"abs({c}) < double('inf')" for c in "xy")
    size = tolerance / 2 * (1 - 1e-9)
    cell = {f"c{c}": buckets.cell(F.col(c), size) if size > 0 else F.col(c) for c in "xy"}
    known = cut(nodes.where(finite).select("node_id", "x", "y").withColumns(cell))
    cells = cut(known.groupBy("cx", "cy").agg(F.min("node_id").alias("node")))
    places = cut(known.select("cx", "cy", "x", "y").distinct().join(cells, ["cx", "cy"]))

    def moved(rows: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
        steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets])
        return rows.withColumn("o", F.explode(steps)).withColumns({"cx": F.col("cx") + F.col("o.a"), "cy": F.col("cy") + F.col("o.b")}).drop("o")

    links = cells.where("false").select(F.col("node").alias("a"), F.col("node").alias("b"))
    if size > 0:
        links = moved(cells.withColumnRenamed("node", "a"), [(1, 0), (0, 1), (1, 1), (-1, 1)]).join(cells.withColumnRenamed("node", "b"), ["cx", "cy"]).select("a", "b")
        for sx in (1, -1):
            here = moved(_rim(places, sx, 1), [(sx * i, j) for i in range(4) for j in range(4) if max(i, j) > 1])
            there = _rim(places, -sx, -1).select("cx", "cy", F.col("x").alias("mx"), F.col("y").alias("my"), F.col("node").alias("b"))
            met = here.join(there, ["cx", "cy"]).where((F.abs(F.col("x") - F.col("mx")) <= tolerance) & (F.abs(F.col("y") - F.col("my")) <= tolerance))
            links = links.unionByName(met.select(F.col("node").alias("a"), "b").distinct())
    kept = cells.join(connected(cells.select("node"), links), "node").select("cx", "cy", F.col("label").alias("kept"))
    joined = known.join(kept, ["cx", "cy"]).select("node_id", "kept")
    return joined.unionByName(nodes.where(f"not coalesce({finite}, false)").select("node_id", F.col("node_id").alias("kept")))


def add_edges(nodes: DataFrame, edges: DataFrame, edge_points: DataFrame, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Edges whose curve ends lie on their nodes: (edge_id, n1, n2, flipped, length), and the rejected edge ids (ends elsewhere, a node
    unknown, no curve). Lengths up to 1e-6 are dropped."""
    e = curves.ends(edge_points.withColumnRenamed("edge_id", "curve_id")).withColumnRenamed("curve_id", "edge_id")
    a, b = (nodes.select(F.col("node_id").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y")) for n in ("n1", "n2"))
    known = edges.join(e, "edge_id", "left").join(a, "n1", "left").join(b, "n2", "left").join(edge_lengths(edge_points), "edge_id", "left")

    def on(node: str, end: str):
        return (F.abs(F.col(f"{node}x") - F.col(f"x{end}")) <= tolerance) & (F.abs(F.col(f"{node}y") - F.col(f"y{end}")) <= tolerance)

    straight, flipped = on("n1", "0") & on("n2", "1"), on("n1", "1") & on("n2", "0")
    judged = known.select("edge_id", "n1", "n2", F.when(straight, False).when(flipped, True).alias("flipped"), "length")
    return judged.where("flipped is not null and length > 1e-6"), judged.where("flipped is null").select("edge_id")


def degrees(edges: DataFrame) -> DataFrame:
    """Degree of every node that has edges; a loop counts twice."""
    return edges.select(F.col("n1").alias("node_id")).unionByName(edges.select(F.col("n2").alias("node_id"))).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def prune(edges: DataFrame, shortest: float, protected: DataFrame | None = None) -> DataFrame:
    """Drops leaf edges and loops shorter than `shortest` in rounds until none is left; edges with a protected node (node_id) at either end stay."""
    now = cut(edges)
    short = now.where(F.col("length") < shortest).select("edge_id", "n1", "n2")
    if protected is not None:
        held = short.select("edge_id", F.explode(F.array("n1", "n2")).alias("node_id")).join(protected.select("node_id"), "node_id", "left_semi")
        short = cut(short.join(held.select("edge_id").distinct(), "edge_id", "left_anti"))
    able = short.select("edge_id")
    while True:
        may = now.join(able, "edge_id", "left_semi") if protected is not None else now.where(F.col("length") < shortest)
        leaf = degrees(now).where(F.col("degree") == 1).select("node_id")
        ends = may.where("n1 <> n2").select("edge_id", F.explode(F.array("n1", "n2")).alias("node_id")).join(leaf, "node_id", "left_semi").select("edge_id")
        short = cut(ends.distinct().unionByName(may.where("n1 = n2").select("edge_id")))
        if not short.take(1):
            return now
        now = cut(now.join(short, "edge_id", "left_anti"))


def left_nodes(nodes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """The nodes without those that lost their last edge, one to another node, from `before` to `after`."""
    had = degrees(before.where("n1 <> n2")).select("node_id")
    return nodes.join(had.join(degrees(after).select("node_id"), "node_id", "left_anti"), "node_id", "left_anti")


def _arcs(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: edge_id, turned, start, stop."""
    ways = F.array(F.struct(F.lit(False).alias("turned"), F.col("n1").alias("start"), F.col("n2").alias("stop")), F.struct(F.lit(True).alias("turned"), F.col("n2").alias("start"), F.col("n1").alias("stop")))
    return edges.select("edge_id", F.explode(ways).alias("w")).select("edge_id", "w.*")


def _inner_nodes(edges: DataFrame) -> DataFrame:
    """node_id of the nodes that contraction removes.

    These have two edges that lead to different neighbours. Where all between two ends would go and leave a loop, the least node of the
    chain stays; of a ring the two least stay, as then both edges of a node lead to one neighbour.
    """
    arcs = _arcs(edges)
    inner = cut(arcs.groupBy(F.col("start").alias("node_id")).agg(F.count(F.lit(1)).alias("n"), F.min("stop").alias("o1"), F.max("stop").alias("o2"), F.min("edge_id").alias("a"), F.max("edge_id").alias("b")).where("n = 2 and o1 <> o2 and a <> b and o1 <> node_id and o2 <> node_id"))
    chains = cut(connected(inner.select(F.explode(F.array("a", "b")).alias("node")).distinct(), inner.select("a", "b")))
    placed = inner.join(chains, inner["a"] == chains["node"]).select("node_id", "label")
    ends = arcs.join(chains, arcs["edge_id"] == chains["node"]).join(inner.select(F.col("node_id").alias("stop")), "stop", "left_anti")
    outer = ends.groupBy("label").agg(F.count_distinct("stop").alias("ends"))
    spare = F.coalesce(F.when(F.col("ends") == 1, 1).when(F.col("ends") > 1, 0), F.lit(2))
    ranked = placed.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("node_id"))).join(outer, "label", "left")
    return ranked.where(F.col("place") > spare).select("node_id")


def contract(edges: DataFrame, edge_points: DataFrame | None = None, epsilon: float = 0.0) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Merges chains of edges through nodes of degree 2: edge_id becomes the least of the chain, n1 <= n2 its outer nodes, length the sum.

    Nodes whose two edges lead to one neighbour, and loops, are left alone. With `edge_points` (edge_id, i, x, y; i from 0) the
    second result is the curves of the merged edges from n1 to n2, joints twice, with `epsilon` simplified; lengths are then those of the curves.
    Edges without an end at a removed node are chains of their own; only the others go through rounds.
    """
    edges = cut(edges.select("edge_id", "n1", "n2", "length"))
    gone = cut(_inner_nodes(edges))
    at = [edges.join(gone.select(F.col("node_id").alias(n)), n, "left_semi").select("edge_id") for n in ("n1", "n2")]
    touched = cut(at[0].unionByName(at[1]).distinct())
    alone = edges.join(touched, "edge_id", "left_anti")
    alone = alone.select(F.col("edge_id").alias("chain"), F.least("n1", "n2").alias("n1"), F.greatest("n1", "n2").alias("n2"), F.lit(0).cast("long").alias("pos"), "edge_id", (F.col("n1") >= F.col("n2")).alias("turned"), "length")
    arcs = cut(_arcs(edges.join(touched, "edge_id", "left_semi")).join(gone.select(F.col("node_id").alias("stop"), F.lit(True).alias("goes_on")), "stop", "left"))
    arc = F.struct("edge_id", "turned")
    ahead = arcs.select(F.col("start").alias("stop"), F.col("edge_id").alias("e2"), arc.alias("next"))
    on = arcs.where("goes_on").select("stop", "edge_id", arc.alias("node")).join(ahead, "stop").where("edge_id <> e2").select("node", "next")
    last = arcs.where("goes_on is null").select(arc.alias("node"))
    ordered = order_by_doubling(on.unionByName(last.withColumn("next", F.lit(None).cast(on.schema["next"].dataType))), [])
    ways = ordered.groupBy("head").agg(F.min("node.edge_id").alias("chain"), F.max(F.struct("rank", "node")).alias("first"))
    ends = arcs.select(arc.alias("head"), F.col("stop").alias("n2"))
    starts = arcs.select(arc.alias("node"), F.col("start").alias("n1"))
    ways = ways.join(ends, "head").select("chain", "head", F.col("first.node").alias("node"), F.col("first.rank").alias("most"), "n2").join(starts, "node")
    best = ways.groupBy("chain").agg(F.max(F.struct("n2", "head", "n1", "most")).alias("w")).select("chain", "w.*")
    members = cut(ordered.join(best, "head").select("chain", "n1", "n2", (F.col("most") - F.col("rank")).alias("pos"), "node.edge_id", "node.turned"))
    merged = members.join(edges.select("edge_id", "length"), "edge_id").groupBy(F.col("chain").alias("edge_id")).agg(F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.sum("length").alias("length"))
    merged = merged.unionByName(alone.select("edge_id", "n1", "n2", "length"))
    if edge_points is None:
        return merged
    sizes = members.unionByName(alone.drop("length")).join(edge_points.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n")), "edge_id")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("chain").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sizes.withColumn("before", before).select("chain", "edge_id", "turned", "n", "before").join(edge_points, "edge_id")
    index = F.col("before") + F.when(F.col("turned"), F.col("n") - 1 - F.col("i")).otherwise(F.col("i"))
    curve = placed.select(F.col("chain").alias("edge_id"), index.cast("int").alias("i"), "x", "y")
    if epsilon:
        curve = curves.simplify(curve.withColumnRenamed("edge_id", "curve_id"), epsilon).withColumnRenamed("curve_id", "edge_id")
    curve = cut(curve)
    return merged.drop("length").join(edge_lengths(curve), "edge_id", "left"), curve


def split_edges(edge_points: DataFrame, splits: DataFrame) -> DataFrame:
    """Splits curves at given inner vertices (edge_id, i): edge_id, part, i, x, y; the joint belongs to both parts."""
    marked = edge_points.join(splits.distinct().withColumn("cut", F.lit(1)), ["edge_id", "i"], "left")
    by_edge = Window.partitionBy("edge_id").orderBy("i")
    earlier, at_cut = by_edge.rowsBetween(Window.unboundedPreceding, -1), F.col("cut") == 1
    marked = marked.withColumns({"before": F.coalesce(F.sum("cut").over(earlier), F.lit(0).cast("long")), "place": F.row_number().over(by_edge)})
    since = F.col("place") - F.coalesce(F.max(F.when(at_cut, F.col("place"))).over(earlier), F.lit(1))  # steps from the last joint
    marked = marked.withColumn("since", since)
    own, next_ = F.struct(F.col("before").alias("part"), F.col("since").alias("i")), F.struct((F.col("before") + 1).alias("part"), F.lit(0).alias("i"))
    parts = marked.withColumn("p", F.explode(F.when(at_cut, F.array(own, next_)).otherwise(F.array(own))))
    return parts.select("edge_id", F.col("p.part").cast("int").alias("part"), F.col("p.i").alias("i"), "x", "y")


def nearest_nodes(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Nearest node of each query (query_id, qx, qy): node_id, x, y, dist; the smaller id if tied. Of nodes in one place only the first is searched."""
    dist = F.sqrt(F.pow(F.col("x") - F.col("qx"), F.lit(2)) + F.pow(F.col("y") - F.col("qy"), F.lit(2)))
    places = nodes.groupBy("x", "y").agg(F.min("node_id").alias("node_id"))
    best = buckets.nearest(queries, places, F.struct(F.round(dist, 9).alias("dist"), "node_id", "x", "y"))
    return best.select("query_id", "best.node_id", "best.x", "best.y", "best.dist")


def _pieces(segments: DataFrame, lines: int = 32) -> DataFrame:
    """Segments (x, y, x2, y2, edge_id) cut at the lines of a grid of `lines` cells along the longer side of all: one row a place, the least edge_id."""
    segments = cut(segments)
    e = segments.agg(*[F.max(F.greatest(a, b)) - F.min(F.least(a, b)) for a, b in (("x", "x2"), ("y", "y2"))]).first()
    size = max(e[0] or 0.0, e[1] or 0.0) / lines or 1.0

    def crossings(a: str, b: str):
        """Shares of the segment at which it crosses the lines of one axis."""
        low, high = F.floor(F.least(a, b) / size) + 1, F.ceil(F.greatest(a, b) / size) - 1
        none = F.array().cast("array<double>")
        return F.when(low <= high, F.transform(F.sequence(low, high), lambda k: (k * size - F.col(a)) / (F.col(b) - F.col(a)))).otherwise(none)

    shares = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), crossings("x", "x2"), crossings("y", "y2"))))
    parts = segments.withColumn("t", F.explode(F.array(shares))).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("t") - 1)))
    t0, t1 = F.get("t", F.col("k") - 1), F.get("t", F.col("k"))

    def at(a: str, b: str, t):
        """A coordinate at a share; on a grid line exactly, so that pieces of overlapping segments are equal."""
        inner = F.col(a) + t * (F.col(b) - F.col(a))
        line = F.round(inner / size) * size
        return F.when(t == 0, F.col(a)).when(t == 1, F.col(b)).when(F.abs(inner - line) < 1e-9 * size, line).otherwise(inner)

    placed = parts.select("edge_id", at("x", "x2", t0).alias("x"), at("y", "y2", t0).alias("y"), at("x", "x2", t1).alias("x2"), at("y", "y2", t1).alias("y2"))
    turned = (F.col("x2") < F.col("x")) | ((F.col("x2") == F.col("x")) & (F.col("y2") < F.col("y")))
    ends = [F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("x", "x2"), ("y", "y2"), ("x2", "x"), ("y2", "y"))]
    return placed.select("edge_id", *ends).groupBy("x", "y", "x2", "y2").agg(F.min("edge_id").alias("edge_id"))


def nearest_edges(edge_points: DataFrame, queries: DataFrame) -> DataFrame:
    """Nearest edge of each query by distance to its line, then that edge's nearest vertex: edge_id, i, dist (to the vertex).

    Segments are cut at the lines of a grid, so that long ones have small boxes; of pieces in the same place only that of the smallest edge
    id, which wins the tie, is searched.
    """
    seg = _pieces(curves.segments(edge_points.withColumnRenamed("edge_id", "curve_id")).groupBy("x", "y", "x2", "y2").agg(F.min("curve_id").alias("edge_id")))
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("qx") - F.col("x")) * dx + (F.col("qy") - F.col("y")) * dy) / square))).otherwise(0.0)
    dist = F.round(F.sqrt(F.pow(F.col("x") + t * dx - F.col("qx"), F.lit(2)) + F.pow(F.col("y") + t * dy - F.col("qy"), F.lit(2))), 9)
    boxes = cut(seg.withColumns({"x0": F.least("x", "x2"), "y0": F.least("y", "y2"), "x1": F.greatest("x", "x2"), "y1": F.greatest("y", "y2")}))
    best = buckets.nearest(queries, boxes, F.struct(dist.alias("dist"), "edge_id"), box=("x0", "y0", "x1", "y1")).select("query_id", F.col("best").alias("m"))
    chosen = queries.join(best, "query_id").select("query_id", "qx", "qy", "m.edge_id").join(edge_points, "edge_id")
    vertex = F.round(F.sqrt(F.pow(F.col("x") - F.col("qx"), F.lit(2)) + F.pow(F.col("y") - F.col("qy"), F.lit(2))), 9)
    return chosen.groupBy("query_id", "edge_id").agg(F.min(F.struct(vertex.alias("d"), "i")).alias("m")).select("query_id", "edge_id", F.col("m.i").alias("i"), F.col("m.d").alias("dist"))


def connect(edge_points: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attaches each query to its nearest edge: connector curves (query_id, i, x, y) and the edges split at the joints."""
    joints = nearest_edges(edge_points, queries)
    at = joints.join(edge_points, ["edge_id", "i"]).select("query_id", F.lit(1).alias("i"), "x", "y")
    connectors = queries.select("query_id", F.lit(0).alias("i"), F.col("qx").alias("x"), F.col("qy").alias("y")).unionByName(at)
    last = edge_points.groupBy("edge_id").agg(F.max("i").alias("last"))
    inner = joints.join(last, "edge_id").where("i > 0 and i < last").select("edge_id", "i")
    return connectors, split_edges(edge_points, inner)


def total_length(edges: DataFrame) -> DataFrame:
    return edges.agg(F.sum("length").alias("length"))


def points_on_edges(edge_points: DataFrame, wanted: DataFrame) -> DataFrame:
    """The vertices with the wanted numbers (edge_id, i); negative ones count from the end."""
    sizes = edge_points.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n"))
    asked = wanted.join(sizes, "edge_id").select("edge_id", F.col("i").alias("asked"), F.when(F.col("i") < 0, F.col("i") + F.col("n")).otherwise(F.col("i")).alias("i"))
    return edge_points.join(asked, ["edge_id", "i"]).select("edge_id", F.col("asked").alias("i"), "x", "y")


def single_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The edge between each pair of nodes (a, b) and the number of such edges; edge_id is null where there are several."""
    key = edges.select("edge_id", F.least("n1", "n2").alias("lo"), F.greatest("n1", "n2").alias("hi"))
    want = pairs.select("a", "b", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    found = want.join(key, ["lo", "hi"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("edge_id").alias("edge_id"))
    return found.select("a", "b", "n", F.when(F.col("n") == 1, F.col("edge_id")).alias("edge_id"))


def skeleton_graph(skeleton: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graph of skeleton pixels: nodes (video_id, frame_idx, node, x, y), edges (..., edge, n1, n2, n_pixels, length), points (..., edge, i, x, y).

    Pixels with two neighbours form chains; all others cluster into nodes at their mean place, and a ring of chain pixels has its first
    pixel as node. A chain pixel has two neighbours in all, so a chain touches two node pixels at most. A curve runs from the centre of
    n1 through the chain's pixels, ordered by pointer doubling over the steps from pixel to pixel, to the centre of n2 (n1 <= n2).
    """
    keys = regions.FRAME
    own = (F.col("oy") == F.col("y")) & (F.col("ox") == F.col("x"))
    near = cut(kernels.spread(kernels.by_frame(skeleton.select(*regions.PIXEL)), kernels.box(1)))
    counts = cut(near.groupBy(*regions.PIXEL).agg((F.count(F.lit(1)) - 1).alias("n"), F.max(own).alias("own")).where("own").select(*regions.PIXEL, "n"))
    chains = cut(regions.label(counts.where("n = 2"), kernels.EIGHT))
    ends = counts.where("n <> 2").select(*keys, F.col("y").alias("oy"), F.col("x").alias("ox"))
    touched = near.join(ends, [*keys, "oy", "ox"], "left_semi").join(chains, regions.PIXEL).select(*keys, "label").distinct()
    first = chains.join(touched, [*keys, "label"], "left_anti").groupBy(*keys, "label").agg(F.min(F.struct("y", "x")).alias("p")).select(*keys, "p.y", "p.x")
    clusters = cut(regions.label(counts.where("n <> 2").select(*regions.PIXEL).unionByName(first), kernels.EIGHT).withColumnRenamed("label", "node"))
    nodes = cut(clusters.groupBy(*keys, "node").agg(F.avg("x").alias("x"), F.avg("y").alias("y")))
    cell = {n: (F.col(y).cast("long") * (1 << 20) + F.col(x)).alias(n) for n, y, x in (("p", "y", "x"), ("q", "oy", "ox"))}
    inner = chains.join(first, regions.PIXEL, "left_anti").select(*keys, cell["p"], "label", "y", "x")
    around = cut(near.where(~own).select(*keys, cell["p"], cell["q"]).join(inner.select(*keys, "p"), [*keys, "p"], "left_semi"))
    steps = around.select(*keys, "p", F.col("q").alias("u")).join(around, [*keys, "p"]).where("u <> q")
    steps = steps.select(*keys, F.struct(F.col("u").alias("p"), F.col("p").alias("q")).alias("node"), F.struct("p", "q").alias("next"))
    stops = around.join(inner.select(*keys, F.col("p").alias("q")), [*keys, "q"], "left_anti").select(*keys, F.struct("p", "q").alias("node"))
    ordered = order_by_doubling(steps.unionByName(stops.withColumn("next", F.lit(None).cast(steps.schema["next"].dataType))), keys)
    named = clusters.select(*keys, cell["p"].alias("at"), "node")
    heads = stops.select(*keys, F.col("node").alias("head"), F.col("node.p").alias("p"), F.col("node.q").alias("at")).join(named, [*keys, "at"]).join(inner.select(*keys, "p", "label"), [*keys, "p"])
    best = heads.groupBy(*keys, "label").agg(F.min("node").alias("n1"), F.max("node").alias("n2"), F.max(F.struct("node", "head")).alias("w")).select(*keys, F.col("label").alias("edge"), "n1", "n2", F.col("w.head").alias("head"))
    best = cut(best)
    on = cut(ordered.where("rank > 0").join(best, [*keys, "head"]).select(*keys, "edge", F.col("node.q").alias("p"), "rank"))
    sizes = on.groupBy(*keys, "edge").agg(F.count(F.lit(1)).alias("n_pixels"))
    edges = best.drop("head").join(sizes, [*keys, "edge"])
    middle = on.join(inner.drop("label"), [*keys, "p"]).join(sizes, [*keys, "edge"]).select(*keys, "edge", (F.col("n_pixels") + 1 - F.col("rank")).cast("int").alias("i"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    outer = edges.select(*keys, "edge", F.explode(F.array(F.struct(F.lit(0).alias("i"), F.col("n1").alias("node")), F.struct((F.col("n_pixels") + 1).cast("int").alias("i"), F.col("n2").alias("node")))).alias("e")).select(*keys, "edge", "e.*")
    points = cut(middle.unionByName(outer.join(nodes, [*keys, "node"]).select(*keys, "edge", "i", "x", "y")))
    by_edge = Window.partitionBy(*keys, "edge").orderBy("i")
    lengths = points.withColumn("d", F.hypot(F.lead("x").over(by_edge) - F.col("x"), F.lead("y").over(by_edge) - F.col("y"))).groupBy(*keys, "edge").agg(F.sum("d").alias("length"))
    return nodes, edges.join(lengths, [*keys, "edge"]), points


def one_graph(nodes: DataFrame, edges: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graphs of all frames as one: nodes (node_id, x, y), edges (edge_id, n1, n2, length), edge_points (edge_id, i, x, y), ids as text."""

    def name(column: str):
        return F.concat_ws(".", *regions.FRAME, column)

    flat = edges.select(name("edge").alias("edge_id"), name("n1").alias("n1"), name("n2").alias("n2"), "length")
    return nodes.select(name("node").alias("node_id"), "x", "y"), flat, points.select(name("edge").alias("edge_id"), "i", "x", "y")
