"""Hand-made cases of what the operators are defined to do, and brute force for graphs and nearest joins."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from framewright.functions import buckets, iterate
from framewright.operators import composites, compose, curves, frames, graphs, regions, shapes
from framewright.sources import catalog
from framewright.streaming import streams

PIXEL = "video_id long, frame_idx long, y int, x int"


def drawn(spark, rows, frame=0):
    cells = [(1, frame, y, x) for y, row in enumerate(rows) for x, c in enumerate(row) if c != "."]
    return spark.createDataFrame(cells, PIXEL)


def test_highlight_lifts_to_strength(spark):
    pixels = spark.createDataFrame([(1, 0, 0, x, v) for x, v in enumerate((0, 100, 255, 7))], f"{PIXEL}, v int")
    mask = pixels.where("x < 3").select("video_id", "frame_idx", "y", "x")
    got = [r["v"] for r in compose.highlight(pixels, mask, 100).orderBy("x").collect()]
    assert got == [100, 100 + 155 * 100 // 255, 255, 7]


def test_images_of_other_sizes(spark):
    pixels = spark.createDataFrame([(1, 0, 0, x, 250) for x in range(3)], f"{PIXEL}, v int")
    small = pixels.where("x < 2").withColumn("v", F.lit(10))
    assert [r["v"] for r in compose.add(pixels, small).orderBy("x").collect()] == [255, 255, 250]
    assert [r["v"] for r in compose.blend(pixels, small, 0.5).orderBy("x").collect()] == [130, 130, 250]
    assert [r["x"] for r in compose.unmatched(pixels, small).collect()] == [2]


def test_peaks_below_zero_and_in_the_background(spark):
    field = {(2, 2): -1, (0, 5): 3}
    values = [(1, 0, y, x, field.get((y, x), -5 if x < 4 else 0)) for y in range(6) for x in range(9)]
    got = {(r["y"], r["x"]) for r in regions.peaks(spark.createDataFrame(values, f"{PIXEL}, v int"), 6, 9).collect()}
    assert (2, 2) in got and (0, 5) in got and (3, 7) not in got and (5, 8) not in got
    assert (3, 4) in got  # at the rim of the zero background: equal to its maximum, and not all is zero around it


def test_protected_ends_keep_edges(spark):
    edges = spark.createDataFrame([(1, 1, 2, 0.5), (2, 2, 3, 9.0), (3, 3, 3, 0.5), (4, 3, 4, 0.5)], "edge_id long, n1 long, n2 long, length double")
    assert {r["edge_id"] for r in graphs.prune(edges, 1.0).collect()} == {2}
    assert {r["edge_id"] for r in graphs.prune(edges, 1.0, spark.createDataFrame([(2,)], "node_id long")).collect()} == {1, 2}
    assert {r["edge_id"] for r in graphs.prune(edges, 1.0, spark.createDataFrame([(3,)], "node_id long")).collect()} == {2, 3, 4}
    nodes = spark.createDataFrame([(n, 0.0, 0.0) for n in range(1, 6)], "node_id long, x double, y double")
    assert {r["node_id"] for r in graphs.left_nodes(nodes, edges, graphs.prune(edges, 1.0)).collect()} == {2, 3, 5}


def test_edges_with_unknown_nodes_are_rejected(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0)], "node_id long, x double, y double")
    edges = spark.createDataFrame([(1, 1, 2), (2, 1, 7), (3, 2, 1), (4, 1, 2)], "edge_id long, n1 long, n2 long")
    points = spark.createDataFrame([(e, i, float(i), 0.0) for e in (1, 2, 3) for i in (0, 1)], "edge_id long, i int, x double, y double")
    good, bad = graphs.add_edges(nodes, edges, points)
    assert {(r["edge_id"], r["flipped"]) for r in good.collect()} == {(1, False), (3, True)}
    assert {r["edge_id"] for r in bad.collect()} == {2, 4}


def check_graph(spark, mask):
    """Every chain pixel lies on exactly one curve, whose steps go to neighbours; returns the edges."""
    cells = {(r["y"], r["x"]) for r in mask.collect()}
    around = {c: [(c[0] + a, c[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (c[0] + a, c[1] + b) in cells] for c in cells}
    nodes, edges, points = (f.collect() for f in graphs.skeleton_graph(mask))
    places = {r["node"]: (r["x"], r["y"]) for r in nodes}
    lines = {}
    for r in sorted(points, key=lambda r: (r["edge"], r["i"])):
        lines.setdefault(r["edge"], []).append((r["x"], r["y"]))
    on_curves = [p for line in lines.values() for p in line[1:-1]]
    chain = {c for c in cells if len(around[c]) == 2}
    assert len(on_curves) == len(set(on_curves)) and {(int(y), int(x)) for x, y in on_curves} <= chain
    for r in edges:
        line = lines[r["edge"]]
        assert line[0] == places[r["n1"]] and line[-1] == places[r["n2"]] and r["n1"] <= r["n2"] and len(line) == r["n_pixels"] + 2
        assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(line[1:-1], line[2:-1]))
        assert math.isclose(r["length"], sum(math.dist(a, b) for a, b in zip(line, line[1:])))
    return edges, len(chain) - len(on_curves)


def test_skeleton_graphs(spark):
    edges, left = check_graph(spark, drawn(spark, ["#....#", ".#..#.", "..##..", "..#...", "..#...", "..#...", "..#..."]))
    assert len(edges) == 3 and left == 0
    ring = drawn(spark, [".##.", "#..#", "#..#", ".##."])
    edges, left = check_graph(spark, ring)
    assert len(edges) == 1 and left == 1 and edges[0]["n1"] == edges[0]["n2"] and edges[0]["n_pixels"] == 7
    edges, left = check_graph(spark, drawn(spark, ["#"]))
    assert edges == [] and left == 0


@pytest.mark.parametrize("seed", range(2))
def test_skeleton_graphs_of_noise(spark, seed):
    rng = random.Random(seed)
    cells = [(1, 0, y, x) for y in range(14) for x in range(14) if rng.random() < 0.3]
    check_graph(spark, spark.createDataFrame(cells, PIXEL))


def test_contraction_of_chains_loops_and_rings(spark):
    rows = [(1, 1, 2, 1.0), (2, 3, 2, 2.0), (3, 3, 4, 4.0)]  # a path of three edges
    rows += [(11, 10, 12, 1.0), (12, 12, 13, 1.0), (13, 13, 10, 1.0), (14, 10, 19, 1.0)]  # a loop at node 10: one of its nodes stays
    rows += [(21, 21, 22, 1.0), (22, 22, 23, 2.0), (23, 23, 24, 4.0), (24, 24, 21, 8.0)]  # a ring: two nodes stay
    rows += [(31, 31, 32, 1.0), (32, 32, 31, 1.0), (41, 41, 41, 1.0)]  # parallel edges and a loop are left alone
    edges = spark.createDataFrame(rows, "edge_id long, n1 long, n2 long, length double")
    got = {(r["edge_id"], r["n1"], r["n2"], r["length"]) for r in graphs.contract(edges).collect()}
    assert got == {(1, 1, 4, 7.0), (11, 10, 12, 1.0), (12, 10, 12, 2.0), (14, 10, 19, 1.0), (21, 21, 22, 1.0), (22, 21, 22, 14.0), (31, 31, 32, 1.0), (32, 31, 32, 1.0), (41, 41, 41, 1.0)}
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0), (2, 0, 3.0, 0.0), (2, 1, 2.0, 0.0), (2, 2, 1.0, 0.0), (3, 0, 3.0, 0.0), (3, 1, 3.0, 4.0)], "edge_id long, i int, x double, y double")
    merged, curve = graphs.contract(edges.where("edge_id < 4"), points)
    assert [(r["x"], r["y"]) for r in curve.orderBy("i").collect()] == [(0, 0), (1, 0), (1, 0), (2, 0), (3, 0), (3, 0), (3, 4)]
    assert [(r["n1"], r["n2"], r["length"]) for r in merged.collect()] == [(1, 4, 7.0)]
    _, plain = graphs.contract(edges.where("edge_id < 4"), points, 0.1)
    assert {(r["x"], r["y"]) for r in plain.collect()} == {(0, 0), (3, 0), (3, 4)}


@pytest.mark.parametrize("spread", (0.0, 1.0, 1e6))
def test_nearest_against_brute_force(spark, spread):
    rng = random.Random(7)
    points = [(i, rng.gauss(0, 1) * spread, rng.gauss(0, 1) * spread) for i in range(700)] + [(900 + i, 5.0, 5.0) for i in range(300)]
    asked = [(q, rng.uniform(-50, 50), rng.uniform(-50, 50)) for q in range(60)] + [(99, None, 1.0)]
    got = graphs.nearest_nodes(spark.createDataFrame(points, "node_id long, x double, y double"), spark.createDataFrame(asked, "query_id long, qx double, qy double")).collect()
    assert len(got) == 60
    for r in got:
        q = asked[r["query_id"]]
        assert (r["dist"], r["node_id"]) == min((round(math.dist(q[1:], p[1:]), 9), p[0]) for p in points)


def test_nearest_goes_down_many_levels(spark):
    points = [(i, (i % 70) / 7, (i // 70) / 7) for i in range(4900)]
    asked = [(q, q * 0.37 - 3, q * 0.21) for q in range(40)]
    dist = F.sqrt(F.pow(F.col("x") - F.col("qx"), F.lit(2)) + F.pow(F.col("y") - F.col("qy"), F.lit(2)))
    frame = spark.createDataFrame(points, "node_id long, x double, y double")
    best = buckets.nearest(spark.createDataFrame(asked, "query_id long, qx double, qy double"), frame, F.struct(F.round(dist, 9).alias("dist"), "node_id"), leaf=1)
    got = {r["query_id"]: (r["best"]["dist"], r["best"]["node_id"]) for r in best.collect()}
    assert got == {q[0]: min((round(math.dist(q[1:], p[1:]), 9), p[0]) for p in points) for q in asked}


def test_long_chains_need_few_rounds(spark):
    nodes = spark.range(3000).select(F.col("id").alias("node"))
    chain = nodes.where("node > 0").select(F.col("node").alias("a"), (F.col("node") - 1).alias("b"))
    assert iterate.connected(nodes, chain).where("label <> 0").count() == 0


def test_large_frames(spark, capsys):
    """The plan's size does not follow the frame's, and one exchange serves both passes."""
    texts = []
    for width, height in ((64, 48), (1920, 1080)):
        pixels = spark.createDataFrame([(1, 0, 20, x, 90) for x in range(40)], f"{PIXEL}, v int")
        blurred = frames.blur(pixels, (width, height), 3.0)
        assert math.isclose(blurred.agg(F.sum("v")).first()[0], 90 * 40, rel_tol=0.3)
        assert frames.resize(pixels, (width, height), (width // 4, height // 4), "area").count() >= 9
        capsys.readouterr()
        blurred.explain()
        texts.append(capsys.readouterr().out)
    assert abs(len(texts[0]) - len(texts[1])) < 200 and all(t.count("Exchange hashpartitioning") == 1 for t in texts)


def test_merging_prefers_the_first_orientation(spark):
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0), (2, 0, 1.0, 0.0), (2, 1, 0.0, 0.0)], "curve_id long, i int, x double, y double")
    merged, apart = curves.merge_pairs(points, spark.createDataFrame([(9, 1, 2), (8, 2, 1)], "pair_id long, c1 long, c2 long"))
    assert [r["x"] for r in merged.where("pair_id = 9").orderBy("i").collect()] == [0, 1, 1, 0] and apart.count() == 0


def test_labels_of_a_long_winding_region(spark):
    cells = [(1, 0, y, x) for y in range(0, 40, 2) for x in range(40)] + [(1, 0, y, 39 if y % 4 == 1 else 0) for y in range(1, 39, 2)]
    found = regions.label(spark.createDataFrame([*cells, (1, 1, 5, 5)], PIXEL)).groupBy("frame_idx", "label").count().collect()
    assert {(r["frame_idx"], r["label"], r["count"]) for r in found} == {(0, 1, len(cells)), (1, 1, 1)}


def test_frames_by_number_from_both_ends(spark):
    pixels = spark.createDataFrame([(v, i, 0, 0, 10 * v + i) for v, n in ((1, 3), (2, 5)) for i in range(n)], f"{PIXEL}, v int")
    videos = spark.createDataFrame([(1, 3), (2, 5)], "video_id long, frame_count long")
    wanted = spark.createDataFrame([(0,), (-1,), (3,), (-4,)], "idx long")
    assert {(r["video_id"], r["idx"], r["v"]) for r in frames.get_frames(pixels, videos, wanted).collect()} == {(1, 0, 10), (1, -1, 12), (2, 0, 20), (2, -1, 24), (2, 3, 23), (2, -4, 21)}
    assert {(r["video_id"], r["idx"]) for r in frames.missing_frames(videos, wanted).collect()} == {(1, 3), (1, -4)}


def test_contiguous_files_and_lookups(spark):
    files = spark.createDataFrame([(i, 3) for i in (1, 2, 3, 5, 6)], "idx long, n long")
    assert sorted(r["idx"] for r in catalog.contiguous(files, 2).collect()) == [2, 3]
    assert catalog.contiguous(files, 4).count() == 0 and sorted(r["idx"] for r in catalog.contiguous(files, 5, 5).collect()) == [5]
    wanted = spark.createDataFrame([(0,), (8,), (9,), (14,), (15,)], "frame long")
    assert {tuple(r) for r in catalog.locate(files, wanted).collect()} == {(0, 1, 0), (8, 3, 2), (9, 5, 0), (14, 6, 2)}
    many = spark.range(1, 10_001).select(F.col("id").alias("idx"), F.lit(2).cast("long").alias("n"))
    assert catalog.concatenated(many).where("offset <> 2 * (idx - 1)").count() == 0


def test_many_boxes_meet_pixels_by_cells(spark, monkeypatch):
    rng = random.Random(2)
    pixels = [(1, rng.randrange(20), y, x, rng.randrange(9)) for y in range(12) for x in range(12)]
    boxes = [(i, [rng.randrange(10), rng.randrange(10), rng.randrange(15)], [rng.randrange(1, 6) for _ in range(3)]) for i in range(40)]
    args = spark.createDataFrame(pixels, f"{PIXEL}, v int"), spark.createDataFrame(boxes, "id int, pos array<int>, size array<int>")
    plain = {tuple(r) for r in shapes.cuboid_statistics(*args).collect()}
    monkeypatch.setattr(buckets, "SMALL", 5)
    assert {tuple(r) for r in shapes.cuboid_statistics(*args).collect()} == plain and plain


def test_guo_hall_thins_to_lines(spark):
    bar = {(r["y"], r["x"]) for r in regions.thin_guo_hall(drawn(spark, ["." * 14] + [".############."] * 3 + ["." * 14])).collect()}
    assert bar and {y for y, _ in bar} == {2} and len(bar) >= 9
    line = drawn(spark, ["#...", ".#..", "..#.", "...#"])
    assert regions.thin_guo_hall(line).count() == 4 and regions.thin_guo_hall(line.where("false")).count() == 0
    rng = random.Random(5)
    cells = {(y, x) for y in range(12) for x in range(12) if rng.random() < 0.6}
    thin = {(r["y"], r["x"]) for r in regions.thin_guo_hall(spark.createDataFrame([(1, 0, *c) for c in cells], PIXEL)).collect()}

    def parts(points):
        left, n = set(points), 0
        while left:
            n, stack = n + 1, [left.pop()]
            while stack:
                y, x = stack.pop()
                near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                left -= near
                stack += near
        return n

    assert thin <= cells and parts(thin) == parts(cells)


def test_distances_stop_at_an_end(spark):
    strip = drawn(spark, ["##########"])
    seeds, ends = strip.where("x = 2"), strip.where("x in (5, 9)")
    got = {r["x"]: r["d"] for r in regions.distance_map(strip, seeds, ends).collect()}
    assert got == {0: 4, 1: 3, 2: 2, 3: 3, 4: 4, 5: 5}
    assert regions.distance_map(strip, seeds, strip.where("x > 99")).count() == 10


def test_farthest_path_of_a_snake(spark):
    snake = drawn(spark, ["#####", "....#", "#####", "#....", "#####"])
    path = [(r["y"], r["x"]) for r in regions.farthest_path(snake, snake.where("y = 2 and x = 2")).orderBy("pos").collect()]
    assert {path[0], path[-1]} == {(0, 0), (4, 4)} and all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(path, path[1:]))


def test_lines_break_at_invalid_points(spark):
    track = spark.createDataFrame([(1, 0, 1.0, 1.0), (1, 1, 4.0, 1.0), (1, 2, -1.0, 1.0), (1, 3, 8.0, 1.0), (1, 4, 10.0, 1.0), (1, 5, None, 1.0)], "line_id long, i int, x double, y double")
    assert sorted(r["x"] for r in compose.track_lines(track, 0.5, closed=False).collect()) == [1, 2, 3, 4, 8, 9, 10]
    marked = {(r["y"], r["x"]) for r in compose.track_lines(track, 0.5, closed=False, marks=True).collect()}
    assert {(0, 1), (2, 4), (0, 10)} <= marked and (1, 6) not in marked
    square = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(((1, 1), (4, 1), (4, 4), (1, 4)))], "poly_id long, i int, x int, y int")
    assert {(r["y"], r["x"]) for r in compose.contour_lines(square, 0.5).collect()} == {(y, x) for y in range(1, 5) for x in range(1, 5) if y in (1, 4) or x in (1, 4)}


def test_optimised_centre_lines_stay_in_a_bar(spark):
    bar = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(((2, 2), (22, 2), (22, 8), (2, 8)))], "poly_id long, i int, x int, y int")
    line = composites.optimised_centerlines(bar, (26, 12), 2.0, 10.0, 10.0).orderBy("i").collect()
    middle = [r["y"] for r in line[4:8]]
    assert all(4.5 < y < 5.5 for y in middle) and abs(line[-1]["x"] - line[0]["x"]) > 15 and {r["converged"] for r in line} == {True}


def test_progress_of_streams(spark, tmp_path):
    log = streams.ProgressLog()
    spark.streams.addListener(log)
    try:
        spark.createDataFrame([(1, 0, 1, 1, 1, [5])], streams.FRAMES).write.parquet(str(tmp_path / "in"))
        seen = []
        streams.fan_out(streams.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "c"), lambda batch, n: seen.append(batch.count())).awaitTermination()
        for _ in range(100):
            if any(sum(rows) for rows in log.rows.values()):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    assert sum(seen) == 1 and [1] in [[n for n in rows if n] for rows in log.rows.values()]
