"""Hand-made cases and invariants of the operators."""

import math
import struct
import zlib

from pyspark.sql import functions as F

from framewright.functions import kernels
from framewright.operators import compose, composites, curves, frames, graphs, regions, shapes, snakes, temporal
from framewright.sources import catalog


def mask(spark, *rows):
    cells = [(0, 0, y, x) for y, row in enumerate(rows) for x, c in enumerate(row) if c != "."]
    return spark.createDataFrame(cells, "video_id int, frame_idx long, y int, x int")


def places(df):
    return {(r["y"], r["x"]) for r in df.collect()}


def video(spark, *values):
    return spark.createDataFrame([(0, i, 0, 0, v) for i, v in enumerate(values)], "video_id int, frame_idx long, y int, x int, v int")


def test_weights_sum_to_one():
    for method in ("nearest", "linear", "area", "cubic", "lanczos"):
        for n, m in ((8, 4), (8, 16), (5, 3), (1, 4)):
            total = {}
            for d, _, w in kernels.resampling(n, m, method):
                total[d] = total.get(d, 0) + w
            assert all(abs(t - 1) < 1e-9 for t in total.values()) and len(total) == m
    assert abs(sum(kernels.gaussian(1.5)) - 1) < 1e-12
    assert len(kernels.ellipse(2)) == 1 + 5 + 5 + 5 + 1


def test_rotation_four_times_is_identity(spark):
    pixels = spark.createDataFrame([(0, 0, y, x, 10 * y + x) for y in range(2) for x in range(3)], "video_id int, frame_idx long, y int, x int, v int")
    sizes = [spark.createDataFrame([(0, w, h, 1)], "video_id int, width int, height int, frame_count long") for w, h in ((3, 2), (2, 3), (3, 2), (2, 3))]
    turned = pixels
    for videos in sizes:
        turned = frames.rotate(turned, videos, 90)
    assert sorted(turned.collect()) == sorted(pixels.collect())


def test_slices(spark):
    five = video(spark, 0, 1, 2, 3, 4)
    videos = spark.createDataFrame([(0, 1, 1, 5)], "video_id int, width int, height int, frame_count long")
    for s in (slice(None, None, -1), slice(1, 4), slice(-3, None), slice(None, -1, 2), slice(4, 0, -2), slice(9, 12)):
        got = [r["v"] for r in frames.cut(five, videos, s.start, s.stop, s.step or 1).orderBy("frame_idx").collect()]
        assert got == list(range(5))[s], s


def test_one_frame_has_no_difference(spark):
    assert temporal.difference(video(spark, 7)).count() == 0
    assert temporal.mean_std(video(spark, 7)).first()["std"] is None


def test_normalise_of_a_flat_frame(spark):
    assert [r["v"] for r in frames.normalize(video(spark, 5, 9)).orderBy("frame_idx").collect()] == [0, 0]


def test_labels_and_largest(spark):
    m = mask(spark, "##..", "..#.", "..##")
    assert regions.label(m).select("label").distinct().count() == 2
    assert places(regions.largest_region(regions.label(m))) == {(1, 2), (2, 2), (2, 3)}
    assert regions.label(m, kernels.EIGHT).select("label").distinct().count() == 1
    assert regions.label(m.where("false")).count() == 0


def test_morphology(spark):
    full = mask(spark, "###", "###", "###")
    assert places(regions.erode(full, 3, 3, regions.CROSS)) == places(full)
    assert regions.thin(full, 3, 3).count() == 0
    cross = mask(spark, ".....", "..#..", ".###.", "..#..", ".....")
    assert places(regions.erode(cross, 5, 5, regions.CROSS)) == {(2, 2)}
    assert places(regions.thin(cross, 5, 5)) <= places(cross)


def test_distance_and_path(spark):
    m = mask(spark, "###", "#.#", "###")
    seed = mask(spark, "#")
    dist = regions.distance_map(m, seed)
    got = {(r["y"], r["x"]): r["d"] for r in dist.collect()}
    assert got[0, 0] == 2 and got[0, 2] == 4 and abs(got[2, 2] - (2 + 2 + math.sqrt(2))) < 1e-9
    path = regions.walk(mask(spark, "...", "...", "..#"), regions.steepest(dist))
    assert (0, 0) in places(path) and (2, 2) in places(path)
    pair = regions.farthest_pair(mask(spark, ".####."), mask(spark, "..#")).first()
    assert {pair["x1"], pair["x2"]} == {1, 4}


def test_outline_of_a_square_and_a_ring(spark):
    square = shapes.region_outlines(mask(spark, "....", ".##.", ".##.", "...."))
    assert {(r["x"], r["y"]) for r in square.collect()} == {(1, 1), (2, 1), (3, 1), (1, 2), (3, 2), (1, 3), (2, 3), (3, 3)}
    ring = shapes.region_outlines(mask(spark, "###", "#.#", "###"))
    assert ring.count() == 12  # the outer ring only


def test_simplification_keeps_ends_and_distance(spark):
    points = spark.createDataFrame([(1, i, float(i), float(i % 2) * 0.1) for i in range(9)], "curve_id long, i int, x double, y double")
    assert [r["i"] for r in curves.simplify(points, 0.5).orderBy("i").collect()] == [0, 8]
    assert curves.simplify(points, 0.01).count() == 9


def test_circle_through_three_points(spark):
    points = spark.createDataFrame([(1, 5.0, 2.0), (1, 1.0, 6.0), (1, -3.0, 2.0)], "curve_id long, x double, y double")
    c = curves.circle_fit(points).first()
    assert abs(c["cx"] - 1) < 1e-9 and abs(c["cy"] - 2) < 1e-9 and abs(c["r"] - 4) < 1e-9


def test_merge_orientations(spark):
    a = [(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0)]
    for b, expected in (([(1, 0), (2, 0)], [0, 1, 1, 2]), ([(2, 0), (1, 0)], [0, 1, 1, 2]), ([(0, 0), (-1, 0)], [1, 0, 0, -1]), ([(-1, 0), (0, 0)], [1, 0, 0, -1]), ([(0, 0), (1, 0)], [1, 0, 0, 1])):
        points = spark.createDataFrame(a + [(2, i, float(x), float(y)) for i, (x, y) in enumerate(b)], "curve_id long, i int, x double, y double")
        merged, apart = curves.merge_pairs(points, spark.createDataFrame([(9, 1, 2)], "pair_id long, c1 long, c2 long"))
        assert [r["x"] for r in merged.orderBy("i").collect()] == expected and apart.count() == 0


def test_missing_ray_and_disjoint_rectangles(spark):
    square = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(((0, 0), (2, 0), (2, 2), (0, 2)))], "poly_id long, i int, x int, y int")
    anchor = spark.createDataFrame([(7, 1, 9.0, 9.0)], "anchor_id long, poly_id long, x double, y double")
    hits = shapes.ray_hits(shapes.fan(anchor, [0.0]), shapes.ring_edges(square))
    assert hits.first()["dist"] is None and shapes.farthest_hit(hits).first()["dist"] == 0
    rects = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (2, 2.0, 0.0, 2.0, 2.0), (3, 1.0, 1.0, 2.0, 2.0)], "rect_id long, x double, y double, w double, h double")
    assert {(r["a"], r["b"]) for r in shapes.overlaps(rects, 1.5).collect()} == {(1, 3), (2, 3)}
    assert {(r["a"], r["b"]) for r in shapes.overlaps(rects).collect()} == {(1, 3), (2, 3)}
    assert shapes.overlaps(rects.where("false")).count() == 0
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 3.5, 0.5), (3, 9.0, 9.0)], "point_id long, x double, y double")
    for size in (None, 0.7, 50.0):
        assert {(r["point_id"], r["rect_id"]) for r in shapes.points_in_rects(points, rects, size).collect()} == {(1, 1), (1, 2), (1, 3), (2, 2)}


def test_pruning_and_contraction(spark):
    edges = spark.createDataFrame([(1, 1, 2, 9.0), (2, 2, 3, 9.0), (3, 2, 4, 1.0), (4, 3, 3, 0.5)], "edge_id long, n1 long, n2 long, length double")
    left = graphs.prune(edges, 4.0)
    assert {r["edge_id"] for r in left.collect()} == {1, 2}
    whole = graphs.contract(left).collect()
    assert len(whole) == 1 and whole[0]["length"] == 18 and {whole[0]["n1"], whole[0]["n2"]} == {1, 3}


def test_layers(spark):
    pixels = video(spark, 1, 2)
    low = spark.createDataFrame([(0, 0, 1, 50), (0, 0, 3, 70)], "y int, x int, z int, color int")
    assert [r["v"] for r in compose.layers(pixels, low).collect()] == [70, 70]


def png(path, rows):
    """A tiny RGB image file."""

    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes(v for px in row for v in px) for row in rows)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_image_stack(spark, tmp_path):
    for k in range(3):
        png(tmp_path / f"f{k}.png", [[(10 * k, x, y) for x in range(3)] for y in range(2)])
    p = catalog.read_images(spark, f"file://{tmp_path}/*.png")
    assert p.count() == 3 * 2 * 3 * 3
    row = p.where("frame_idx = 2 and y = 1 and x = 2").orderBy("c").collect()
    assert [r["v"] for r in row] == [1, 2, 20]  # blue, green, red


def test_noise_figures(spark):
    row = catalog.noise(spark, 50, 10, 10, 5.0, 2.0, 3).agg(F.avg("v"), F.stddev("v"), F.count("v")).first()
    assert abs(row[0] - 5) < 0.15 and abs(row[1] - 2) < 0.15 and row[2] == 5000


def bar(spark):
    return spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(((0, 0), (6, 0), (6, 2), (0, 2)))], "poly_id long, i int, x int, y int")


def test_outline_of_a_bar(spark):
    rows = composites.outlines(bar(spark), 1.0).collect()
    assert {r["x"] for r in rows} == {k - 0.5 for k in range(8)} and {r["y"] for r in rows} == {k - 0.5 for k in range(4)}
    assert len(rows) == 2 * (7 + 3)


def test_centre_line_of_a_bar(spark):
    rows = composites.centerlines(bar(spark)).orderBy("i").collect()
    assert abs(rows[0]["x"] - rows[-1]["x"]) == 6 and [r["i"] for r in rows] == list(range(len(rows)))


def test_active_contour_without_forces(spark):
    line = spark.createDataFrame([(1, 0, 0, i, float(i), 3.0 + (i == 3)) for i in range(6)], "curve_id long, video_id int, frame_idx long, i int, x double, y double")
    flat = spark.createDataFrame([(0, 0, y, x, 0.0, 0.0) for y in range(8) for x in range(8)], "video_id int, frame_idx long, y int, x int, gx double, gy double")
    ends = spark.createDataFrame([(1, i, True, True) for i in (0, 5)], "curve_id long, i int, hold_x boolean, hold_y boolean")
    rows = snakes.active_contours(line, flat, (8, 8), beta=10.0, gamma=0.1, anchors=ends, rounds=3).orderBy("i").collect()
    assert (rows[0]["y"], rows[5]["y"]) == (3.0, 3.0) and 3.0 < rows[3]["y"] < 4.0
