"""Steps whose memory, rounds or time once grew faster than their input."""

import math
import random

import pandas as pd
from pyspark.sql import functions as F

from framewright.functions import buckets, pieces
from framewright.functions.iterate import cut
from framewright.operators import boxes, composites, fields, graphs, outlines, regions, shapes, snakes
from framewright.plans import registry, stream_queries
from framewright.plans.base import Views


def plan(capsys, frame):
    capsys.readouterr()
    frame.explain()
    return capsys.readouterr().out


def test_pixels_are_not_broadcast_by_the_size_of_their_frames(spark, sf, capsys):
    text = plan(capsys, registry.queries()["e12_subimage"](spark, sf))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_tables_between_rounds_are_not_broadcast_by_the_size_of_their_files(spark, capsys):
    links = cut(spark.range(1000).select(F.lit(1).alias("frame"), (F.col("id") % 10).alias("k"), "id"))
    text = plan(capsys, links.join(links.groupBy("frame", "k").agg(F.min("id").alias("low")), ["frame", "k"]))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_tiles_hold_the_box_of_their_cells_and_leave_a_task_in_pieces():
    frames = pd.DataFrame({"video_id": 0, "frame_idx": range(1000), "ty": 0, "tx": 0, "ys": [[3, 4]] * 1000, "xs": [[5, 5]] * 1000, "seeds": [[True, False]] * 1000})
    settled = list(fields._round(regions.KINGS, 0.0, True, fields.TILE)(iter([frames])))
    assert max(map(len, settled)) <= fields.ROWS and all(b == [3, 5, 2, 1] for piece in settled for b in piece["box"])
    ended = list(fields._lengths(regions.KINGS)(iter([pd.concat([*settled] * 40)])))
    assert sum(map(len, ended)) == 80_000 and max(map(len, ended)) < 2 * fields.PIXELS and len(ended) > 1


def test_tiles_are_gathered_from_pixels_in_order_not_from_lists(spark, monkeypatch, capsys):
    plans, keep = [], fields._cut
    monkeypatch.setattr(fields, "_cut", lambda df: plans.append(plan(capsys, df)) or keep(df))
    cells = spark.range(300).select(F.lit(1).alias("video_id"), F.lit(0).cast("long").alias("frame_idx"), F.lit(2).alias("y"), F.col("id").cast("int").alias("x"))
    found = fields.ways(cells, cells.where("x = 0"), regions.KINGS)
    assert "collect_list" not in plans[0] and found.agg(F.max("d")).first()[0] == 299


def test_gathered_tiles_are_whole_and_leave_in_pieces():
    cells = pd.DataFrame([(1.0 if k % 2 else None, k, y, x, False, 0, 0) for k in range(600) for y in (0, 1) for x in range(9)], columns=[*fields.PIXEL, "seed", "ty", "tx"])
    found = list(fields._gathered(cells.iloc[i : i + 700] for i in range(0, len(cells), 700)))
    assert max(map(len, found)) <= fields.ROWS and pd.concat(found)["frame_idx"].tolist() == list(range(600))
    assert all(len(ys) == 18 and sorted(set(zip(ys, xs, strict=True))) == [(y, x) for y in (0, 1) for x in range(9)] for piece in found for ys, xs in zip(piece["ys"], piece["xs"], strict=True))


def test_farthest_pairs_sweep_over_packed_tiles(spark, monkeypatch):
    """A way over two tiles, a frame whose seed is no cell, frames of scattered cells: as sweeps over pixels."""
    rng = random.Random(2)
    rows = {(0, 0, 5, x) for x in range(100, 300)} | {(0, 1, 3, x) for x in range(4)}
    rows |= {(1, k, rng.randrange(120, 136), rng.randrange(120, 136)) for k in range(12) for _ in range(150)}
    starts = [(0, 0, 5, 200), (0, 1, 3, 4)] + [(1, k, *min((y, x) for v, n, y, x in rows if (v, n) == (1, k))) for k in range(12)]
    schema = "video_id int, frame_idx long, y int, x int"
    mask, seeds = spark.createDataFrame(sorted(rows), schema), spark.createDataFrame(starts, schema)
    sweep = lambda ends: {(r["video_id"], r["frame_idx"]): (r["y"], r["x"], r["d"]) for r in regions.farthest_pixel(regions.distance_map(mask, spark.createDataFrame([(*f, *e[:2]) for f, e in ends.items()], schema))).collect()}
    want, ends = {}, {(v, n): (y, x, 0.0) for v, n, y, x in starts}
    while ends:
        again = sweep(ends)
        for frame, end in list(ends.items()):
            before = want.get(frame)
            if before is None or again[frame][2] > before[4]:
                want[frame], ends[frame] = (*end[:2], *again[frame]), again[frame]
            else:
                del ends[frame]
    monkeypatch.setattr(fields, "ways", None)
    got = {(r["video_id"], r["frame_idx"]): (r["y1"], r["x1"], r["y2"], r["x2"], r["d"]) for r in regions.farthest_pair(mask, seeds).collect()}
    assert got == want and got[0, 0][4] == 201 and len(got) == 14


def test_thinning_takes_one_shuffle_a_round(spark, capsys):
    mask = cut(spark.createDataFrame([(0, 0, y, x) for y in range(3) for x in range(4)], "video_id int, frame_idx long, y int, x int"))
    text = plan(capsys, regions._thinned(mask, 5, 6))
    assert text.count("Exchange") == 1


def test_short_curves_step_in_groups_and_long_ones_alone(spark):
    line = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: k.cast("double"))
    curves = spark.range(201).withColumnRenamed("id", "curve_id").withColumn("xs", F.when(F.col("curve_id") < 200, line(8)).otherwise(line(500))).withColumn("ys", F.col("xs"))
    deal = {r["deal"]: r["count"] for r in snakes._dealt(curves).groupBy("deal").count().collect()}
    assert deal.pop("curve 200") == 1 and len(deal) <= 4 and sum(deal.values()) == 200


def test_contraction_orders_only_edges_at_removed_nodes(spark, monkeypatch):
    rows = [(k, 0, k, 1.0) for k in range(1, 9)] + [(9, 8, 20, 2.0), (10, 7, 7, 3.0)]
    edges = spark.createDataFrame(rows, "edge_id long, n1 long, n2 long, length double")
    counts, plain = [], graphs.order_by_doubling
    monkeypatch.setattr(graphs, "order_by_doubling", lambda links, keys: counts.append(links.count()) or plain(links, keys))
    found = sorted(map(tuple, graphs.contract(edges).select("edge_id", "n1", "n2", "length").collect()))
    assert counts == [4]
    assert found == sorted([(k, 0, k, 1.0) for k in range(1, 8)] + [(8, 0, 20, 3.0), (10, 7, 7, 3.0)])


def test_nodes_merge_by_cells(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, rng.choice([rng.uniform(0, 9), float(rng.randrange(9))]), rng.choice([rng.uniform(0, 9), float(rng.randrange(9))])) for k in range(120)] + [(500, None, 1.0)]
    rows += [(200 + k, 50.0 + k % 3 * 0.1, 50.0) for k in range(300)]
    links, plain = [], graphs.connected
    monkeypatch.setattr(graphs, "connected", lambda nodes, found: links.append(found.count()) or plain(nodes, found))
    got = dict(map(tuple, graphs.merge_nodes(spark.createDataFrame(rows, "node_id long, x double, y double"), 0.7).collect()))
    low = {k: k for k, _, _ in rows}
    placed = rows[:120] + rows[121:]
    for _ in range(40):
        for a, x, y in placed:
            low[a] = min(low[b] for b, u, v in placed if abs(x - u) <= 0.7 and abs(y - v) <= 0.7)
    assert got == low and max(links) < 2000


def test_a_trigger_takes_more_files_as_there_are_more(spark, sf, monkeypatch):
    asked = []
    monkeypatch.setattr(stream_queries, "landed", lambda s: ("file:///tmp", 120))
    monkeypatch.setattr(stream_queries.streams, "read_stream", lambda *a: asked.append(a[2]))
    stream_queries.arriving(Views(spark, sf))
    assert asked == [8]


def test_overlaps_are_dealt_and_equal_rectangles_are_compared_once(spark, sf, capsys, monkeypatch):
    """One file of a few MB holds billions of pairs: it must not be broadcast to the one task that reads it."""
    text = plan(capsys, registry.queries()["e16_overlaps"](spark, sf))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
    rng, rows, keep = random.Random(3), [], buckets.dealt
    places = [(float(rng.randrange(8)), float(rng.randrange(8)), float(rng.randrange(4)), float(rng.randrange(1, 5))) for _ in range(12)]
    boxes = [(k // 2 if k % 50 == 1 else k, *places[k % 12 if k % 3 else 0]) for k in range(240)] + [(None, 0.0, 0.0, 9.0, 9.0), (900, None, 0.0, 9.0, 9.0)]
    rects = spark.createDataFrame(boxes, "rect_id long, x double, y double, w double, h double")
    ids = [b for b in boxes if None not in b]
    want = sorted((a[0], b[0], max(a[1], b[1]), max(a[2], b[2]), w, h) for a in ids for b in ids if a[0] < b[0] and (w := min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])) > 0 and (h := min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])) > 0)
    monkeypatch.setattr(buckets, "dealt", lambda listed, keys: rows.append(listed.count()) or keep(listed, keys))
    for members, size in ((16, 3.0), (256, 100.0), (1, None)):
        monkeypatch.setattr(buckets, "MEMBERS", members)
        assert sorted(map(tuple, shapes.overlaps(rects, size).collect())) == want
    assert sum(rows[2:4]) <= (buckets.DEALS + 1) * 13 < 240


def test_points_in_rects_are_dealt_and_copies_are_compared_once(spark, sf, capsys, monkeypatch):
    text = plan(capsys, registry.queries()["e15_points_in_rects"](spark, sf))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
    rng, rows, keep = random.Random(4), [], buckets.dealt
    places = [(float(rng.randrange(9)), float(rng.randrange(9)), float(rng.randrange(4)), float(rng.randrange(5))) for _ in range(12)]
    boxes = [(None if k == 7 else k // 2, *places[k % 12 if k % 3 else 0]) for k in range(120)] + [(900, None, 0.0, 9.0, 9.0)]
    dots = [(k // 2, f"p{k % 5}", *places[k % 5][:2]) for k in range(200)] + [(901, None, 1.0, None), (902, None, 2.0, 2.5)]
    rects = spark.createDataFrame(boxes, "rect_id long, x double, y double, w double, h double")
    points = spark.createDataFrame(dots, "point_id long, name string, x double, y double")
    inside = [(*p, b[0]) for p in dots for b in boxes if p[3] is not None and b[1] is not None and b[1] <= p[2] <= b[1] + b[3] and b[2] <= p[3] <= b[2] + b[4]]
    monkeypatch.setattr(buckets, "dealt", lambda listed, keys: rows.append(listed.count()) or keep(listed, keys))
    for members, size in ((16, 3.0), (256, 100.0), (1, None)):
        monkeypatch.setattr(buckets, "MEMBERS", members)
        found = shapes.points_in_rects(points, rects, size)
        assert found.columns == ["point_id", "name", "x", "y", "rect_id"] and sorted(map(tuple, found.collect()), key=repr) == sorted(inside, key=repr)
    assert rows[3] <= 6 and rows[2] <= buckets.DEALS * 12 < 120
    assert shapes.points_in_rects(points.select("x", "y"), rects, 3.0).count() == len(inside)


def test_outlines_of_small_frames_are_made_in_tasks_and_as_the_dealt_ones(spark, monkeypatch):
    rng = random.Random(4)
    rows = {(v, k, rng.randrange(-3, 6), rng.randrange(-4, 7)) for v in range(2) for k in range(40) for _ in range(rng.randrange(1, 70))}
    rows |= {(2, 0, 0, 0), (2, 0, 1, 1), (2, 1, 0, 0), (2, 1, 5, 900_000), (2, 1, 800_000, 3), (2, 2, 4, 4)} | {(2, 3, y, x) for y in range(9) for x in range(9) if (y, x) != (4, 4)}
    mask = spark.createDataFrame([*rows, *list(rows)[:50]], "video_id long, frame_idx long, y int, x int")
    want = shapes._dealt_outlines(mask.distinct())
    assert shapes.region_outlines(mask).dtypes == want.dtypes
    want = sorted(map(tuple, want.collect()))
    with monkeypatch.context() as m:
        m.setattr(regions, "WHOLE", 20)
        assert sorted(map(tuple, shapes.region_outlines(mask).collect())) == want
    monkeypatch.setattr(shapes, "_dealt_outlines", None)
    assert sorted(map(tuple, shapes.region_outlines(mask).collect())) == want and len({w[:2] for w in want}) == 84


def test_outlines_of_overlapping_spans_over_pieces(monkeypatch):
    spans = pd.DataFrame([(1, k, y, x0, 5) for k in range(50) for y in range(3) for x0 in (2, 4)], columns=["video_id", "frame_idx", "y", "x0", "x1"])
    monkeypatch.setattr(pieces, "PIXELS", 60)
    found = list(pieces.pieces((spans.iloc[i : i + 7] for i in range(0, len(spans), 7)), outlines.outlined))
    assert len(found) > 10 and max(map(len, found)) < 60
    for _, ring in pd.concat(found).groupby("frame_idx"):
        assert ring["i"].tolist() == list(range(14)) and ring[["x", "y"]].values.tolist()[:6] == [[2, 0], [3, 0], [4, 0], [5, 0], [6, 0], [6, 1]]


def test_pixels_of_a_polygon_with_corners_that_lack(spark):
    """A corner without x gives pixels without x, as in SQL."""
    corners = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 4, 0), (1, 2, None, 2), (1, 3, 0, 3)], "poly_id long, i int, x int, y int")
    found = {(r["y"], r["x"]) for r in shapes.rasterize(corners).collect()}
    assert found == {(0, x) for x in range(5)} | {(1, 0), (1, 1), (1, 2), (2, 0), (2, None), (3, 0), (3, None)}


def test_longest_ways_of_small_frames_are_made_in_tasks_and_as_tile_by_tile(spark):
    rng = random.Random(6)
    rows = {(v, k, rng.randrange(-2, 7), rng.randrange(-3, 9)) for v in range(3) for k in range(30) for _ in range(rng.randrange(1, 90))}
    rows |= {(4, 0, 5, 5)} | {(4, 1, y, x) for y in range(20) for x in range(9)} | {(4, 2, 0, x) for x in range(40)} | {(4, 3, y, x) for y in range(0, 20, 2) for x in range(20)} | {(4, 3, y, 19 * (y % 4 == 1)) for y in range(1, 20, 2)}
    mask = spark.createDataFrame(sorted(rows), "video_id long, frame_idx long, y int, x int")
    seeds = mask.groupBy(*regions.FRAME).agg(F.min(F.struct("y", "x")).alias("p")).select(*regions.FRAME, "p.y", "p.x")
    want = regions.farthest_path(mask, seeds)
    found = boxes.longest_ways(mask.select(*regions.FRAME, "y", F.col("x").alias("x0"), F.col("x").alias("x1")), len(rows))
    assert found.dtypes == want.select(found.columns).dtypes
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select(found.columns).collect()))


def test_slopes_of_packed_frames_are_those_of_pixels(spark):
    rng = random.Random(7)
    rows = {(k, 0, rng.randrange(-1, 9), rng.randrange(-1, 12)) for k in range(12) for _ in range(20 * k + 1)}
    rows |= {(20, 0, y, x) for y in range(8) for x in range(11)}
    mask = spark.createDataFrame(sorted(rows), "video_id long, frame_idx long, y int, x int")
    want = {tuple(r)[:4]: (r["gx"], r["gy"]) for r in composites._depth_slopes(mask, (11, 8)).collect()}
    packed = boxes.packed(mask.select(*regions.FRAME, "y", F.col("x").alias("x0"), F.col("x").alias("x1")), len(rows), 8, 11).collect()
    slopes = boxes.depth_slopes(8, 11, 1.0)([*[r["packed"] for r in packed], None])
    assert {w[0] for w in want} == {r["video_id"] for r in packed} and not slopes[:, -1].any()
    for k, r in enumerate(packed):
        assert all(abs(slopes[c, k, y, x] - want.get((r["video_id"], 0, y, x), (0, 0))[c]) < 1e-9 for c in (0, 1) for y in range(8) for x in range(11))


def test_centre_lines_of_small_polygons_are_made_in_tasks_and_as_tile_by_tile(spark, monkeypatch):
    corners = [(p, i, 14 + round((3 + (p * 5 + i * i) % 9) * math.cos(i * math.pi / 4)), 14 + round((3 + (p * 5 + i * i) % 9) * math.sin(i * math.pi / 4))) for p in range(12) for i in range(8)]
    contours = spark.createDataFrame(corners, "poly_id long, i int, x int, y int")
    lines = lambda: sorted(map(tuple, composites.optimised_centerlines(contours, (28, 28), 3.0, 10.0, 10.0, rounds=60).select("poly_id", "i", F.round("x", 6), F.round("y", 6), "converged").collect()))
    with monkeypatch.context() as m:
        m.setattr(boxes, "CELLS", 200)  # some polygons are larger, and so is the frame
        want = lines()
    with monkeypatch.context() as m:
        m.setattr(regions, "farthest_path", None)
        m.setattr(regions, "background_distance", None)
        assert lines() == want and len({w[0] for w in want}) == 12
        monkeypatch.setattr(snakes, "PACKED", 5)
        assert lines() == want


def test_smooth_centre_lines_of_small_polygons_need_no_rounds_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(fields, "_settled", None)
    bar = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate([(0, 0), (20, 0), (20, 4), (0, 4)])], "poly_id long, i int, x int, y int")
    line = composites.smooth_centerlines(bar, (24, 8), 1.0, 2.0, 4.0, alpha=1.0, beta=1.0, rounds=5).collect()
    assert len(line) > 15 and all(r["smoothed"] for r in line)
