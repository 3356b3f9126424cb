"""Cases in which an operator once did less than its whole job."""

import math
import random

from framewright.operators import composites, graphs, snakes
from framewright.plans import registry
from framewright.plans.base import Views


def test_graph_has_the_edges_of_all_orders(spark, duck, sf):
    want = duck.sql("select count(distinct (a.l_orderkey, a.l_linenumber)) from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1").fetchall()[0][0]
    assert Views(spark, sf).edges.count() == want


def test_nearest_edges_by_cells(spark, capsys):
    rng = random.Random(3)
    lines = {e: [(rng.uniform(-40, 40), rng.uniform(-40, 40)) for _ in range(3)] for e in range(30)}
    lines[30] = lines[7]  # a tie
    asked = {q: (rng.uniform(-60, 300), rng.uniform(-60, 60)) for q in range(40)}

    def far(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = min(1, max(0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
        return round(math.dist(p, (a[0] + t * dx, a[1] + t * dy)), 9)

    points = spark.createDataFrame([(e, i, *p) for e, line in lines.items() for i, p in enumerate(line)], "edge_id long, i int, x double, y double")
    queries = spark.createDataFrame([(q, *p) for q, p in asked.items()], "query_id long, qx double, qy double")
    found = graphs.nearest_edges(points, queries)
    for row in found.collect():
        p = asked[row["query_id"]]
        assert row["edge_id"] == min((min(far(p, *s) for s in zip(line, line[1:], strict=False)), e) for e, line in lines.items())[1]
        assert row["i"] == min((round(math.dist(p, v), 9), i) for i, v in enumerate(lines[row["edge_id"]]))[1]
    assert found.count() == len(asked)
    capsys.readouterr()
    found.explain()
    assert "NestedLoopJoin" not in capsys.readouterr().out


def test_active_contours_say_whether_they_converged(spark):
    curves = {1: [3.5] * 8, 2: [3.5, 3.5, 3.5, 6.0, 3.5, 3.5, 3.5, 3.5]}
    points = spark.createDataFrame([(c, c, 0, i, float(i), y) for c, ys in curves.items() for i, y in enumerate(ys)], "curve_id long, video_id long, frame_idx long, i int, x double, y double")
    flat = spark.createDataFrame([(c, 0, y, x, 0.0, 0.0) for c in curves for y in range(8) for x in range(8)], "video_id long, frame_idx long, y int, x int, gx double, gy double")
    for tolerance, rests, used in ((1e9, True, 1), (0.0, False, 2)):
        found = snakes.active_contours(points, flat, (8, 8), alpha=0.1, beta=1.0, gamma=0.002, rounds=2, tolerance=tolerance).collect()
        assert {(r["curve_id"], r["converged"], r["rounds"]) for r in found} == {(1, rests, used), (2, rests, used)} and len(found) == 16


def test_composite_queries_use_the_full_settings(spark, sf, monkeypatch):
    asked = {}
    monkeypatch.setattr(snakes, "active_contours", lambda points, *a, **settings: asked.update(settings) or points)
    monkeypatch.setattr(composites, "outlines", lambda contours, resolution: asked.update(resolution=resolution))
    for key in ("e32_outlines", "e35_active_contours"):
        registry.queries()[key](spark, sf)
    assert asked["resolution"] == 0.5
    assert asked.get("rounds", 50) == 50


def test_smooth_centre_lines_are_registered_and_follow_a_bar(spark):
    assert "e36_centerlines_smooth" in registry.queries()
    corners = [(0, 0), (20, 0), (20, 4), (0, 4)]
    bar = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(corners)], "poly_id long, i int, x int, y int")
    line = composites.smooth_centerlines(bar, (24, 8), 1.0, 2.0, 4.0, alpha=1.0, beta=1.0).orderBy("i").collect()
    assert all(r["smoothed"] for r in line)
    assert len(line) > 15 and abs(line[-1]["x"] - line[0]["x"]) > 15
    assert all(-0.5 <= r["x"] <= 20.5 and -0.5 <= r["y"] <= 4.5 for r in line)
