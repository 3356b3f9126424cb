"""Lines are dealt to tasks before their pixels are made."""

import random

from pyspark.sql import functions as F

from framewright.operators import compose, graphs


def test_pixels_of_lines_are_dealt_by_their_number(spark, monkeypatch):
    segments = spark.range(100).coalesce(1).select(F.col("id").alias("line_id"), *[F.lit(v).alias(n) for n, v in (("x", 0.0), ("y", 0.0), ("x2", 9.0), ("y2", 9.0))])
    whole = sorted(map(tuple, compose.polylines(segments, 2.0).collect()))
    monkeypatch.setattr(compose, "CELLS", 1000)
    few = compose.polylines(segments, 2.0)
    parts = few.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert few.rdd.getNumPartitions() == 15 and len(parts) > 8 and max(p["count"] for p in parts) < len(whole) // 2
    assert sorted(map(tuple, few.collect())) == whole


def test_lines_across_blocks_with_marks(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, i, rng.uniform(-3, 40), rng.uniform(-20, 40)) for k in range(4) for i in range(6)]
    points = spark.createDataFrame(rows, "line_id long, i int, x double, y double")
    monkeypatch.setattr(compose, "BLOCK", 4)
    got = sorted(map(tuple, compose.track_lines(points, 1.5, closed=False, marks=True).collect()))
    want = set()
    for k in range(4):
        line = [r[2:] for r in rows if r[0] == k]
        for py in range(-30, 50):
            for px in range(-10, 50):
                near = min(((px - x) ** 2 + (py - y) ** 2 for x, y in line if x > 0), default=1e9) <= 9
                for (ax, ay), (bx, by) in zip(line, line[1:]):
                    if ax > 0 and bx > 0:
                        t = min(1, max(0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
                        near |= (ax + t * (bx - ax) - px) ** 2 + (ay + t * (by - ay) - py) ** 2 <= 0.75**2
                if near:
                    want.add((k, py, px))
    assert got == sorted(want)


def test_split_edges_are_sorted_once_for_parts_and_places(spark, capsys):
    rows = [(e, i, float(e), float(i)) for e in (1, 2, 3) for i in (0, 2, 3, 5, 8)]
    points = spark.createDataFrame(rows, "edge_id long, i int, x double, y double")
    splits = spark.createDataFrame([(1, 2), (1, 5), (2, 3), (2, 3), (3, 4)], "edge_id long, i int")
    found = graphs.split_edges(points, splits)
    got = sorted((r["edge_id"], r["part"], r["i"], r["y"]) for r in found.collect())
    want = [(e, p, k, float(i)) for e, parts in ((1, ((0, 2), (2, 3, 5), (5, 8))), (2, ((0, 2, 3), (3, 5, 8))), (3, ((0, 2, 3, 5, 8),))) for p, part in enumerate(parts) for k, i in enumerate(part)]
    assert got == want
    capsys.readouterr()
    found.explain()
    assert "part#" not in "".join(line for line in capsys.readouterr().out.splitlines() if " Sort [" in line)
